"""Periodic runs, license scans and whitening against plain versions."""
import hashlib
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

import brute
from tablewright.llm import licenses, periods, plans, whitening


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j + p - i
            if n >= max(6, 4 * p) and not any(w[i:i + n - q] == w[i + q:i + n] for q in range(1, p)):
                out.append((i, n, p))
            i = max(j, i + 1) if j == i else j + 1
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def plain_collapse(w: list, found: list) -> list:
    return [x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in found)]


def repetitive(rng: random.Random) -> list[str]:
    n = rng.randint(0, 70)
    w = [f"w{rng.randrange(rng.choice([1, 2, 3, 40]))}" for _ in range(n)]
    if n > 4 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed):
    rng = random.Random(seed)
    texts = [repetitive(rng) for _ in range(400)]
    found, collapsed = periods.runs_of([" ".join(w).encode() for w in texts])
    for w, f, c in zip(texts, found, collapsed):
        want = plain_runs(w)
        assert [tuple(r) for r in f.tolist()] == want, w
        assert c.decode().split() == plain_collapse(w, want)
        if w:  # without cutting the text into stretches first
            assert [tuple(r) for r in periods.runs(np.unique(w, return_inverse=True)[1]).tolist()] == want


def test_common_extensions():
    rng = np.random.default_rng(4)
    for k in (1, 2, 5):
        w = rng.integers(1, k + 1, 200).tolist()
        lce = periods.CommonExtension(w)
        a, b = rng.integers(0, 201, (2, 2000))
        a, b = a[a != b], b[a != b]
        for i, j, n in zip(a.tolist(), b.tolist(), lce(a, b).tolist()):
            assert w[i:i + n] == w[j:j + n] and (w[i + n:i + n + 1] != w[j + n:j + n + 1] or max(i, j) + n >= 200)
        order = sorted(range(201), key=lambda i: w[i:])
        assert (np.argsort(lce.place) == order).all()


def test_runs_take_time_in_proportion():
    def seconds(n: int) -> float:
        w = np.arange(n) % (n // 5)
        start = time.perf_counter()
        assert [tuple(r) for r in periods.runs(w).tolist()] == [(0, n, n // 5)]
        return time.perf_counter() - start
    seconds(1000)
    assert seconds(80_000) < 16 * seconds(10_000) + 0.5


def test_find_runs(spark):
    rows = [None, "", " \n", "a b " * 5, "a b " * 5, "x " + "é É " * 4 + "y", "a\tb\x0bc\n" * 4, "z " * 50_000, "one two three"]
    df = spark.createDataFrame([(i if i else None, t, "r") for i, t in enumerate(rows)], "doc_id long, text string, runs string")
    got = {r["doc_id"]: r for r in periods.find_runs(df).collect()}
    assert periods.find_runs(df).columns == ["doc_id", "text", "runs", "collapsed"] and len(got) == len(rows)
    for i, t in enumerate(rows):
        w = [x.decode() for x in brute.words(t)]
        want = plain_runs(w) if len(w) < 1000 else [(0, 50_000, 1)]
        r = got[i if i else None]
        assert [tuple(x) for x in r["runs"]] == want and r["text"] == t
        assert r["collapsed"] == " ".join(plain_collapse(w, want))
    assert periods.find_runs(df.limit(0)).count() == 0


def plain_periodic(doc_id, text) -> dict:
    w = [x.decode() for x in brute.words(text)]
    n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = dict(zip(("start", "length", "period"), best)) if best else dict.fromkeys(("start", "length", "period"))
    return out | {"doc_id": doc_id, "n_runs": len(found), "exponent_milli": 1000 * best[1] // best[2] if best else None,
                  "runs_sha256": digest("".join(f"{s},{n},{p}\n" for s, n, p in found)),
                  "collapsed_sha256": digest(" ".join(plain_collapse(w, found)))}


def test_runs_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(repetitive(rng))) for i in range(500)] + [(7, None), (None, "a " * 9), (-3, ""), (501, "b " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.asDict() for r in plans.QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(({k: v for k, v in sorted(plain_periodic(*r).items(), key=lambda x: list(got[0]).index(x[0]))} for r in rows), key=repr)
    assert sum(r["n_runs"] > 0 for r in got) > 100


# --- licenses


def plain_words(text) -> list[str]:
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c >= "\x80" or c.isdigit() or "a" <= c <= "z" else " " for c in out).split(" ")


def plain_places(w: list, phrase: list) -> list[int]:
    return [i for i in range(len(w) - len(phrase) + 1) if w[i:i + len(phrase)] == phrase]


@pytest.mark.parametrize("seed", range(3))
def test_automaton(seed):
    """Maximal matches, all their places, and whole templates, over alphabets where everything repeats."""
    rng = random.Random(seed)
    for _ in range(300):
        letters = [b"a", b"b", b"c", b"d"][:rng.randint(1, 4)]
        templates = [[rng.choice(letters) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 4))]
        made = licenses.Automaton(templates, ["x"] * len(templates))
        text = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 30))]
        parts = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        held = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n:i + 1]) in parts), default=0) for i in range(len(text))]
        maximal, whole = made.matches(text)
        want = [(i + 1, n) for i, n in enumerate(held) if n > 1 and (i + 1 == len(held) or held[i + 1] != n + 1)]
        assert [(e, n) for e, n, _ in maximal if n > 1] == want
        for e, n, state in maximal:
            places = [(t, j) for t, x in enumerate(templates) for j in range(n, len(x) + 1) if x[j - n:j] == text[e - n:e]]
            assert sorted(made.ends[state]) == places
        assert sorted(whole) == sorted((i + len(x), t) for t, x in enumerate(templates) for i in plain_places(text, x))


def plain_best(w: list, template: list) -> int:
    """Most words that a chain of maximal matches covers of a template."""
    found = []
    for i in range(len(w)):
        for j in range(len(template)):
            if w[i] == template[j] and not (i and j and w[i - 1] == template[j - 1]):
                n = 0
                while i + n < len(w) and j + n < len(template) and w[i + n] == template[j + n]:
                    n += 1
                if n >= licenses.LEAST:
                    found.append((i, j, n))
    score = []
    for k, (a, b, n) in enumerate(found):
        best = n
        for (a0, b0, n0), s in zip(found, score):
            fresh = min(n, a + n - a0 - n0, b + n - b0 - n0)
            if a0 < a and b0 < b and fresh > 0 and max(a - a0 - n0, b - b0 - n0) <= licenses.GAP:
                best = max(best, s + fresh)
        score.append(best)
    return max(score, default=0)


def test_chains():
    rng = random.Random(6)
    template = [f"t{i}".encode() for i in range(40)]
    made = licenses.Automaton([template], ["long"])
    for _ in range(200):
        text = []
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(36)
            text += template[i:i + rng.randint(1, 20)] + [b"other"] * rng.randint(0, 16)
        spans = made.scan(text)
        assert max((s["covered"] for s in spans), default=0) == plain_best(text, template)
        assert all(s["covered"] <= s["end_word"] - s["first_word"] and s["share"] <= 1 for s in spans)
    copy = template[:12] + [b"x"] + template[13:]
    [span] = made.scan([b"y"] * 5 + copy + [b"y"])
    assert (span["first_word"], span["end_word"], span["covered"]) == (5, 45, 39) and made.accepted(span)
    assert not made.accepted(made.scan(copy[:20])[0])


NOTICE = next(t for t, label in licenses.TEMPLATES.items() if label == "mit")


def test_license_query(spark, tmp_path):
    rng = random.Random(3)
    pieces_ = ["GNU General\nPublic License, version 3", "the Apache   License", "CC BY-NC 4.0", "MIT_License", "cc", "by", "MIT", "license",
               "prose", "é", "gnu", "general", "public", "mitlicense", "ccé by", NOTICE.upper()]
    texts = [None, "", "...", NOTICE, NOTICE.replace("free of charge", "at no charge at all"), "word " * 30_000 + "cc-by"]
    texts += [" ".join(rng.choice(pieces_) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in plans.QUERIES["op12_license_scan"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        w = [x for x in plain_words(text) if x]
        places = {p: plain_places(w, p.split()) for p in licenses.PHRASES}
        base = sorted({licenses.PHRASES[p] for p, at in places.items() if at})
        at = sorted(x for each in places.values() for x in each)
        r = got[i]
        assert r["n_words"] == len(w) and r["n_base"] == len(at) and r["base_labels"] == ",".join(base)
        assert (r["first_word"], r["last_word"]) == ((at[0], at[-1]) if at else (None, None))
        split = {t: plain_words(t) for t in licenses.TEMPLATES}
        split = {t: [x for x in s if x] for t, s in split.items()}
        more = {licenses.TEMPLATES[t] for t, s in split.items() if len(s) < licenses.WHOLE and plain_places(w, s)}
        covered = {t: plain_best(w, s) / len(s) if len(w) < 3000 else 0 for t, s in split.items() if len(s) >= licenses.WHOLE}
        more |= {licenses.TEMPLATES[t] for t, share in covered.items() if share >= licenses.COVERED}
        assert r["labels"] == ",".join(sorted({*base, *more})), text
        assert r["score"] == (1.0 if base or more - {licenses.TEMPLATES[t] for t in covered} else max(covered.values()))
    assert "mit" in got[3]["labels"] and "mit" in got[4]["labels"]


def test_scan_rows(spark):
    df = spark.createDataFrame([(1, "MIT License", "x"), (1, "MIT License", "x")], "doc_id long, text string, spans string")
    got = licenses.scan(df)
    assert got.columns == ["doc_id", "text", "n_words", "spans"] and [len(r["spans"]) for r in got.collect()] == [1, 1]
    assert licenses.scan(df.limit(0)).count() == 0
    assert licenses.scan(df, licenses.automaton({}, {})).first()["spans"] == []
    with pytest.raises(ValueError):
        licenses.automaton({"...": "none"})


# --- whitening


def plain_whitening(rows: list, weight: str = "one", most: int = 16) -> dict:
    """Row number -> (n, deviation, whitened up to the sign, explained)."""
    x = {i: tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for i, v in enumerate(rows)
         if v and all(c is not None and np.isfinite(c) for c in v)}
    out = {}
    for d in {len(v) for v in x.values()}:
        these = {i: v for i, v in x.items() if len(v) == d}
        fit = sorted(set(these.values())) if weight == "one" else list(these.values())
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in fit])
        e, vectors = np.linalg.eigh(y.T @ y / n)
        e, vectors = e[::-1], vectors[:, ::-1]
        for i, v in these.items():
            z = np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums)]) @ vectors / np.sqrt(np.maximum(e, 1e-300))
            out[i] = (n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), z[:most], (e / max(e.sum(), 1e-300))[:most], e[:most])
    return out


@pytest.mark.parametrize("weight", ["one", "count"])
def test_whitening(spark, weight):
    rng = np.random.default_rng(5)
    mixed = rng.standard_normal((20, 20))
    rows = [[float(np.float32(c)) for c in rng.standard_normal(20) @ mixed] for _ in range(200)]
    rows += [rows[0]] * 90 + [rng.standard_normal(3).tolist() for _ in range(9)]
    rows += [None, [], [1.0, None], [float("nan")] * 20, [float("inf")] * 20, [1e300] * 20]
    df = spark.createDataFrame([(i if i else None, v, 5) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n int")
    got = whitening.whiten(df, weight=weight)
    assert got.columns == ["vec_id", "embedding", "n", "deviation", "whitened", "explained", "identity_error"]
    want = plain_whitening([v for v in rows[:-1]] + [None], weight)
    found = {r["vec_id"] or 0: r for r in got.collect()}
    assert found.keys() == want.keys() and got.count() == len(want)
    signs: dict[int, np.ndarray] = {}
    for i, (n, deviation, z, explained, _) in want.items():
        r = found[i]
        assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-9
        sign = signs.setdefault(len(rows[i]), np.sign(np.array(r["whitened"]) * z))
        assert np.allclose(np.array(r["whitened"]) * sign, z, atol=1e-7) and np.allclose(r["explained"], explained)


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    for r in whitening.whiten(df).collect():
        assert (r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, [None] * 2, [None] * 2, None)
    flat = spark.createDataFrame([(i, [float(i), 7.0]) for i in range(5)], "vec_id long, embedding array<float>")
    for r in whitening.whiten(flat).collect():
        assert r["whitened"][1] is None and r["explained"] == [1.0, 0.0] and r["identity_error"] < 1e-12
    assert whitening.whiten(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(huge).collect()} == {None, (64 * 2) ** 2}
    with pytest.raises(ValueError):
        whitening.whiten(df, weight="none")


def test_whitening_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    want = plain_whitening([r["embedding"] for r in rows])
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = plans.QUERIES["op13_embedding_whitening"](spark, sf_dir).collect()
    assert len(got) == 16 * len(rows)
    signs: dict[int, float] = {}
    for r in got:
        n, deviation, z, explained, _ = want[place[r["vec_id"]]]
        k = r["component"] - 1
        sign = signs.setdefault(k, np.sign(z[k] * r["whitened"]))
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["whitened"] * sign - z[k]) < 1e-8
        assert abs(r["explained"] - explained[k]) < 1e-10 and r["identity_error"] < 1e-9
