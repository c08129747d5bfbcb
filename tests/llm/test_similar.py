"""N-gram Jaccard join, embedding near-duplicates and components against plain versions."""
import random
import time
from pathlib import Path

import numpy as np
import pytest

import brute
from tablewright.llm import jaccard, neardup
from tablewright.llm.components import components
from tablewright.session import scratch_path


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = brute.roots(500, links)
    assert all(got.get(i, i) == root[i] for i in range(500))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts() -> list:
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for size in (3, 4, 5, 6, 9, 14, 30, 80, 200):
        for _ in range(3):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 25))):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                if rng.random() < 0.5:
                    copy = copy[:rng.randint(max(1, size * 3 // 4), size)]
                rows.append(" ".join(copy))
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows += [" ".join([passage, *[rng.choice(vocabulary) for _ in range(40)]]) for _ in range(12)]
    return rows


def test_jaccard(spark):
    texts = near_texts()
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, texts[0].upper()), (904, "É a b c d"), (905, "é a b c d"),
             (7, texts[7]), (None, texts[20]), (None, "nobody else has this text at all"), (907, "y " * 30_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted((tuple(r) for r in jaccard.join(df).collect()), key=key) == sorted(brute.near_copies(rows), key=key)


@pytest.mark.parametrize("seed", range(3))
def test_signatures_meet_every_partner(seed):
    """Linked sets always share a signature that one probes with and the other is found by."""
    rng = np.random.default_rng(seed)
    for _ in range(150):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        drop = int(rng.integers(0, n // 4 + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 1 << 62, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 7 * both < 3 * (len(a) + len(b)) or not len(b):
            continue
        (sa, fa, pa), (sb, fb, pb) = (jaccard.signatures(len(x), x, rng.integers(2, 255, len(x)).astype(np.uint8)) for x in (a, b))
        assert set(sa[pa]) & set(sb[fb]) or set(sb[pb]) & set(sa[fa]), (n, drop)


def distant_texts() -> list:
    """A large group of copies of one text that are mostly too far apart to link."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(160):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8, 9])):
            copy[rng.randrange(150)] = f"x{rng.randrange(60)}"
        rows.append(" ".join(copy))
    return rows


@pytest.mark.parametrize("by_sig", [False, True])
def test_jaccard_in_a_distant_group(spark, monkeypatch, by_sig):
    monkeypatch.setattr(jaccard, "_BLOCK_SETS", 13)
    monkeypatch.setattr(jaccard, "_COLUMNS", 50)
    monkeypatch.setattr(jaccard, "_ROUNDS", 0)
    if by_sig:
        monkeypatch.setattr(jaccard, "_CROWD_SETS", 2)
    rows = list(enumerate(distant_texts()))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.near_copies(rows)
    assert len({c for *_, c in want}) > 10
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_jaccard_keep_one_and_empty(spark):
    rows = [(1, "a b c d e f"), (2, "A B C D E F"), (2, "A B C D E F"), (3, "other words are in this one"), (None, "a b c d e f"),
            (3, "one id with another text of its own"), (3, "other words are in this one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.keep_one(df)
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [rows[0], rows[3], rows[4], rows[5]]))
    assert jaccard.join(df.limit(0)).count() == 0


def vectors() -> list:
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    made = [b + rng.standard_normal(16) * s for b in base for s in (0.0, 0.05, 0.15, 0.3)]
    made += [base[0] * 5] * 30 + [base[1] + rng.standard_normal(16) * 0.02 for _ in range(30)]
    rows = [[float(x) for x in np.float32(v)] for v in made]
    return rows + [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK", 8)
    rows = vectors()
    ids = [*range(len(rows) - 1), None]
    df = spark.createDataFrame(list(zip(ids, rows, [0] * len(rows))), "vec_id long, embedding array<float>, kept int")
    got = {r["vec_id"]: tuple(r)[1:] for r in neardup.near_duplicates(df).collect()}
    unit = [np.array(v, float) / np.linalg.norm(v) if v and None not in v and np.isfinite(v).all() and any(v) else None for v in rows]
    links = [(i, j) for i, a in enumerate(unit) for j, b in enumerate(unit[:i])
             if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9]
    root, n = brute.roots(len(rows), links), np.bincount(np.array(links).ravel(), minlength=len(rows))
    found = sum(got[i][0] for i in ids) / n.sum()
    assert 0.97 <= found <= 1 and all(got[i][0] <= n[i] for i in range(len(rows) - 1))
    assert sum(got[i][1] != root[i] for i in range(len(rows) - 1)) <= 2
    assert all(got[i] == (0, i, True) for i in range(len(rows) - 7, len(rows) - 1))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_in_rounds(spark, monkeypatch):
    """Many small units, rounds, packs and blocks find what one of each finds; lengths and precisions keep apart."""
    rows = vectors() + [[float(x) for x in v[:9]] for v in vectors()[:200]] + vectors()[:40]
    of = "vec_id long, embedding array<%s>"
    small, double = (spark.createDataFrame(list(enumerate(rows)), of % t) for t in ("float", "double"))
    whole = sorted(tuple(r) for r in neardup.near_duplicates(small).collect())
    assert sum(r[1] for r in whole) > 2 * len(rows) and sorted(tuple(r) for r in neardup.near_duplicates(double).collect()) == whole
    for name, value in (("_BLOCK", 20), ("_PACK", 50), ("_STEP", 100), ("_UNIT_BYTES", 2000), ("_ROUND_BYTES", 1)):
        monkeypatch.setattr(neardup, name, value)
    paths, real = [], neardup.shared.stored_path
    monkeypatch.setattr(neardup.shared, "stored_path", lambda df, name, *by: paths.append(name) or real(df, name, *by))
    assert sorted(tuple(r) for r in neardup.near_duplicates(small).collect()) == whole
    assert paths.count("vector-links") > 2


def test_near_duplicates_disk(spark):
    """What is written stays a small multiple of the vectors, and no shuffle files are left."""
    def used(folders):
        return sum(p.stat().st_size for f in folders for p in Path(f).rglob("*") if p.is_file())

    x = np.random.default_rng(4).standard_normal((4000, 64))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    kept = [scratch_path(spark, "x").removeprefix("file:").rpartition("/")[0]]
    local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    before, shuffled = used(kept), used(local)
    found = neardup.near_duplicates(df)
    time.sleep(2)
    assert used(kept) - before < 4 * 256 * len(x)
    assert used(local) - shuffled < 256 * len(x)
    assert found.count() == len(x)
