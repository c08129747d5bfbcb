"""Source mixing and the SentencePiece scan against plain versions."""
import random

import numpy as np
import public_tokenizers
import pytest

import brute
from tablewright.llm import mixing, pieces


def mix_rows() -> list:
    rng = random.Random(4)
    sources = ["b", "a", "ä", "Z", None, "tiny", "none"]
    rows = [(i, "a" if i % 3 == 0 else rng.choice(sources[:5]), rng.randint(0, 30)) for i in range(200)]
    rows += [(900, "tiny", 2), (901, "none", 0), (5, "a", 7), (5, "a", 7), (None, "b", 9), (None, "b", 4), (902, "b", 3000)]
    return rows


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (1, 100)])
def test_shares(spark, weights):
    rows = mix_rows()
    df = spark.createDataFrame([(i, s, " ".join(["w"] * n) if n or k % 2 else None, "x") for k, (i, s, n) in enumerate(rows)],
                               "doc_id long, source string, text string, taken string")
    got = mixing.shares(df, weights=weights).collect()
    want = sorted((str(r[0]), r[2], t) for r, t in zip(rows, brute.mixed(rows, weights)))
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got) == want
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_mix_rows(spark):
    rows = mix_rows()
    text = lambda n: " ".join(f"w{k} \n" for k in range(n))
    df = spark.createDataFrame([(i, s, text(n), "x") for i, s, n in rows], "doc_id long, source string, text string, key string")
    out = mixing.mix(df)
    assert out.columns == df.columns
    taken = {}
    for r in out.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["text"] in text(3000) or text(3000).startswith(r["text"])
    want = {}
    for r, t in zip(rows, brute.mixed(rows)):
        want[r[0]] = want.get(r[0], 0) + t
    assert taken == {k: v for k, v in want.items() if v}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.shares(df.where("source = 'none'")).first()["target"] == 0


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def loaded(model):
    return pieces.Pieces.load(model)


def _whole(p, text: str) -> bytes:
    s = pieces.MARK + pieces.symbols(text)
    return p.path(s, 0, p.forward(s, 0, len(s))[1], len(s))


@pytest.mark.parametrize("seed", range(4))
def test_scan_equals_whole_search(loaded, seed):
    rng, p, size = random.Random(seed), loaded, 35
    for n in range(60):
        text = "".join(rng.choice("abcdethe  \n\té▁漢😀xyzing") for _ in range(rng.randint(36, 400)))
        text = text.replace(" ", "") if n % 3 == 0 else text
        chunks = [pieces._chunk_symbols(k, min(size, len(text) - a), text[a:a + size + p.longest - 1])
                  for k, a in enumerate(range(0, len(text), size))]
        matrices = [p.matrix(*c) for c in chunks]
        states = pieces.boundary_states(matrices, 0, 0)
        ids = b"".join(p.trace(*c, i, j) for c, i, j in zip(chunks, states, states[1:]))
        whole = _whole(p, text)
        assert p.score(ids) == p.score(whole) == p.score(p.marked(pieces.MARK + pieces.symbols(text)))
        assert p.decode(np.frombuffer(ids, "<i4").tolist()) == text
        # Products of products are products: blocks of any length give the same.
        a, b, c = matrices[0], matrices[1 % len(matrices)], matrices[-1]
        assert (pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))).all()


def test_search_is_best(loaded):
    """Against all segmentations of short texts."""
    p = loaded

    def best(s: str) -> int:
        if not s:
            return 0
        options = [p.scores[s[:n]][0] + best(s[n:]) for n in range(1, min(len(s), p.longest) + 1) if s[:n] in p.scores]
        return max([*options, *([] if s[0] in p.scores else [p.unknown + best(s[1:])])])

    for text in ("the", "internation", "a b", "é漢x", "un able"):
        assert p.score(_whole(p, text)) == best(pieces.MARK + pieces.symbols(text))


def _best_of_model(model: bytes):
    """The best score of a text over all pieces that the model file itself lists."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=model)
    every = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
    costs = {lib.id_to_piece(i): round(-np.log(1 - lib.get_score(i)) * pieces._SCALE) for i in every}
    assert sum(pieces.MARK in x[1:] for x in costs) == 14
    longest, unknown = max(map(len, costs)), min(costs.values()) - pieces._UNKNOWN_PENALTY * pieces._SCALE

    def best(text: str) -> int:
        s = pieces.MARK + pieces.symbols(text)
        sums = [0]
        for stop in range(1, len(s) + 1):
            options = [sums[at] + costs[s[at:stop]] for at in range(max(0, stop - longest), stop) if s[at:stop] in costs]
            sums.append(max([*options, *([] if s[stop - 1] in costs else [sums[stop - 1] + unknown])]))
        return sums[-1]
    return best


@pytest.mark.parametrize("size", [32, 50])
def test_runs_of_blanks(model, loaded, size):
    """Against the model's whole vocabulary: alone, by units, and by chunks that cut the runs anywhere."""
    p, best, rng = loaded, _best_of_model(model), random.Random(size)
    texts = ["a  b", "    if x:\n        return  y", "  ", " " * 17, " " * 400, "x" + " " * 70 + "y ", "▁  ▁", "end   ", "a\n\n    b"]
    texts += ["".join(rng.choice(["ab", "the", "\n", " ", "  ", " " * 5, " " * 16, "▁", "漢"]) for _ in range(rng.randint(5, 80))) for _ in range(60)]
    for text in texts:
        marked = p.marked(pieces.MARK + pieces.symbols(text))
        chunks = [pieces._chunk_symbols(k, min(size, len(text) - a), text[a:a + size + p.longest - 1])
                  for k, a in enumerate(range(0, len(text), size))]
        states = pieces.boundary_states([p.matrix(*c) for c in chunks], 0, 0)
        scanned = b"".join(p.trace(*c, i, j) for c, i, j in zip(chunks, states, states[1:]))
        assert p.score(marked) == p.score(scanned) == p.score(_whole(p, text)) == best(text), text
        assert p.decode(np.frombuffer(marked, "<i4").tolist()) == p.decode(np.frombuffer(scanned, "<i4").tolist()) == text
    assert len(p.marked(pieces.MARK + pieces.symbols("a" + " " * 16 + "b"))) < 4 * 6


def test_encode_and_decode_tables(spark, model, loaded, monkeypatch):
    monkeypatch.setattr(pieces, "_BLOCK_CHUNKS", 3)
    rng = random.Random(7)
    long = ["".join(rng.choice("the quick brown\n ") for _ in range(n)) for n in (99, 100, 101, 450, 3000)]
    made = [None, "", " ", "a", "▁ x", "😀" * 150, *long, long[-1], long[-2]]
    df = spark.createDataFrame([(i % 5, t, "x") for i, t in enumerate(made)], "doc_id long, text string, piece_ids string")
    coded = pieces.encode(df, model, chunk_chars=100)
    assert coded.columns == ["doc_id", "text", "piece_ids"] and coded.count() == len(made)
    rows = pieces.decode(coded, model, output="again").collect()
    assert all(r["again"] == (r["text"] or "") for r in rows)
    assert all(loaded.score(np.array(r["piece_ids"], "<i4").tobytes()) == loaded.score(_whole(loaded, r["text"])) for r in rows if r["text"])
    assert all(r["piece_ids"] == [] for r in rows if not r["text"])
    assert pieces.encode(df.limit(0), model).count() == 0
