"""Quality rules and line deduplication against plain versions."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tablewright.llm import lines, quality

DOCUMENT = "doc_id long, text string, n_words string"  # one column has the name of a result
PROSE = "The cat sat on the mat and the dog was in the house with a bone for the rest of it. "


def texts() -> list:
    rng = random.Random(5)
    made = [None, "", " \t\n", "one", PROSE, PROSE * 3, PROSE + "#" * 40, "zz " * 40, "x" * 50_000, PROSE + "\nSame line\n" * 9,
            "\x0b\x0cThe\x1fa b " + PROSE, "été " * 30, "|a| <b> " * 20, PROSE, PROSE]
    made += [" ".join(rng.choice(["the", "of", "word", "b\n", "c"]) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    return made


def test_quality_counts(spark):
    made = texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)], DOCUMENT)
    got = {r["doc_id"]: r.asDict() for r in quality.assess(df).collect()}
    for i, t in enumerate(made):
        want = brute.quality(t, quality.STOP_WORDS)
        assert {k: got[i][k] for k in want} == want, (i, t)


def test_quality_keeps_columns_and_rows(spark):
    made = [*texts(), None, PROSE]
    df = spark.createDataFrame([(None if i % 2 else i, t, "x") for i, t in enumerate(made)], DOCUMENT)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(brute.quality(t, quality.STOP_WORDS)["kept"] for t in made)
    assert quality.assess(df.limit(0)).count() == 0


def test_rules_need_a_bound():
    with pytest.raises(ValueError):
        quality.violated([quality.Rule("none", "n_words", "n_lines")])


@pytest.mark.parametrize("n", [1, 2, 63, 1000, 20_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 62, n, replace=False).astype(np.uint64)
    made = lines.PerfectHash.build(keys)
    assert sorted(made.index(keys)) == list(range(n))
    row = lines.build_shard(0, keys, keys[::-1].copy(), np.arange(1, n + 1))
    assert (lines.probe_shard(row, keys, keys[::-1].copy()) == np.arange(1, n + 1)).all()
    strange = np.random.default_rng(1).integers(0, 1 << 62, 1000).astype(np.uint64)
    assert (lines.probe_shard(row, strange, strange) > 0).mean() < 0.01


def test_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 7)
    rng = random.Random(3)
    common = ["Common one", "  common TWO\t", "rare", "É accent", "é accent", ""]
    made = ["\n".join(rng.choice([*common, f"own {i} {k}"]) for k in range(rng.randint(1, 12))) for i in range(120)]
    made += [None, "", "\n\n", "Common one", "Common one", "x" * 30_000 + "\ncommon one"]
    df = spark.createDataFrame([(i % 50, t, f"n{i}") for i, t in enumerate(made)], "doc_id long, text string, n_lines string")
    got = lines.drop_frequent_lines(df, min_docs=5)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    want = sorted((i % 50, *x) for i, x in enumerate(brute.drop_lines(made, 5)))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(x[3] for x in want)


def test_lines_of_empty_table_and_long_keys(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.drop_frequent_lines(df).count() == 0
    df = spark.createDataFrame([(i, "ab\nabcd") for i in range(4)], "doc_id long, text string")
    kept = lines.drop_frequent_lines(df, min_docs=4, least_chars=3).select("text").distinct().collect()
    assert [r[0] for r in kept] == ["ab"]
    assert lines.drop_frequent_lines(df, min_docs=5).agg(F.sum("n_dropped")).first()[0] == 0
