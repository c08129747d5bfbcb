"""The isolation forest: samples from the whole table, and all trees walked together."""
import numpy as np

from tablewright.operators import outliers


def plain_depth(tree: np.ndarray, row: np.ndarray) -> float:
    at = 0
    while tree[at, 0] >= 0:
        feature, cut, child, _ = tree[at]
        at = int(child) + int(row[int(feature)] > cut)
    return tree[at, 3]


def test_trees_are_walked_together():
    rng = np.random.default_rng(1)
    rows = np.round(rng.standard_normal((3000, 3)), 1)
    forest = [np.array(outliers._grow(rows[rng.choice(3000, n, replace=False)], rng), dtype=float) for n in (1, 2, 40, 64, 64)]
    got = outliers._Walk(forest, 64).mean_depth(rows)
    assert np.allclose(got[:300], [np.mean([plain_depth(t, r) for t in forest]) for r in rows[:300]])


def test_samples_come_from_the_whole_table(spark):
    df = spark.range(20_000).selectExpr("id", "CAST(id AS DOUBLE) AS a", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 7 END AS b")
    forest, size = outliers.fit_forest(df, ["a", "b"], "id", trees=20, tree_rows=64)
    again, _ = outliers.fit_forest(df.repartition(7), ["a", "b"], "id", trees=20, tree_rows=64)
    assert size == 64 and len(forest) == 20
    assert sorted(t.tobytes() for t in forest) == sorted(t.tobytes() for t in again)  # however the rows lie
    assert len({t.tobytes() for t in forest}) == 20
    cuts = np.concatenate([t[t[:, 0] == 0, 1] for t in forest])
    assert cuts.min() < 2000 and cuts.max() > 18_000
    few, size = outliers.fit_forest(df.limit(30), ["a", "b"], "id", trees=3, tree_rows=64)
    assert size <= 30 and len(few) == 3
