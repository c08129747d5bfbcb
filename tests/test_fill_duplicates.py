import numpy as np
import pytest
from itertools import groupby
from pyspark.sql import functions as F

from tablewright.operators import duplicates as D, fill as L, impute


def test_fill_median_and_errors(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0), (3, None)], "id long, score double")
    assert [r["score"] for r in L.fill_missing(df, "score", "median").orderBy("id").collect()] == [1.0, 2.0, 3.0, 2.0]
    empty = spark.createDataFrame([(None,)], "v double")
    with pytest.raises(ValueError):
        L.fill_missing(empty, "v", "mean")
    with pytest.raises(ValueError):
        L.fill_missing(df, "score", "constant", constant=" ")
    with pytest.raises(ValueError):
        L.fill_missing(df, "score", "guess")


def test_integer_column_takes_a_fraction(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v long")
    assert [r["v"] for r in L.fill_missing(df, "v", "mean").collect()] == [1.0, 2.0, 1.5]
    assert dict(L.fill_missing(df, "v", "min").dtypes) == {"v": "bigint"}


def test_mode_tie_takes_the_smaller(spark):
    df = spark.createDataFrame([("b",), ("a",), (" ",), ("b",), ("a",)], "s string")
    assert [r["s"] for r in L.fill_missing(df, "s", "mode").collect()] == ["b", "a", "a", "b", "a"]


def test_directions(spark):
    df = spark.createDataFrame([(0, None), (1, "x"), (2, " "), (3, None), (4, "y"), (5, None)], "id long, s string")
    values = lambda t: [r["s"] for r in t.orderBy("id").collect()]
    assert values(L.fill_direction(df, "s", "id")) == [None, "x", " ", " ", "y", "y"]
    assert values(L.fill_direction(df, "s", "id", forward=False)) == ["x", "x", " ", "y", "y", None]
    assert values(L.fill_missing(df, "s", "ffill", order_by="id")) == ["x", "x", "x", "x", "y", "y"]
    assert values(L.fill_missing(df, "s", "bfill", order_by="id")) == ["x", "x", "y", "y", "y", "y"]
    assert values(L.fill_value(df, "s", "z")) == ["z", "x", " ", "z", "y", "z"]


def test_counts(spark):
    df = spark.createDataFrame([(1.0, " "), (float("nan"), "a")], "v double, s string")
    assert {r["column"]: r["missing"] for r in L.missing_counts(df).collect()} == {"v": 1, "s": 1}
    assert [r["column"] for r in L.fill_targets(df, ["s", "v"]).collect()] == ["v"]


def test_duplicate_report_fixture(spark):
    df = spark.createDataFrame([(float(v) if v else None, "x") for v in [1, 2, 2, 3, 3, 3, None]], "id double, x string")
    r = D.duplicate_report(df, "id").first()
    assert (r["total_rows"], r["unique_count"], r["null_count"], r["duplicate_value_count"], r["duplicate_row_count"]) == (7, 3, 1, 2, 5)
    listed = [(v["value"], v["count"]) for v in D.duplicate_values(df, "id").orderBy(F.desc("count")).collect()]
    assert listed == [("3", 3), ("2", 2)]


def test_duplicates_are_per_column(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, None), (4, None)], "id long, email string")
    assert D.duplicate_report(df, ["id", "email"]).count() == 2
    assert sorted(r["id"] for r in D.duplicate_rows(df, ["id", "email"]).collect()) == [1, 1, 2]
    assert D.duplicate_rows(df, ["email"], dropna=False).count() == 4
    with pytest.raises(ValueError):
        D.duplicate_rows(df, ["gone"])


def test_drop_duplicates(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, 1.0)], "id long, v double")
    assert sorted(r["id"] for r in D.drop_duplicates(df, "v", "id").collect()) == [0, 1]
    assert D.drop_duplicates(df.select("v")).count() == 2


def _brute(points, k):
    n, d = points.shape
    out = points.copy()
    for i in range(n):
        for j in np.flatnonzero(np.isnan(points[i])):
            near = []
            for q in range(n):
                shared = ~np.isnan(points[i]) & ~np.isnan(points[q])
                if not np.isnan(points[q, j]) and shared.any():
                    near.append((((points[i, shared] - points[q, shared]) ** 2).sum() * d / shared.sum(), points[q, j]))
            if not near:
                out[i, j] = np.nanmean(points[:, j])
                continue
            near.sort()
            left, total = k, 0.0
            for _, ring in groupby(near, key=lambda x: x[0]):
                ring = [v for _, v in ring]
                take = min(left, len(ring))
                total += np.mean(ring) * take
                left -= take
                if left <= 0:
                    break
            out[i, j] = total / (k - left)
    return out


@pytest.mark.parametrize("block", [12, 2000])
def test_knn_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(impute, "BLOCK_POINTS", block)
    monkeypatch.setattr(impute, "QUERY_CHUNK", 10)
    rng = np.random.default_rng(3)
    full = rng.integers(0, 12, size=(90, 3)).astype(float)  # many ties and copies
    holes = rng.random(full.shape) < 0.2
    points = np.where(holes, np.nan, full)
    df = spark.createDataFrame(
        [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(points)], "id long, a double, b double, c double")
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in impute.fill_knn(df, ["a", "b", "c"], neighbours=4).collect()}
    want = _brute(points, 4)
    assert len(got) == 90
    assert max(abs(got[i][j] - want[i, j]) for i in range(90) for j in range(3)) < 1e-9


def test_knn_fixture_and_limits(spark):
    df = spark.createDataFrame([(20.0, 80), (30.0, 90), (None, 70), (40.0, 85), (200.0, 95)], "age double, score long")
    filled = impute.fill_knn(df, ["age", "score"], neighbours=2)
    assert filled.where("age is null").count() == 0 and dict(filled.dtypes)["score"] == "bigint"
    with pytest.raises(ValueError):
        impute.fill_knn(df.withColumn("s", F.lit("x")), ["s"])


def test_mice_recovers_a_linear_relation(spark):
    rows = [(i, float(i % 17), 2.0 * (i % 17) + 1 if i % 5 else None, float((i * 7) % 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r["id"]: r["b"] for r in impute.fill_mice(df, ["a", "b", "c"]).collect()}
    assert all(abs(got[i] - (2.0 * (i % 17) + 1)) < 1e-3 for i in range(120))
    whole = df.select("id", "a")
    assert impute.fill_mice(whole, ["a"]).collect() == whole.collect()


def test_mice_with_columns_that_repeat_each_other(spark):
    rows = [(float(i), 2.0 * i, 7.0, 3.0 * i + 1 if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, y double")
    got = impute.fill_mice(df, ["a", "b", "flat", "y"], max_iter=2).orderBy("a").collect()
    assert all(abs(r["y"] - (3.0 * r["a"] + 1)) < 1e-2 for r in got)
