import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import charts as K, outliers as O, profile as P, relations as R, report as T


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(20.0, "서울", 80), (30.0, "부산", 90), (None, "서울", 70), (40.0, None, 85), (200.0, "대구", 95)],
        "age double, city string, score long")


def test_kinds(people, spark):
    assert P.column_kinds(people) == {"age": "numeric", "city": "categorical", "score": "numeric"}
    wide = spark.range(40).select(F.col("id").cast("string").alias("s"), (F.col("id") > 3).alias("b"), F.current_date().alias("d"))
    assert P.column_kinds(wide) == {"s": "other", "b": "categorical", "d": "datetime"}
    assert P.default_column(people) == "age" and P.default_pair(people) == ("age", "score")


def test_overview(people):
    rows = {r["column"]: r for r in P.column_overview(people).collect()}
    assert rows["age"]["null_count"] == 1 and rows["age"]["null_pct"] == 20.0 and rows["age"]["unique_count"] == 4
    assert rows["age"]["mean"] == 72.5 and rows["city"]["mean"] is None
    approx = {r["column"]: r["unique_count"] for r in P.column_overview(people, approx=True).collect()}
    assert approx == {"age": 4, "city": 3, "score": 5}


def test_single_value_has_no_spread(spark):
    df = spark.createDataFrame([(5.0,), (None,)], "v double")
    assert P.column_overview(df).first()["std"] == 0.0
    r = P.numeric_summary(df).first()
    assert (r["count"], r["std"], r["variance"], r["iqr"]) == (1, 0.0, 0.0, 0.0)


def test_correlations(people, spark):
    m = R.correlation_matrix(people)
    assert m.count() == 2 and abs(m.first()["age"] - 1) < 1e-12
    assert R.correlation_matrix(people.select("age")).count() == 0
    x = np.array([1, 2, 2, 4, 5, 6.0]); y = np.array([2, 1, 3, 3, 6, 5.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = R.correlation(df, "x", "y", p_value=True).first()
    r = np.corrcoef(x, y)[0, 1]
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert abs(got["pearson_r"] - r) < 1e-12
    assert abs(got["spearman_r"] - np.corrcoef(rank(x), rank(y))[0, 1]) < 1e-12
    # Two-sided p of t = r * sqrt((n - 2) / (1 - r^2)) with 4 degrees of freedom, in closed form.
    t = r * math.sqrt(4 / (1 - r * r))
    u = t / math.sqrt(4 + t * t)
    assert abs(got["pearson_p"] - (1 - 1.5 * (u - u ** 3 / 3))) < 1e-9
    assert R.correlation(df.limit(1), "x", "y").count() == 0


def test_crosstab_with_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 1.0)], "s string, v double")
    got = {r["s"]: (r["1.0"], r["nan"]) for r in R.crosstab(df, "s", "v").collect()}
    assert got == {"a": (1, 1), "None": (1, 0)}


def test_pca(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(60, 3)) @ np.array([[3, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)] + [(99, None, 1.0, 1.0)], "id long, a double, b double, c double")
    scores, ratio = R.principal_components(df, ["a", "b", "c"], keep=["id"])
    centred = data - data.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(ratio, (s ** 2 / (s ** 2).sum())[:2])
    got = np.array([[r["PC1"], r["PC2"]] for r in scores.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)
    assert R.principal_components(df, ["a"]) is None
    assert R.principal_components(df.limit(2), ["a", "b"]) is None


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=500).round(3)
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    got = [r["count"] for r in K.histogram(df, "v", 12).orderBy("bin").collect()]
    assert got == np.histogram(v, bins=12)[0].tolist()
    flat = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert sum(r["count"] for r in K.histogram(flat, "v", 4).collect()) == 3
    assert (K.auto_bins(50, 40), K.auto_bins(500, 40), K.auto_bins(5000, 40)) == (10, 25, 40)


def test_box_and_line(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in [1, 2, 3, 4, 100]], "x double, y double")
    b = K.box_stats(df, "x").first()
    assert (b["q1"], b["median"], b["q3"], b["whisker_low"], b["whisker_high"], b["fliers"]) == (2, 3, 4, 1, 4, 1)
    line = K.fitted_line(df, "x", "y").first()
    assert abs(line["slope"] - 2) < 1e-12 and abs(line["intercept"] - 1) < 1e-9


def test_hexbin_keeps_every_point(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert K.hexbin(p, "p_size", "p_retailprice").agg(F.sum("count")).first()[0] == p.count()


def test_outliers(people, spark):
    assert O.outlier_summary(people, ["age"], "iqr").first()["count"] == 1
    kept, removed, flagged = O.split_outliers(people, ["age", "city"])
    assert removed == 1 and kept.count() == 4 and flagged.count() == 5
    few = spark.createDataFrame([(1.0,), (2.0,), (99.0,)], "v double")
    assert O.with_outlier_flag(few, ["v"]).where("is_outlier").count() == 0
    flat = spark.createDataFrame([(1.0,)] * 9 + [(50.0,)], "v double")
    assert O.with_outlier_flag(flat, ["v"]).where("is_outlier").count() == 0
    assert O.with_outlier_flag(flat, ["v"], "zscore", z_threshold=2.5).where("is_outlier").count() == 1
    assert O.with_outlier_flag(people, ["city"]).where("is_outlier").count() == 0
    with pytest.raises(ValueError):
        O.with_outlier_flag(people, ["age"], "guess")


def test_isolation_forest_finds_far_points(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(size=(300, 2))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(near)]
    rows += [(1000 + i, 9.0 + i, -9.0 - i) for i in range(6)] + [(2000, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    flagged = O.with_outlier_flag(df, ["a", "b"], "isolation_forest", contamination=0.02, order_by="id")
    hit = {r["id"] for r in flagged.where("is_outlier").collect()}
    assert len(hit) == 7 and {1000 + i for i in range(6)} <= hit
    again = O.with_outlier_flag(df.repartition(5), ["a", "b"], "isolation_forest", contamination=0.02, order_by="id")
    assert {r["id"] for r in again.where("is_outlier").collect()} == hit
    assert O.with_outlier_flag(df.limit(5), ["a", "b"], "isolation_forest", order_by="id").where("is_outlier").count() == 0


def test_report(people):
    report = T.Report(people)
    k = report.kpis.first()
    assert (k["rows"], k["columns"], k["numeric_columns"], k["categorical_columns"], k["missing_columns"]) == (5, 3, 2, 1, 2)
    assert {r["fact"] for r in report.insights.collect()} >= {"shape", "most_missing", "strongest_correlation", "most_outliers"}
    assert report.categories.count() == 3 and report.correlations.count() == 1
    assert [r["column"] for r in report.category_charts.collect()] == ["city"]
