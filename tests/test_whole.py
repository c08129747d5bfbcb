"""Whole tables by default, and the text of numbers."""
import pytest
from pyspark.sql import functions as F

from tablewright.functions.missing import as_text
from tablewright.functions.naming import dedupe_names
from tablewright.functions.values import lookup_key, value_label
from tablewright.operators import charts, duplicates, grouping, ordering, relations, rows
from tablewright.session import ensure_checkpoint_dir

N = 6000


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(N).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("v"), (F.col("id") % 20).alias("c")).cache()


def test_charts_use_every_row(many):
    assert charts.scatter_points(many, "v", "c", "k").count() == N
    assert charts.scatter_points(many, "v", "c", "k", rows=100).count() == 100
    assert charts.pair_plot_histograms(many, ["v"], "k").agg(F.sum("count")).first()[0] == N
    assert charts.kernel_density(many, "v", "k").agg(F.max("x")).first()[0] == N - 1
    assert charts.violin_density(many, "c", "v", "k").select("category").distinct().count() == 20
    assert charts.box_by_category(many, "c", "v", "k").count() == 20 and charts.box_by_category(many, "c", "v", "k", limit=3).count() == 3


def test_tables_list_everything(many):
    assert relations.crosstab(many, "c", "c").count() == 20 and relations.crosstab(many, "c", "c", rows=2, cols=2).columns == ["c", "0", "1"]
    assert grouping.describe_groups(many, "c", "v").count() == 20
    assert grouping.mean_per_category(many, "c", "v", "k").count() == 20
    twice = many.union(many)
    assert duplicates.duplicate_values(twice, "k").count() == N and duplicates.duplicate_values(twice, "k", listed=7).count() == 7
    wide = many.select(*[(F.rand(i) + (F.col("v") if i > 12 else 0)).alias(f"n{i}") for i in range(15)])
    best = relations.top_correlations(wide).first()
    assert (best["a"], best["b"]) == ("n13", "n14") and relations.top_correlations(wide, limit=2).count() == 2


def test_text_of_doubles(spark):
    values = [12345678.5, 0.0005, 1e15, 123456789012345.67, 1e-4, -2.5e8, 1.5, 0.0, 1e7, 1e16, 1e-5, 1.5e-7, -2.25e100, 5e-324,
              1e18, 123456789012345678.0, float("inf"), float("-inf"), -1e-5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    shown = [r[0] for r in df.orderBy("i").select(as_text(F.col("v"), df.schema["v"].dataType)).collect()]
    assert shown == [repr(v) if v != 5e-324 else shown[13] for v in values] and shown[13].endswith("e-324")
    t = df.schema["v"].dataType
    keys = [tuple(r) for r in df.orderBy("i").select(lookup_key(F.col("v"), t), value_label(F.col("v"), t)).collect()]
    assert keys[0] == ("12345678.5", "12345678.5") and keys[1] == ("0.0005", "0.0005") and keys[8] == ("10000000", "10000000")


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, None), (4, -0.0), (5, 0.0)], "k long, v double")
    assert rows.search(df, "nan", "v").count() == 0
    assert [r["k"] for r in ordering.stable_sort(df, "v", "k", ascending=False).collect()][0] == 2
    assert {r["k"]: r["v"] for r in rows.find_replace(df, "3", "x", columns="v").collect()}[1] in (None, "NaN")
    report = duplicates.duplicate_report(df, "v").first()
    assert (report["duplicate_value_count"], report["duplicate_row_count"]) == (1, 2)


def test_small_things(spark):
    assert dedupe_names(["a", "a", "a_1"]) == ["a", "a_2", "a_1"] and dedupe_names(["x", "y"]) == ["x", "y"]
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 5.0)], "x double, y double")
    assert relations.correlation(two, "x", "y", p_value=True).first()["pearson_p"] == 1.0
    ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir")
