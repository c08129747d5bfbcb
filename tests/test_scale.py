"""Order, quantile and skew primitives with small limits, so that the many-range paths run."""
from pyspark.sql import Window, functions as F

from tablewright.operators import ordering, quantiles, skew


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def test_row_numbers_over_many_ranges(spark, sf_dir):
    o = _orders(spark, sf_dir)
    key = ["o_orderdate", "o_orderkey"]
    got = ordering.with_row_number(o, key, "n", rows_per_range=100)
    want = o.select("o_orderkey", F.row_number().over(Window.orderBy(*key)).alias("w"))
    assert got.join(want, "o_orderkey").where("n <> w").count() == 0
    assert got.count() == o.count()


def test_running_total_over_many_ranges(spark, sf_dir):
    o = _orders(spark, sf_dir)
    got = ordering.with_running_total(o, "o_orderkey", F.col("o_custkey"), "s", rows_per_range=200)
    want = o.select("o_orderkey", F.sum("o_custkey").over(Window.orderBy("o_orderkey")).alias("w"))
    assert got.join(want, "o_orderkey").where("s <> w").count() == 0


def test_carried_over_many_ranges(spark, sf_dir):
    # Values are rare enough to leave whole ranges empty.
    o = _orders(spark, sf_dir).withColumn("p", F.when(F.col("o_totalprice") > 495000, F.col("o_totalprice")))
    for forward in (True, False):
        got = ordering.carried(o, "p", "o_orderkey", forward=forward, rows_per_range=50)
        order = F.asc("o_orderkey") if forward else F.desc("o_orderkey")
        w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        want = o.select("o_orderkey", F.last("p", True).over(w).alias("w"))
        assert got.join(want, "o_orderkey").where("not p <=> w").count() == 0
    both = ordering.carried(o, "p", "o_orderkey", both_ways=True, rows_per_range=50)
    assert both.where("p is null").count() == 0


def test_quantiles_match_exact_ones(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    got = quantiles.column_quantiles(l, names, probs)
    want = l.agg(*[F.percentile(c, probs) for c in names]).first()
    for c, w in zip(names, want):
        assert all(abs(a - b) < 1e-6 for a, b in zip(got[c], w)), c


def test_quantiles_of_awkward_columns(spark):
    rows = [(1.0, None, 5.0), (1.0, None, float("nan")), (1.0, None, 1e300), (2.0, None, -1e300)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = quantiles.column_quantiles(df, ["a", "b", "c"], [0.5, 1.0])
    assert got == {"a": [1.0, 2.0], "b": [None, None], "c": [5.0, 1e300]}


def test_quantiles_of_extreme_ranges(spark):
    up = float("inf")
    rows = [(5e-324, -up, 1.0), (0.0, 1.0, 1.0000000000000002), (5e-324, 2.0, 1.0), (1e-323, up, 1.0000000000000002)]
    df = spark.createDataFrame(rows, "tiny double, endless double, close double")
    got = quantiles.column_quantiles(df, ["tiny", "endless", "close"], [1 / 3, 2 / 3])
    assert got == {"tiny": [5e-324, 5e-324], "endless": [1.0, 2.0], "close": [1.0, 1.0000000000000002]}
    wide = spark.range(400).select(F.pow(F.lit(2.0), F.col("id") - 200).alias("v"))
    assert quantiles.column_quantiles(wide, ["v"], [0.0, 100 / 399, 1.0])["v"] == [2.0 ** -200, 2.0 ** -100, 2.0 ** 199]


def test_group_quantiles_with_a_hot_group_over_ranges(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # One group with most rows, one NULL group, many small ones.
    l = l.withColumn("g", F.when(F.col("l_quantity") > 15, 0).when(F.col("l_quantity") > 10, None).otherwise(F.col("l_partkey")))
    want = {r["g"]: (r["m"], r["q"]) for r in l.groupBy("g").agg(
        F.percentile("l_extendedprice", 0.5).alias("m"), F.percentile("l_extendedprice", 0.9).alias("q")).collect()}
    for per_range in (300, 1_000_000):
        got = quantiles.group_quantiles(l, ["g"], "l_extendedprice", [0.5, 0.9], rows_per_range=per_range).collect()
        assert len(got) == len(want)
        for r in got:
            assert abs(r["q0"] - want[r["g"]][0]) < 1e-6 and abs(r["q1"] - want[r["g"]][1]) < 1e-6


def test_group_quantiles_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "g string, v double")
    assert {r["g"]: r["q0"] for r in quantiles.group_quantiles(df, ["g"], "v", [0.5]).collect()} == {"a": 1.5, "b": None}


def test_salted_lookup_equals_plain_lookup(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.when(F.col("l_quantity") > 20, 1).when(F.col("l_quantity") > 18, None)
        .otherwise(F.col("l_partkey")).cast("bigint").alias("k"), "l_orderkey", "l_extendedprice")
    lookup = l.groupBy("k").agg(F.max("l_orderkey").alias("top")).where("k is null or k < 50")
    salts = skew.hot_key_salts(l, F.xxhash64("k"))
    assert salts[spark.range(1).select(F.xxhash64(F.lit(1).cast("bigint"))).first()[0]] > 1
    for null_safe in (False, True):
        plain = skew.join_lookup(l, lookup, ["k"], salts={}, null_safe=null_safe)
        salted = skew.join_lookup(l, lookup, ["k"], salts=salts, null_safe=null_safe)
        assert salted.count() == l.count()
        assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0


def test_first_per_key_limits_before_the_shuffle(spark, sf_dir):
    firsts = skew.first_per_key(_orders(spark, sf_dir), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    assert "WindowGroupLimit" in firsts._jdf.queryExecution().toString()
