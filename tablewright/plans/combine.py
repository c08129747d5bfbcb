"""Join, lookup, stacking, grouping and sorting queries."""
from pyspark.sql import functions as F

from ..operators import grouping as G, joins as J
from ..operators.ordering import stable_sort
from ..operators.rows import search
from .registry import GAPPY_SQL, LINE_KEY, gappy_orders, query, rounded, table


@query("flagship", """
    SELECT o_orderpriority, round(sum(l_extendedprice), 2) AS l_extendedprice
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE contains(lower(l_returnflag), 'r')
    GROUP BY o_orderpriority ORDER BY 1""")
def flagship(spark, d):
    returned = search(table(spark, d, "lineitem"), "R", "l_returnflag")
    joined = J.join_tables(returned, table(spark, d, "orders"), "l_orderkey", "o_orderkey")
    return rounded(G.group_summary(joined, "o_orderpriority", "l_extendedprice", "sum"), 2, "l_extendedprice")


@query("join_inner", """
    SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) o
    JOIN (SELECT c_custkey, c_name FROM customer) c ON o_custkey = c_custkey""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return J.join_tables(o, c, "o_custkey", "c_custkey").select("o_orderkey", "c_custkey", "c_name", "o_totalprice")


_GROUPS = "(SELECT o_custkey AS k, nullif(o_orderstatus, 'P') AS s, o_totalprice AS v FROM orders)"
_SIDE = "(SELECT c_custkey AS k, nullif(c_mktsegment, 'BUILDING') AS s, c_acctbal AS v FROM customer WHERE c_acctbal > 0)"


def _sides(spark, d):
    left = table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.col("o_totalprice").alias("v"))
    right = table(spark, d, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("k"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"), F.col("c_acctbal").alias("v"))
    return left, right


def _join(how: str, sql_how: str):
    @query(f"join_{how}_suffixes", f"""
        SELECT coalesce(a.k, b.k) AS k, a.s AS s_left, a.v AS v_left, b.s AS s_right, b.v AS v_right
        FROM {_GROUPS} a {sql_how} JOIN {_SIDE} b ON a.k IS NOT DISTINCT FROM b.k""")
    def _(spark, d):
        left, right = _sides(spark, d)
        return J.join_tables(left, right, "k", "k", how)


_join("left", "LEFT")
_join("right", "RIGHT")
_join("outer", "FULL")


@query("join_null_keys", """
    SELECT a.r AS a, b.r AS b FROM (SELECT r_regionkey AS r, nullif(r_regionkey, 2) AS k FROM region) a
    JOIN (SELECT n_nationkey AS r, nullif(n_regionkey, 2) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k""")
def _(spark, d):
    a = table(spark, d, "region").select(F.col("r_regionkey").alias("a"), F.nullif("r_regionkey", F.lit(2)).alias("k"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("b"), F.nullif("n_regionkey", F.lit(2)).alias("k"))
    return J.join_tables(a, b, "k", "k").select("a", "b")


@query("join_two_keys", """
    SELECT s_suppkey, c_custkey FROM supplier JOIN customer
    ON s_nationkey = c_nationkey AND floor(s_acctbal / 100) = floor(c_acctbal / 100)""")
def _(spark, d):
    bucket = lambda c: F.floor(F.col(c) / 100).alias("b")
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), bucket("s_acctbal"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), bucket("c_acctbal"))
    return J.join_tables(s, c, ["n", "b"], ["n", "b"]).select("s_suppkey", "c_custkey")


@query("lookup_column", """
    SELECT o_orderkey, o_custkey, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("double").alias("id"), "c_name")
    return J.lookup_column(o, c, "o_custkey", "id", "c_name", "id", "customer")


@query("lookup_first_match", """
    SELECT c_custkey, o_orderkey AS first_order FROM customer LEFT JOIN (
        SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) o
    ON c_custkey = o_custkey""")
def _(spark, d):
    return J.lookup_column(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"),
                           "c_custkey", "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"], "first_order")


@query("lookup_overwrite", """
    SELECT n_nationkey, r_name AS n_name, n_regionkey FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(spark, d):
    return J.lookup_column(table(spark, d, "nation"), table(spark, d, "region"), "n_regionkey", "r_regionkey",
                           "r_name", "r_regionkey", "n_name")


@query("lookup_stats", """
    SELECT count(*) AS total, count(l_orderkey) AS matched, count(*) - count(l_orderkey) AS unmatched
    FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) l ON o_orderkey = l_orderkey""")
def _(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 45")
    return J.lookup_stats(table(spark, d, "orders"), big, "o_orderkey", "l_orderkey")


@query("enrich", """
    SELECT c_custkey, c_name, o_orderkey, o_orderstatus, c_name AS c_name_crawl FROM (SELECT c_custkey, c_name FROM customer) c
    LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) o ON c_custkey = o_custkey"""
       .replace("c_name AS c_name_crawl", "o_orderpriority AS c_name_crawl")
       .replace("o_orderkey, o_orderstatus FROM orders", "o_orderkey, o_orderstatus, o_orderpriority FROM orders"))
def _(spark, d):
    o = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("c_name"))
    return J.enrich(table(spark, d, "customer").select("c_custkey", "c_name"), o, "c_custkey", "o_custkey", "o_orderkey")


@query("stack_tables", """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    return J.stack_tables([c, s])


@query("stack_tables_numbered", """
    SELECT id, name, row_number() OVER (ORDER BY t, id) AS row_no FROM (
        SELECT c_custkey AS id, c_name AS name, 0 AS t FROM customer
        UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier) x""")
def _(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name")
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS id", "s_name AS name")
    return J.stack_tables([c, s], order_by="id", number="row_no")


@query("join_preview", "SELECT count(*) AS rows FROM (SELECT * FROM nation LIMIT 50) n JOIN (SELECT * FROM region LIMIT 50) r ON n_regionkey = r_regionkey")
def _(spark, d):
    return J.join_preview(table(spark, d, "nation"), table(spark, d, "region"), "n_regionkey", "r_regionkey").agg(
        F.count(F.lit(1)).alias("rows"))


@query("stack_preview", "SELECT (SELECT least(50, count(*)) FROM nation) + (SELECT least(50, count(*)) FROM customer) AS rows")
def _(spark, d):
    return J.stack_preview([table(spark, d, "nation"), table(spark, d, "customer")]).agg(
        F.count(F.lit(1)).alias("rows"))


@query("lookup_preview", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    return J.lookup_preview(table(spark, d, "nation"), table(spark, d, "region"), "n_regionkey", "r_regionkey",
                            "r_name", "r_regionkey").select("n_nationkey", "r_name")


# ---------------------------------------------------------------- groups

def _group(agg: str, sql: str):
    @query(f"group_{agg}", f"""
        SELECT l_returnflag, l_linestatus, round({sql}, 4) AS l_extendedprice FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2""")
    def _(spark, d):
        out = G.group_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", agg)
        return rounded(out, 4, "l_extendedprice")


_group("mean", "avg(l_extendedprice)")
_group("min", "min(l_extendedprice)")
_group("max", "max(l_extendedprice)")
_group("std", "stddev_samp(l_extendedprice)")
_group("median", "median(l_extendedprice)")


@query("group_sum", """
    SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2""")
def _(spark, d):
    out = G.group_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "sum")
    return rounded(out, 2, "l_extendedprice")


@query("group_count", """
    SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2""")
def _(spark, d):
    return G.group_summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "count")


@query("group_nunique", "SELECT l_returnflag, count(DISTINCT l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def _(spark, d):
    return G.group_summary(table(spark, d, "lineitem"), "l_returnflag", "l_partkey", "nunique")


@query("group_first", """
    SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def _(spark, d):
    return G.group_summary(table(spark, d, "orders"), "o_custkey", "o_orderkey", "first", order_by=["o_orderdate", "o_orderkey"])


@query("group_null_key_sum", """
    SELECT nullif(o_orderpriority, '5-LOW') AS p, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'
        THEN o_totalprice END), 0), 2) AS v FROM orders GROUP BY 1""")
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW"), F.col("o_totalprice")).alias("v"))
    return rounded(G.group_summary(o, "p", "v", "sum"), 2, "v")


@query("group_median_by_part", "SELECT l_partkey, round(median(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(G.group_summary(table(spark, d, "lineitem"), "l_partkey", "l_extendedprice", "median"), 4, "l_extendedprice")


@query("stable_sort", f"SELECT * FROM {GAPPY_SQL} g ORDER BY o_totalprice DESC NULLS LAST, o_orderkey")
def _(spark, d):
    return stable_sort(gappy_orders(spark, d), "o_totalprice", "o_orderkey", ascending=False)


@query("describe_groups", """
    SELECT p_brand AS "group", count(p_retailprice) AS count, round(avg(p_retailprice), 4) AS mean,
           round(stddev_samp(p_retailprice), 4) AS std, round(median(p_retailprice), 4) AS median
    FROM part GROUP BY 1""")
def _(spark, d):
    return rounded(G.describe_groups(table(spark, d, "part"), "p_brand", "p_retailprice"), 4, "mean", "std", "median")


@query("top_values", f"""
    SELECT p_brand AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM part), 6) AS pct
    FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(spark, d):
    return rounded(G.top_values(table(spark, d, "part"), "p_brand"), 6, "pct")


@query("top_values_with_other", """
    WITH c AS (SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1),
         r AS (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS n FROM c)
    SELECT CASE WHEN n > 10 THEN '기타' ELSE value END AS value, CAST(sum(count) AS BIGINT) AS count FROM r GROUP BY 1""")
def _(spark, d):
    return G.top_values_with_other(table(spark, d, "part"), "p_brand", 10)


@query("mean_per_category", """
    SELECT p_brand AS category, round(avg(p_retailprice), 4) AS mean FROM part GROUP BY 1 ORDER BY min(p_partkey)""")
def _(spark, d):
    return rounded(G.mean_per_category(table(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey"), 4, "mean")
