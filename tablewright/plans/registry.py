"""Named queries over the given tables, each with an equivalent DuckDB statement where there is one."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round away the order noise of floating sums before results are compared."""
    return df.withColumns({n: F.round(n, digits) for n in names})


# Orders with gaps made from their own values: no price while pending, a blank priority where none is stated.
GAPPY_SQL = """(
    SELECT o_orderkey, o_custkey, o_orderstatus,
           CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, o_orderdate,
           CASE WHEN o_orderpriority LIKE '4%' THEN '  ' ELSE o_orderpriority END AS o_orderpriority
    FROM orders)"""


def gappy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumns({
        "o_totalprice": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")),
        "o_orderpriority": F.when(F.col("o_orderpriority").startswith("4"), "  ").otherwise(F.col("o_orderpriority")),
    })


# Line items with gaps: no discount or tax where it is zero.
GAPPY_LINES_SQL = """(
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
           nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, l_returnflag
    FROM lineitem)"""
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def gappy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        *LINE_KEY[:1], "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        "l_returnflag")
