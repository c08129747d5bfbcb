"""Projection and column-shape queries."""
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators.fill import fill_missing
from .registry import GAPPY_SQL, gappy_orders, query, rounded, table


@query("select_columns", "SELECT c_name, c_custkey FROM customer")
def _(spark, d):
    return C.select_columns(table(spark, d, "customer"), ["c_name", "c_custkey", "c_name", "unknown"])


@query("convert_text_to_int", """
    SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS brand_no FROM part""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("")).alias("brand_no"))
    return C.convert_type(p, "brand_no", "int64")


@query("convert_unreadable_to_int", "SELECT p_partkey, CAST(NULL AS BIGINT) AS p_brand FROM part")
def _(spark, d):
    return C.convert_type(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "int")


@query("convert_float_to_int", """
    SELECT o_orderkey, CAST(round_even(o_totalprice / 1000, 0) AS BIGINT) AS thousands FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("thousands"))
    return C.convert_type(o, "thousands", "int64")


@query("convert_to_float", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part")
def _(spark, d):
    return C.convert_type(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "float64")


@query("convert_to_text", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size FROM part")
def _(spark, d):
    return C.convert_type(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "object")


@query("convert_to_bool", """
    SELECT doc_id, CASE quality WHEN 1 THEN true WHEN 0 THEN false END AS quality FROM labels""")
def _(spark, d):
    return C.convert_type(table(spark, d, "labels").select("doc_id", "quality"), "quality", "bool")


@query("convert_to_datetime", """
    SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'F' THEN 'unknown'
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP) AS day FROM orders""")
def _(spark, d):
    text = F.when(F.col("o_orderstatus") == "F", "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return C.convert_type(table(spark, d, "orders").select("o_orderkey", text.alias("day")), "day", "datetime")


@query("rename_column", "SELECT n_nationkey, n_name AS nation, n_regionkey FROM nation")
def _(spark, d):
    return C.rename_column(table(spark, d, "nation"), "n_name", "nation")


@query("delete_columns", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    return C.delete_columns(table(spark, d, "customer"), ["c_acctbal", "c_nationkey", "unknown"])


@query("add_column", "SELECT *, 'new' AS status FROM supplier")
def _(spark, d):
    return C.add_column(table(spark, d, "supplier"), "status", "new")


@query("insert_column", "SELECT s_suppkey, 7 AS rating, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark, d):
    return C.insert_column(table(spark, d, "supplier"), "s_name", "left", "rating", 7)


@query("append_column", 'SELECT *, CAST(NULL AS VARCHAR) AS "새열" FROM nation')
def _(spark, d):
    return C.append_column(table(spark, d, "nation"))


@query("duplicate_column", "SELECT *, s_acctbal AS s_acctbal_copy FROM supplier")
def _(spark, d):
    return C.duplicate_column(table(spark, d, "supplier"), "s_acctbal")


@query("move_column", "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def _(spark, d):
    return C.move_column(table(spark, d, "customer"), "c_mktsegment", "c_custkey")


@query("merge_columns", f"""
    SELECT o_orderkey, o_custkey, o_orderstatus || '/' || CASE WHEN trim(o_orderpriority) = '' THEN ''
        ELSE o_orderpriority END AS label, o_totalprice, o_orderdate FROM {GAPPY_SQL} g""")
def _(spark, d):
    return C.merge_columns(gappy_orders(spark, d), ["o_orderpriority", "o_orderstatus"], "label", separator="/")


@query("merge_columns_keep", """
    SELECT p_partkey, CAST(p_size AS VARCHAR) || ' ' || p_brand AS tag, p_brand, p_size FROM (
        SELECT p_partkey, p_size, p_brand FROM part) p""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    return C.merge_columns(p, ["p_size", "p_brand"], "tag", separator=" ", drop_sources=False)


@query("split_column", """
    SELECT p_partkey, nullif(split_part(p_name, ' ', 1), '') AS word_1,
           nullif(split_part(p_name, ' ', 2), '') AS word_2, p_name FROM part""")
def _(spark, d):
    return C.split_column(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", " ", prefix="word")


@query("split_column_drop_source", """
    SELECT o_orderkey, nullif(split_part(p, '-', 1), '') AS o_orderpriority_1,
           nullif(split_part(p, '-', 2), '') AS o_orderpriority_2
    FROM (SELECT o_orderkey, CASE WHEN o_orderpriority NOT LIKE '4%' THEN o_orderpriority END AS p FROM orders) o""")
def _(spark, d):
    o = gappy_orders(spark, d).select("o_orderkey", "o_orderpriority")
    return C.split_column(o, "o_orderpriority", "-", drop_source=True)


@query("separator_escape", r"""
    SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents""")
def _(spark, d):
    sep = C.read_separator(r"\n")
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", sep, -1)).cast("bigint").alias("lines"))


@query("clear_columns", """
    SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment
    FROM customer""")
def _(spark, d):
    return C.clear_columns(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"])


@query("fill_sequence", """
    SELECT o_orderkey, o_orderdate,
           100 + 5 * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS o_custkey FROM orders""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    return C.fill_sequence(o, "o_custkey", ["o_orderdate", "o_orderkey"], start=100, step=5)


@query("fill_methods", f"""
    SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {GAPPY_SQL} g)), 4) AS o_totalprice,
           CASE WHEN trim(coalesce(o_orderpriority, '')) = '' THEN (
               SELECT o_orderpriority FROM {GAPPY_SQL} g WHERE trim(o_orderpriority) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
           ELSE o_orderpriority END AS o_orderpriority FROM {GAPPY_SQL} o""")
def _(spark, d):
    """Each column filled by the first method that it offers."""
    o = gappy_orders(spark, d).select("o_orderkey", "o_totalprice", "o_orderpriority")
    for c in ("o_totalprice", "o_orderpriority"):
        o = fill_missing(o, c, C.fill_methods(o, c)[0], order_by="o_orderkey")
    return rounded(o, 4, "o_totalprice")
