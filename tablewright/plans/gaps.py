"""Fill and duplicate queries."""
from pyspark.sql import functions as F

from ..operators import duplicates as D, fill as L, impute
from .registry import GAPPY_LINES_SQL, GAPPY_SQL, LINE_KEY, gappy_lines, gappy_orders, query, rounded, table


def _prices(spark, d):
    return gappy_orders(spark, d).select("o_orderkey", "o_totalprice")


@query("fill_forward", f"""
    SELECT o_orderkey, last_value(o_totalprice IGNORE NULLS) OVER (ORDER BY o_orderkey) AS o_totalprice FROM {GAPPY_SQL} g""")
def _(spark, d):
    return L.fill_direction(_prices(spark, d), "o_totalprice", "o_orderkey")


@query("fill_backward", f"""
    SELECT o_orderkey, first_value(o_totalprice IGNORE NULLS) OVER (
        ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS o_totalprice FROM {GAPPY_SQL} g""")
def _(spark, d):
    return L.fill_direction(_prices(spark, d), "o_totalprice", "o_orderkey", forward=False)


@query("fill_value", f"SELECT o_orderkey, coalesce(o_totalprice, -1.5) AS o_totalprice FROM {GAPPY_SQL} g")
def _(spark, d):
    return L.fill_value(_prices(spark, d), "o_totalprice", " -1.5 ")


@query("fill_missing_forward", f"""
    SELECT o_orderkey, coalesce(last_value(p IGNORE NULLS) OVER (ORDER BY o_orderkey),
        first_value(p IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS o_orderpriority
    FROM (SELECT o_orderkey, nullif(trim(o_orderpriority), '') AS p FROM {GAPPY_SQL} g) x""")
def _(spark, d):
    o = gappy_orders(spark, d).select("o_orderkey", "o_orderpriority")
    return L.fill_missing(o, "o_orderpriority", "ffill", order_by="o_orderkey")


@query("fill_missing_backward", f"""
    SELECT o_orderkey, coalesce(first_value(p IGNORE NULLS) OVER (
            ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        last_value(p IGNORE NULLS) OVER (ORDER BY o_orderkey)) AS o_orderpriority
    FROM (SELECT o_orderkey, nullif(trim(o_orderpriority), '') AS p FROM {GAPPY_SQL} g) x""")
def _(spark, d):
    o = gappy_orders(spark, d).select("o_orderkey", "o_orderpriority")
    return L.fill_missing(o, "o_orderpriority", "bfill", order_by="o_orderkey")


def _scalar(method: str, sql: str):
    @query(f"fill_missing_{method}", f"""
        SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT {sql} FROM {GAPPY_SQL} h)), 4) AS o_totalprice FROM {GAPPY_SQL} g""")
    def _(spark, d):
        return rounded(L.fill_missing(_prices(spark, d), "o_totalprice", method), 4, "o_totalprice")


_scalar("mean", "avg(o_totalprice)")
_scalar("median", "median(o_totalprice)")
_scalar("min", "min(o_totalprice)")
_scalar("max", "max(o_totalprice)")


@query("fill_missing_mode", f"""
    SELECT o_orderkey, CASE WHEN trim(o_orderpriority) = '' THEN (
        SELECT o_orderpriority FROM {GAPPY_SQL} h WHERE trim(o_orderpriority) <> '' GROUP BY 1
        ORDER BY count(*) DESC, 1 LIMIT 1) ELSE o_orderpriority END AS o_orderpriority FROM {GAPPY_SQL} g""")
def _(spark, d):
    return L.fill_missing(gappy_orders(spark, d).select("o_orderkey", "o_orderpriority"), "o_orderpriority", "mode")


@query("fill_missing_constant", f"""
    SELECT o_orderkey, CASE WHEN trim(o_orderpriority) = '' THEN 'none' ELSE o_orderpriority END AS o_orderpriority FROM {GAPPY_SQL} g""")
def _(spark, d):
    o = gappy_orders(spark, d).select("o_orderkey", "o_orderpriority")
    return L.fill_missing(o, "o_orderpriority", "constant", constant="none")


@query("missing_counts", f"""
    SELECT 'o_totalprice' AS "column", count(*) FILTER (o_totalprice IS NULL) AS missing FROM {GAPPY_SQL} g
    UNION ALL SELECT 'o_orderpriority', count(*) FILTER (trim(o_orderpriority) = '') FROM {GAPPY_SQL} g""")
def _(spark, d):
    return L.missing_counts(gappy_orders(spark, d), ["o_totalprice", "o_orderpriority"])


@query("fill_targets", f"""
    SELECT 'l_discount' AS "column", count(*) FILTER (l_discount IS NULL) AS missing FROM {GAPPY_LINES_SQL} g
    UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax IS NULL) FROM {GAPPY_LINES_SQL} g""")
def _(spark, d):
    return L.fill_targets(gappy_lines(spark, d), ["l_discount", "l_tax", "l_returnflag"])


# Nearest neighbours in one shared coordinate: the distance is that of the quantity alone.
@query("impute_knn", f"""
    WITH g AS (SELECT l_quantity AS q, nullif(l_discount, 0) AS t FROM lineitem),
    donors AS (SELECT q, t, count(*) AS w FROM g WHERE t IS NOT NULL GROUP BY q, t),
    need AS (SELECT DISTINCT q FROM g WHERE t IS NULL),
    rings AS (SELECT n.q, abs(n.q - d.q) AS dist, sum(d.t * d.w) AS v, sum(d.w) AS w
              FROM need n JOIN donors d ON true GROUP BY 1, 2),
    placed AS (SELECT *, greatest(least(w, 5 - coalesce(sum(w) OVER (PARTITION BY q ORDER BY dist
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS take FROM rings),
    filled AS (SELECT q, sum(v / w * take) / sum(take) AS t FROM placed WHERE take > 0 GROUP BY q)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
           round(coalesce(nullif(l_discount, 0), f.t), 6) AS l_discount
    FROM lineitem LEFT JOIN filled f ON l_quantity = f.q""")
def _(spark, d):
    g = gappy_lines(spark, d).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(impute.fill_knn(g, ["l_quantity", "l_discount"]), 6, "l_discount")


# With gaps in one column only, the rounds settle on its regression on the others.
@query("impute_mice_one_column", f"""
    WITH g AS (SELECT l_quantity AS a, l_extendedprice AS b, l_tax AS y FROM {GAPPY_LINES_SQL} g WHERE l_tax IS NOT NULL),
    s AS (SELECT var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab, covar_samp(a, y) AS ay, covar_samp(b, y) AS by_,
                 avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM g),
    w AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM s)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
           round(coalesce(l_tax, my + wa * (l_quantity - ma) + wb * (l_extendedprice - mb)), 6) AS l_tax
    FROM {GAPPY_LINES_SQL} x, w""")
def _(spark, d):
    g = gappy_lines(spark, d).drop("l_discount", "l_returnflag")
    return rounded(impute.fill_mice(g, ["l_quantity", "l_extendedprice", "l_tax"]), 6, "l_tax")


def _fit(y: str, x: str, source: str) -> str:
    return f"SELECT regr_slope({y}, {x}) AS w, regr_intercept({y}, {x}) AS b FROM {source}"


# Two columns, two rounds: each is regressed on the other, the one with fewer gaps first, from the means on.
@query("impute_mice_two_columns", f"""
    WITH g AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity + 0.0 AS q,
                      CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END AS a, CASE WHEN l_linenumber <= 2 THEN NULL ELSE l_tax END AS b FROM lineitem),
    s AS (SELECT avg(a) AS ma, avg(b) AS mb FROM g),
    r0 AS (SELECT g.*, coalesce(a, ma) AS x, coalesce(b, mb) AS y FROM g, s),
    f1 AS ({_fit("a", "y", "r0 WHERE a IS NOT NULL")}), r1 AS (SELECT r0.* REPLACE (coalesce(a, b1.b + b1.w * y) AS x) FROM r0, f1 b1),
    f2 AS ({_fit("b", "x", "r1 WHERE b IS NOT NULL")}), r2 AS (SELECT r1.* REPLACE (coalesce(r1.b, b1.b + b1.w * x) AS y) FROM r1, f2 b1),
    f3 AS ({_fit("a", "y", "r2 WHERE a IS NOT NULL")}), r3 AS (SELECT r2.* REPLACE (coalesce(a, b1.b + b1.w * y) AS x) FROM r2, f3 b1),
    f4 AS ({_fit("b", "x", "r3 WHERE b IS NOT NULL")}), r4 AS (SELECT r3.* REPLACE (coalesce(r3.b, b1.b + b1.w * x) AS y) FROM r3, f4 b1)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(x, 4) AS l_extendedprice, round(y, 8) AS l_tax FROM r4""")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(F.col("l_linenumber") > 2, F.col("l_tax")).alias("l_tax"))
    filled = impute.fill_mice(lines, ["l_extendedprice", "l_tax"], max_iter=2, tolerance=0.0)
    return rounded(rounded(filled, 4, "l_extendedprice"), 8, "l_tax")


@query("impute_mice")
def _(spark, d):
    g = gappy_lines(spark, d)
    return impute.fill_mice(g, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], max_iter=3)


# ---------------------------------------------------------------- duplicates

@query("drop_duplicates_all", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark, d):
    return D.drop_duplicates(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("drop_duplicates_first", """
    SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def _(spark, d):
    return D.drop_duplicates(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])


@query("duplicate_flag", """
    SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_duplicate FROM documents""")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return D.with_duplicate_flag(docs, "text").select("doc_id", "is_duplicate")


@query("duplicate_rows_any_column", """
    SELECT * FROM events QUALIFY count(*) OVER (PARTITION BY value) > 1 OR count(*) OVER (PARTITION BY ts) > 1""")
def _(spark, d):
    return D.duplicate_rows(table(spark, d, "events"), ["value", "ts"])


@query("duplicate_flag_with_missing", f"""
    SELECT o_orderkey, count(*) OVER (PARTITION BY o_totalprice) > 1 AS is_duplicate FROM {GAPPY_SQL} g""")
def _(spark, d):
    o = gappy_orders(spark, d)
    return D.with_duplicate_flag(o, "o_totalprice", dropna=False).select("o_orderkey", "is_duplicate")


_REPORT = """
    SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS total_rows, count(v) AS unique_count,
           CAST(coalesce(sum(n) FILTER (missing), 0) AS BIGINT) AS null_count,
           count(*) FILTER (n > 1 AND NOT missing) AS duplicate_value_count,
           CAST(coalesce(sum(n) FILTER (n > 1 AND NOT missing), 0) AS BIGINT) AS duplicate_row_count
    FROM (SELECT v, n, v IS NULL OR trim(CAST(v AS VARCHAR)) = '' AS missing
          FROM (SELECT {c} AS v, count(*) AS n FROM {t} g GROUP BY 1) x) y"""


@query("duplicate_report", _REPORT.format(c="o_totalprice", t=GAPPY_SQL) + " UNION ALL "
       + _REPORT.format(c="o_orderpriority", t=GAPPY_SQL))
def _(spark, d):
    return D.duplicate_report(gappy_orders(spark, d), ["o_totalprice", "o_orderpriority"])


@query("duplicate_values", """
    SELECT 'o_custkey' AS "column", CAST(o_custkey AS VARCHAR) AS value, count(*) AS count FROM orders
    GROUP BY o_custkey HAVING count(*) > 1""")
def _(spark, d):
    return D.duplicate_values(table(spark, d, "orders"), "o_custkey")


@query("duplicate_values_label", """
    SELECT 'l_quantity' AS "column", CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value, count(*) AS count
    FROM lineitem GROUP BY l_quantity HAVING count(*) > 1""")
def _(spark, d):
    return D.duplicate_values(table(spark, d, "lineitem"), ["l_quantity"])
