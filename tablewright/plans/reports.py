"""Exploratory-report queries."""
from ..operators import report as T
from .describe import _OVERVIEW
from .registry import GAPPY_SQL, gappy_orders, query, rounded, table

_IQR_TEST = "{c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)"
_OUTLIERS = " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(*) FILTER ({_IQR_TEST.format(c=c)}) AS count,
           count(*) FILTER ({_IQR_TEST.format(c=c)}) * 100.0 / count(*) AS pct
    FROM events, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events) q"""
    for c in ("event_id", "user_id", "value"))


@query("report_kpis", f"""
    SELECT (SELECT count(*) FROM events) AS rows, 6 AS columns, 3 AS numeric_columns,
           CASE WHEN (SELECT count(DISTINCT event_type) FROM events) <= 30 THEN 1 ELSE 0 END
             + CASE WHEN (SELECT count(DISTINCT props) FROM events) <= 30 THEN 1 ELSE 0 END AS categorical_columns,
           0 AS missing_columns, (SELECT count(*) FROM ({_OUTLIERS}) o WHERE count > 0) AS outlier_columns""")
def _(spark, d):
    return T.Report(table(spark, d, "events")).kpis


@query("report_insights", f"""
    SELECT 'shape' AS fact, NULL AS subject, NULL AS other, CAST(count(*) AS DOUBLE) AS number, 6.0 AS share FROM {GAPPY_SQL} g
    UNION ALL SELECT 'most_missing', 'o_totalprice', NULL, 2.0, round(count(*) FILTER (o_totalprice IS NULL) * 100.0 / count(*), 6) FROM {GAPPY_SQL} g
    UNION ALL SELECT * FROM (SELECT 'strongest_correlation', a, b, CAST(sum(CASE WHEN abs(r) >= 0.7 THEN 1 ELSE 0 END) OVER () AS DOUBLE), round(r, 6)
        FROM (SELECT 'o_orderkey' AS a, 'o_custkey' AS b, corr(o_orderkey, o_custkey) AS r FROM {GAPPY_SQL} g
              UNION ALL SELECT 'o_orderkey', 'o_totalprice', corr(o_orderkey, o_totalprice) FROM {GAPPY_SQL} g
              UNION ALL SELECT 'o_custkey', 'o_totalprice', corr(o_custkey, o_totalprice) FROM {GAPPY_SQL} g) c
        ORDER BY abs(r) DESC, a, b LIMIT 1) s""")
def _(spark, d):
    return rounded(T.Report(gappy_orders(spark, d)).insights, 6, "share")


@query("report_outliers", f"""
    SELECT "column", count, round(pct, 6) AS pct FROM ({_OUTLIERS}) o WHERE count > 0 ORDER BY count DESC, 1""")
def _(spark, d):
    return rounded(T.Report(table(spark, d, "events")).outliers, 6, "pct")


@query("report_missing", f"""
    SELECT "column", null_count, null_pct FROM ({_OVERVIEW}) o WHERE null_count > 0 ORDER BY null_count DESC, position""")
def _(spark, d):
    return rounded(T.Report(gappy_orders(spark, d)).missing, 6, "null_pct")


@query("report_categories", """
    WITH c AS (SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 2
               UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2)
    SELECT "column", value, count, round(count * 100.0 / sum(count) OVER (PARTITION BY "column"), 6) AS pct,
           CAST(sum(count) OVER (PARTITION BY "column") AS BIGINT) AS valid, count(*) OVER (PARTITION BY "column") AS distinct_values
    FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) <= 10""")
def _(spark, d):
    return rounded(T.Report(table(spark, d, "lineitem")).categories, 6, "pct")


@query("report_category_charts", """
    SELECT "column", n AS unique_count FROM (
        SELECT 0 AS p, 'c_name' AS "column", count(DISTINCT c_name) AS n FROM customer
        UNION ALL SELECT 1, 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer) x
    WHERE n BETWEEN 2 AND 30 ORDER BY n, p""")
def _(spark, d):
    return T.Report(table(spark, d, "customer")).category_charts
