"""Profile, correlation and component queries."""
from pyspark.sql import functions as F

from ..operators import profile as P, relations as R
from .registry import GAPPY_LINES_SQL, GAPPY_SQL, LINE_KEY, gappy_lines, gappy_orders, query, rounded, table



def _overview_sql(relation: str, columns: list[tuple[str, str, str, str]]) -> str:
    """``columns``: (name, kind, Spark type, missing test)."""
    parts = []
    for i, (c, kind, dtype, missing) in enumerate(columns):
        stats = (f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max"
                 if kind == "numeric" else
                 "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max")
        parts.append(f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS kind, '{dtype}' AS dtype, count(*) AS row_count,
            count(*) FILTER ({missing}) AS null_count, round(count(*) FILTER ({missing}) * 100.0 / count(*), 6) AS null_pct,
            count(DISTINCT {c}) AS unique_count, {stats} FROM {relation} g""")
    return " UNION ALL ".join(parts)


_ORDER_COLUMNS = [
    ("o_orderkey", "numeric", "bigint", "o_orderkey IS NULL"),
    ("o_custkey", "numeric", "bigint", "o_custkey IS NULL"),
    ("o_orderstatus", "categorical", "string", "o_orderstatus IS NULL"),
    ("o_totalprice", "numeric", "double", "o_totalprice IS NULL"),
    ("o_orderdate", "datetime", "timestamp_ntz", "o_orderdate IS NULL"),
    ("o_orderpriority", "categorical", "string", "trim(o_orderpriority) = ''"),
]
_OVERVIEW = _overview_sql(GAPPY_SQL, _ORDER_COLUMNS)


@query("column_overview", _OVERVIEW)
def _(spark, d):
    return rounded(P.column_overview(gappy_orders(spark, d)), 4, "mean", "std").withColumn("null_pct", F.round("null_pct", 6))


@query("table_info", f"""
    SELECT position, row_count, 6 AS column_count, "column", dtype, null_count, unique_count FROM ({_OVERVIEW}) o""")
def _(spark, d):
    return P.table_info(gappy_orders(spark, d))


@query("approximate_overview")
def _(spark, d):
    return P.column_overview(table(spark, d, "lineitem"), approx=True)


@query("column_kinds", """
    SELECT * FROM (VALUES ('c_custkey', 'numeric'), ('c_name', 'other'), ('c_nationkey', 'numeric'),
        ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical')) v("column", kind) WHERE EXISTS (SELECT 1 FROM customer)""")
def _(spark, d):
    return P.column_overview(table(spark, d, "customer")).select("column", "kind")


@query("missing_summary", f"""
    SELECT "column", null_count, null_pct FROM ({_OVERVIEW}) o WHERE null_count > 0 ORDER BY null_count DESC, position""")
def _(spark, d):
    return rounded(P.missing_summary(gappy_orders(spark, d)), 6, "null_pct")


_SUMMARY = """
    SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
           round(var_samp({c}), 2) AS variance, CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q1,
           CAST(median({c}) AS DOUBLE) AS median, quantile_cont({c}, 0.75) AS q3, CAST(max({c}) AS DOUBLE) AS max,
           CAST(max({c}) - min({c}) AS DOUBLE) AS range,
           round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM {t} g"""


@query("numeric_summary", " UNION ALL ".join(
    _SUMMARY.format(c=c, t="(SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, l_extendedprice, l_tax FROM " + GAPPY_LINES_SQL + " x)") for c in ("l_quantity", "l_extendedprice", "l_tax")))
def _(spark, d):
    out = P.numeric_summary(gappy_lines(spark, d), ["l_quantity", "l_extendedprice", "l_tax"])
    return rounded(rounded(rounded(out, 4, "mean", "std"), 2, "variance"), 6, "iqr")


@query("category_summary", f"""
    WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM {GAPPY_SQL} g WHERE trim(o_orderpriority) <> '' GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS count, count(*) AS unique, (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS mode,
           max(n) AS mode_count, round(max(n) * 100.0 / sum(n), 6) AS mode_pct FROM c""")
def _(spark, d):
    return rounded(P.category_summary(gappy_orders(spark, d), "o_orderpriority"), 6, "mode_pct")


@query("chart_suggestions", """
    SELECT "column", kind, CASE kind WHEN 'numeric' THEN 'histogram' ELSE 'bar' END AS chart,
           CASE kind WHEN 'numeric' THEN 'histogram,kde,boxplot' WHEN 'categorical' THEN 'bar,pie' ELSE 'bar' END AS charts
    FROM (SELECT 'p_partkey' AS "column", 'numeric' AS kind UNION ALL
          SELECT 'p_name', CASE WHEN count(DISTINCT p_name) <= 30 THEN 'categorical' ELSE 'other' END FROM part UNION ALL
          SELECT 'p_brand', CASE WHEN count(DISTINCT p_brand) <= 30 THEN 'categorical' ELSE 'other' END FROM part) k""")
def _(spark, d):
    return P.chart_suggestions(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"))


@query("pair_chart_suggestions", """
    SELECT * FROM (VALUES ('l_quantity', 'l_tax', 'num_num', 'scatter', 'scatter,hexbin,corr_line'),
        ('l_returnflag', 'l_tax', 'cat_num', 'box', 'box,violin,bar_mean'),
        ('l_tax', 'l_returnflag', 'num_cat', 'box', 'box,violin,bar_mean'),
        ('l_returnflag', 'l_linestatus', 'cat_cat', 'heatmap', 'heatmap,stacked_bar,grouped_bar'),
        ('l_shipdate', 'l_tax', 'other', 'heatmap', 'heatmap')) v(x, y, pair_kind, chart, charts)
    WHERE EXISTS (SELECT 1 FROM lineitem)""")
def _(spark, d):
    pairs = [("l_quantity", "l_tax"), ("l_returnflag", "l_tax"), ("l_tax", "l_returnflag"),
             ("l_returnflag", "l_linestatus"), ("l_shipdate", "l_tax")]
    return P.pair_chart_suggestions(table(spark, d, "lineitem"), pairs)


@query("default_columns", """
    SELECT min(o_orderkey) AS low, max(o_orderkey) AS high, round(corr(o_orderkey, o_custkey), 8) AS r FROM orders""")
def _(spark, d):
    """The range of the column shown first and the correlation of the pair shown first."""
    o = table(spark, d, "orders")
    one, (first, second) = P.default_column(o), P.default_pair(o)
    return o.agg(F.min(one).alias("low"), F.max(one).alias("high"), F.round(F.corr(first, second), 8).alias("r"))


@query("plot_sample", "SELECT least(count(*), 5000) AS rows, least(count(*), 5000) AS distinct_keys FROM orders")
def _(spark, d):
    sample = P.plot_sample(table(spark, d, "orders"), "o_orderkey")
    return sample.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("distinct_keys"))


_RANKS = f"""
    WITH g AS (SELECT l_extendedprice AS x, l_discount AS y FROM {GAPPY_LINES_SQL} g WHERE l_discount IS NOT NULL),
    r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                 rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM g)"""


@query("correlation", _RANKS + "SELECT round(corr(x, y), 8) AS pearson_r, round(corr(rx, ry), 8) AS spearman_r, count(*) AS n FROM r")
def _(spark, d):
    return rounded(R.correlation(gappy_lines(spark, d), "l_extendedprice", "l_discount"), 8, "pearson_r", "spearman_r")


@query("correlation_p_value")
def _(spark, d):
    return R.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", p_value=True)


_CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM {GAPPY_LINES_SQL} g"
    for i, a in enumerate(_CORR_COLUMNS) for b in _CORR_COLUMNS[i + 1:])


@query("correlation_pairs", _CORR_SQL)
def _(spark, d):
    return rounded(R.correlation_pairs(gappy_lines(spark, d), _CORR_COLUMNS), 8, "r")


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS \"column\", " + ", ".join(f"round(corr({a}, {b}), 8) AS {b}" for b in _CORR_COLUMNS)
    + f" FROM {GAPPY_LINES_SQL} g" for a in _CORR_COLUMNS))
def _(spark, d):
    return rounded(R.correlation_matrix(gappy_lines(spark, d), _CORR_COLUMNS), 8, *_CORR_COLUMNS)


@query("top_correlations", f"SELECT * FROM ({_CORR_SQL}) c ORDER BY abs(r) DESC, a, b")
def _(spark, d):
    return rounded(R.top_correlations(gappy_lines(spark, d).select(*_CORR_COLUMNS)), 8, "r")


@query("crosstab_counts", f"""
    SELECT coalesce(o_orderstatus, 'None') AS x, coalesce(p, 'None') AS y, count(*) AS count
    FROM (SELECT o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p FROM orders) o GROUP BY 1, 2""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return R.crosstab_counts(o, "o_orderstatus", "p")


@query("crosstab", """
    SELECT p_brand, count(*) FILTER (p_type = 'ECONOMY') AS "ECONOMY", count(*) FILTER (p_type = 'LARGE') AS "LARGE",
           count(*) FILTER (p_type = 'MEDIUM') AS "MEDIUM", count(*) FILTER (p_type = 'PROMO') AS "PROMO", count(*) FILTER (p_type = 'SMALL') AS "SMALL",
           count(*) FILTER (p_type = 'STANDARD') AS "STANDARD" FROM part GROUP BY 1 ORDER BY 1""")
def _(spark, d):
    return R.crosstab(table(spark, d, "part"), "p_brand", "p_type")


_PCA = """
    WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_discount * 100) AS my, var_samp(l_quantity) AS a,
                      covar_samp(l_quantity, l_discount * 100) AS b, var_samp(l_discount * 100) AS c FROM lineitem),
    e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l1,
                 (a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l2 FROM m),
    v AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS vx, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS vy FROM e)"""


def _pca(spark, d):
    l = table(spark, d, "lineitem").withColumn("hundredths", F.col("l_discount") * 100)
    return R.principal_components(l, ["l_quantity", "hundredths"], keep=LINE_KEY)


@query("pca_scores", _PCA + """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round(abs((l_quantity - mx) * vx + (l_discount * 100 - my) * vy), 4) AS "PC1",
           round(abs((l_discount * 100 - my) * vx - (l_quantity - mx) * vy), 4) AS "PC2" FROM lineitem, v""")
def _(spark, d):
    scores, _ = _pca(spark, d)
    return scores.select(*LINE_KEY, F.round(F.abs("PC1"), 4).alias("PC1"), F.round(F.abs("PC2"), 4).alias("PC2"))


@query("pca_explained_variance", _PCA + """
    SELECT 'PC1' AS component, round(l1 / (l1 + l2), 8) AS ratio FROM v UNION ALL SELECT 'PC2', round(l2 / (l1 + l2), 8) FROM v""")
def _(spark, d):
    _, ratios = _pca(spark, d)
    return spark.createDataFrame(
        [(f"PC{i + 1}", round(r, 8)) for i, r in enumerate(ratios)], "component string, ratio double")
