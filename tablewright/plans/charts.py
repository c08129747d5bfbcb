"""Chart-data and outlier queries."""
from pyspark.sql import functions as F

from ..operators import charts as K, outliers as O
from .registry import GAPPY_LINES_SQL, LINE_KEY, gappy_lines, query, rounded, table

_BINS = """
    WITH v AS (SELECT {c} AS v FROM {t} WHERE {c} IS NOT NULL), m AS (SELECT min(v) AS lo, max(v) AS hi, count(*) AS n FROM v),
    b AS (SELECT lo, hi, n, {bins} AS bins, (hi - lo) / ({bins}) AS w FROM m),
    c AS (SELECT CAST(least(floor((v - lo) / w), bins - 1) AS INTEGER) AS bin, count(*) AS k FROM v, b GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 6) AS low, round(lo + (i + 1) * w, 6) AS high,
           coalesce(k, 0) AS count, round(coalesce(k, 0) / n / w, 10) AS density
    FROM (SELECT b.*, unnest(range(CAST(bins AS BIGINT))) AS i FROM b) g LEFT JOIN c ON bin = i"""


def _round_bins(df):
    return rounded(rounded(df, 6, "low", "high"), 10, "density")


@query("histogram", _BINS.format(c="l_extendedprice", t="lineitem", bins=30))
def _(spark, d):
    return _round_bins(K.histogram(table(spark, d, "lineitem"), "l_extendedprice", 30))


@query("histogram_auto_bins", _BINS.format(c="c_acctbal", t="customer", bins="least(40, greatest(10, n // 20))"))
def _(spark, d):
    return _round_bins(K.auto_histogram(table(spark, d, "customer"), "c_acctbal"))


@query("kernel_density", """
    WITH m AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS n, stddev_samp(c_acctbal) * pow(count(*), -0.2) AS h FROM customer),
    g AS (SELECT m.*, i, lo + (hi - lo) * i / 199.0 AS x FROM m, range(200) t(i))
    SELECT CAST(i AS INTEGER) AS point, round(x, 6) AS x,
           round(sum(exp(-0.5 * ((x - c_acctbal) / h) * ((x - c_acctbal) / h)) / (n * h * sqrt(2 * pi()))), 12) AS density
    FROM g, customer GROUP BY i, x""")
def _(spark, d):
    return rounded(rounded(K.kernel_density(table(spark, d, "customer"), "c_acctbal", "c_custkey"), 6, "x"), 12, "density")


@query("violin_density", """
    WITH m AS (SELECT c_mktsegment AS category, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS n,
                      stddev_samp(c_acctbal) * pow(count(*), -0.2) AS h FROM customer GROUP BY 1),
    g AS (SELECT m.*, i, lo + (hi - lo) * i / 99.0 AS x FROM m, range(100) t(i))
    SELECT category, CAST(i AS INTEGER) AS point, round(x, 6) AS x,
           round(sum(exp(-0.5 * ((x - c_acctbal) / h) * ((x - c_acctbal) / h)) / (n * h * sqrt(2 * pi()))), 12) AS density
    FROM g JOIN customer ON category = c_mktsegment GROUP BY category, i, x""")
def _(spark, d):
    out = K.violin_density(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "c_custkey")
    return rounded(rounded(out, 6, "x"), 12, "density")


_BOX = """
    count(v) AS count, round(avg(v), 4) AS mean, min(q1) AS q1, min(q2) AS median, min(q3) AS q3,
    min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS fliers"""


@query("box_stats", f"""
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT {_BOX} FROM (SELECT value AS v, q.* FROM events, q) x""")
def _(spark, d):
    return rounded(K.box_stats(table(spark, d, "events"), "value"), 4, "mean")


@query("box_by_category", f"""
    WITH q AS (SELECT event_type AS category, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2,
                      quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT category, {_BOX} FROM (SELECT value AS v, q.* FROM events JOIN q ON category = event_type) x GROUP BY category""")
def _(spark, d):
    return rounded(K.box_by_category(table(spark, d, "events"), "event_type", "value", "event_id"), 4, "mean")


@query("hexbin", """
    WITH m AS (SELECT min(p_size) - 1e-9 * (max(p_size) - min(p_size)) AS xlo, max(p_size) + 1e-9 * (max(p_size) - min(p_size)) AS xhi,
                      min(p_retailprice) AS ylo, max(p_retailprice) AS yhi FROM part),
    s AS (SELECT xlo, ylo, (xhi - xlo) / 35 AS sx, (yhi - ylo) / 20 AS sy FROM m),
    g AS (SELECT s.*, (p_size - xlo) / sx AS gx, (p_retailprice - ylo) / sy AS gy FROM part, s),
    n AS (SELECT *, round_even(gx, 0) AS i1, round_even(gy, 0) AS j1, floor(gx) + 0.5 AS i2, floor(gy) + 0.5 AS j2 FROM g),
    c AS (SELECT *, (gx - i1) * (gx - i1) + 3 * ((gy - j1) * (gy - j1)) < (gx - i2) * (gx - i2) + 3 * ((gy - j2) * (gy - j2)) AS near FROM n)
    SELECT round(CASE WHEN near THEN i1 ELSE i2 END * sx + xlo, 4) AS x,
           round(CASE WHEN near THEN j1 ELSE j2 END * sy + ylo, 4) AS y, count(*) AS count FROM c GROUP BY 1, 2""")
def _(spark, d):
    return rounded(K.hexbin(table(spark, d, "part"), "p_size", "p_retailprice"), 4, "x", "y")


@query("fitted_line", """
    SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
           count(*) AS n, min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem""")
def _(spark, d):
    return rounded(rounded(K.fitted_line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 6, "slope"), 4, "intercept")


@query("line_points", """
    WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b,
                      min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT CAST(i AS INTEGER) AS point, round(lo + i * ((hi - lo) / 49.0), 6) AS x, round(a * (lo + i * ((hi - lo) / 49.0)) + b, 4) AS y
    FROM f, range(50) t(i)""")
def _(spark, d):
    return rounded(rounded(K.line_points(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 6, "x"), 4, "y")


@query("scatter_points", "SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part")
def _(spark, d):
    return K.scatter_points(table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey")


@query("pair_plot_histograms", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", bin, low, high, count FROM ("
    + _BINS.format(c=f"CAST({c} AS DOUBLE)", t="part", bins="least(30, greatest(10, n // 20))") + ") h"
    for c in ("p_size", "p_retailprice")))
def _(spark, d):
    return rounded(K.pair_plot_histograms(table(spark, d, "part"), ["p_size", "p_retailprice"], "p_partkey"), 6, "low", "high")


# ---------------------------------------------------------------- outliers

_IQR = """
    WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}),
    x AS (SELECT {t}.*, q.q1 AS q1, q.q3 AS q3, coalesce({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1), false) AS is_outlier FROM {t}, q)"""


@query("outlier_flag_iqr", _IQR.format(c="value", t="events") + "SELECT event_id, is_outlier FROM x")
def _(spark, d):
    return O.with_outlier_flag(table(spark, d, "events"), ["value"]).select("event_id", "is_outlier")


@query("outlier_flag_zscore", """
    WITH m AS (SELECT avg(value) AS a, stddev_samp(value) AS s FROM events)
    SELECT event_id, abs(value - a) / s > 3 AS is_outlier FROM events, m""")
def _(spark, d):
    return O.with_outlier_flag(table(spark, d, "events"), ["value"], "zscore").select("event_id", "is_outlier")


@query("outlier_flag_any_column", """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS a1, quantile_cont(value, 0.75) AS a3,
                      quantile_cont(user_id, 0.25) AS b1, quantile_cont(user_id, 0.75) AS b3 FROM events)
    SELECT event_id, value < a1 - 0.1 * (a3 - a1) OR value > a3 + 0.1 * (a3 - a1)
        OR user_id < b1 - 0.1 * (b3 - b1) OR user_id > b3 + 0.1 * (b3 - b1) AS is_outlier FROM events, q""")
def _(spark, d):
    flagged = O.with_outlier_flag(table(spark, d, "events"), ["value", "user_id", "event_type"], iqr_k=0.05)
    return flagged.select("event_id", "is_outlier")


@query("drop_outliers", _IQR.format(c="value", t="events") + "SELECT event_id, ts, user_id, event_type, value, props FROM x WHERE NOT is_outlier")
def _(spark, d):
    return O.drop_outliers(table(spark, d, "events"), ["value"])


@query("split_outliers", _IQR.format(c="value", t="events") + """
    SELECT (SELECT count(*) FROM x WHERE is_outlier) AS removed, count(*) AS kept FROM x WHERE NOT is_outlier""")
def _(spark, d):
    kept, removed, _ = O.split_outliers(table(spark, d, "events"), ["value"])
    return kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("removed", F.lit(removed).cast("bigint"))


@query("outlier_summary", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS count,
           round(count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 6) AS pct
    FROM {GAPPY_LINES_SQL} g, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {GAPPY_LINES_SQL} h) q"""
    for c in ("l_quantity", "l_extendedprice", "l_tax")))
def _(spark, d):
    return rounded(O.outlier_summary(gappy_lines(spark, d), ["l_quantity", "l_extendedprice", "l_tax", "l_returnflag"]), 6, "pct")


@query("outlier_summary_zscore", """
    SELECT 'value' AS "column", count(*) FILTER (abs(value - a) / s > 2.5) AS count,
           round(count(*) FILTER (abs(value - a) / s > 2.5) * 100.0 / count(*), 6) AS pct
    FROM events, (SELECT avg(value) AS a, stddev_samp(value) AS s FROM events) m""")
def _(spark, d):
    return rounded(O.outlier_summary(table(spark, d, "events"), ["value"], "zscore", z_threshold=2.5), 6, "pct")


@query("count_outlier_rows", _IQR.format(c="value", t="events") + """
    SELECT count(*) FILTER (is_outlier) AS outlier_rows, count(*) AS row_count FROM x""")
def _(spark, d):
    return O.count_outlier_rows(table(spark, d, "events"), ["value"])


@query("outlier_sample", _IQR.format(c="value", t="events") + """
    SELECT value, user_id FROM x WHERE is_outlier ORDER BY event_id LIMIT 100""")
def _(spark, d):
    # Only the first listed column has outliers, so the rows are those of ``value``.
    return O.outlier_sample(table(spark, d, "events"), ["value", "user_id"], "event_id")


@query("isolation_forest")
def _(spark, d):
    l = table(spark, d, "lineitem")
    return O.with_outlier_flag(l, ["l_quantity", "l_extendedprice", "l_discount"], "isolation_forest", order_by=LINE_KEY)


@query("isolation_forest_planted", """
    SELECT count(*) AS n, CAST(count_if(o_orderkey % 199 = 0) AS BIGINT) AS planted,
           CAST(count_if(o_orderkey % 199 = 0) AS BIGINT) AS planted_found, true AS share_holds FROM orders""")
def _(spark, d):
    """Every 199th order is moved far away: all of them are flagged, and the stated share of all rows is."""
    o = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 199 == 0).alias("planted"), "o_totalprice", (F.col("o_custkey") % 1000).alias("c"))
    moved = o.withColumn("o_totalprice", F.when(F.col("planted"), F.col("o_totalprice") * 10 + 5e6).otherwise(F.col("o_totalprice"))).withColumn(
        "c", F.when(F.col("planted"), F.col("c") - 20_000).otherwise(F.col("c")))
    flagged = O.with_outlier_flag(moved, ["o_totalprice", "c"], "isolation_forest", contamination=0.05, order_by="o_orderkey")
    share = F.count_if("is_outlier") / F.count(F.lit(1))
    return flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if("planted").alias("planted"),
                       F.count_if(F.col("planted") & F.col("is_outlier")).alias("planted_found"), share.between(0.045, 0.0501).alias("share_holds"))


@query("isolation_forest_summary")
def _(spark, d):
    return O.outlier_summary(table(spark, d, "events"), ["value", "user_id"], "isolation_forest", order_by="event_id")
