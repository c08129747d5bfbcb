"""Relations between columns: correlation, ranks, cross tables and principal components."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from ..functions.missing import category_text, data_type, is_number, known, numeric_columns
from ..functions.naming import col, require_column, resolve_columns
from .ordering import with_running_total
from .skew import join_lookup


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.select(known(df, require_column(df, x)).cast("double").alias("x"),
                     known(df, require_column(df, y)).cast("double").alias("y"))
    return both.where("x is not null and y is not null")


def _average_ranks(both: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(value, rank): ties share the mean of their places."""
    counts = pairs.groupBy(name).agg(F.sum("c").alias("c"))
    placed = with_running_total(counts, name, F.col("c"), "upto", cut_by=both)
    return placed.select(name, (F.col("upto") - (F.col("c") - 1) / 2).alias(f"rank_{name}"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (spearman_r, n). Ranks are given to distinct values, then weighted by how often they occur."""
    both = _pairs(df, x, y)
    pairs = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    ranked = join_lookup(pairs, _average_ranks(both, pairs, "x"), ["x"])
    ranked = join_lookup(ranked, _average_ranks(both, pairs, "y"), ["y"])
    rx, ry, c = F.col("rank_x"), F.col("rank_y"), F.col("c").cast("double")
    s = ranked.agg(
        F.sum("c").alias("n"), F.sum(c * rx * ry).alias("xy"),
        F.sum(c * rx * rx).alias("xx"), F.sum(c * ry * ry).alias("yy"))
    mid = F.col("n") * F.pow((F.col("n") + 1) / 2.0, F.lit(2))  # the mean rank is (n + 1) / 2
    spread = F.sqrt(F.greatest(F.col("xx") - mid, F.lit(0.0)) * F.greatest(F.col("yy") - mid, F.lit(0.0)))
    return s.select(F.try_divide(F.col("xy") - mid, spread).alias("spearman_r"), F.coalesce("n", F.lit(0)).alias("n"))


def pearson_p_value(df: DataFrame, x: str, y: str) -> float | None:
    """Two-sided p of a zero correlation: the slope test of a one-feature regression; 1 for two pairs."""
    pairs = _pairs(df, x, y)
    facts = pairs.agg(F.count("x"), F.stddev_samp("x"), F.stddev_samp("y")).first()
    if facts[0] < 2 or not facts[1] or not facts[2]:
        return None
    if facts[0] == 2:
        return 1.0
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(pairs)
    model = LinearRegression(labelCol="y", solver="normal").fit(data)
    return float(model.summary.pValues[0])


def correlation(df: DataFrame, x: str, y: str, *, p_value: bool = False) -> DataFrame:
    """One row (pearson_r, spearman_r, n[, pearson_p]); none with fewer than two complete pairs."""
    straight = _pairs(df, x, y).agg(F.corr("x", "y").alias("pearson_r"), F.count("x").alias("n"))
    out = straight.join(spearman(df, x, y), "n").where("n >= 2").select("pearson_r", "spearman_r", "n")
    if p_value:
        out = out.withColumn("pearson_p", F.lit(pearson_p_value(df, x, y)).cast("double"))
    return out


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r) for each pair in table order, each from the rows complete in that pair; one scan."""
    names = [c for c in (resolve_columns(df, columns) if columns else numeric_columns(df))
             if is_number(data_type(df, c))]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    v = {c: known(df, c).cast("double") for c in names}
    wide = df.agg(*[F.corr(v[a], v[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column with its correlation to every numeric column."""
    names = [c for c in (resolve_columns(df, columns) if columns else numeric_columns(df))
             if is_number(data_type(df, c))]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "column string")
    v = {c: known(df, c).cast("double") for c in names}
    cell = {(i, j): f"r{i}_{j}" for i in range(len(names)) for j in range(i, len(names))}
    wide = df.agg(*[F.corr(v[names[i]], v[names[j]]).alias(n) for (i, j), n in cell.items()])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("column"), *[
            F.col(cell[min(i, j), max(i, j)]).alias(b) for j, b in enumerate(names)])
        for i, a in enumerate(names)])))


def top_correlations(
    df: DataFrame, *, columns: int | None = None, limit: int | None = None
) -> DataFrame:
    """All pairs of numeric columns, the strongest first; ``columns`` and ``limit`` cut the listing."""
    pairs = correlation_pairs(df, numeric_columns(df)[:columns]).where("r is not null and not isnan(r)")
    ranked = pairs.orderBy(F.desc(F.abs("r")), "a", "b")
    return ranked if limit is None else ranked.limit(limit)


def crosstab_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, count) of all category pairs; missing values are categories."""
    labels = [category_text(df, require_column(df, c)).alias(n) for c, n in ((x, "x"), (y, "y"))]
    return df.select(*labels).groupBy("x", "y").agg(F.count(F.lit(1)).alias("count"))


def crosstab(df: DataFrame, x: str, y: str, *, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Cross table in sort order, 0 where a pair never occurs; ``rows`` and ``cols`` keep the first categories.

    Every category of ``y`` becomes a column, so it must have few enough for a table.
    """
    counted = crosstab_counts(df, x, y)
    listed = counted.select("y").distinct().orderBy("y")
    names = [r["y"] for r in (listed if cols is None else listed.limit(cols)).collect()]
    wide = counted.groupBy("x").pivot("y", names).agg(F.sum("count")).na.fill(0).orderBy("x")
    return (wide if rows is None else wide.limit(rows)).withColumnRenamed("x", x)


def principal_components(
    df: DataFrame, columns: Sequence[str], *, components: int = 2, keep: Sequence[str] = ()
) -> tuple[DataFrame, list[float]] | None:
    """Scores PC1… of the complete rows (with the ``keep`` columns) and the explained variance shares.

    None with fewer than two numeric columns or three complete rows. The sign of a component is arbitrary.
    """
    names = [c for c in resolve_columns(df, columns) if is_number(data_type(df, c))]
    if len(names) < 2:
        return None
    slim = df.select(*[col(k) for k in keep], *[known(df, c).cast("double").alias(f"__x{i}") for i, c in enumerate(names)])
    inputs = [f"__x{i}" for i in range(len(names))]
    complete = slim.na.drop(subset=inputs)
    n = complete.count()
    if n < 3:
        return None
    k = min(components, len(names), n)
    data = VectorAssembler(inputCols=inputs, outputCol="__raw").transform(complete)
    scaler = StandardScaler(inputCol="__raw", outputCol="__centred", withMean=True, withStd=False).fit(data)
    centred = scaler.transform(data)
    model = PCA(k=k, inputCol="__centred", outputCol="__scores").fit(centred)
    scores = model.transform(centred).withColumn("__s", vector_to_array("__scores"))
    out = scores.select(*[col(c) for c in keep], *[F.col("__s")[i].alias(f"PC{i + 1}") for i in range(k)])
    return out, [float(v) for v in model.explainedVariance.toArray()]
