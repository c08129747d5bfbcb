"""The tables of an exploratory report, each as a DataFrame."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from ..constants import REPORT_CATEGORY_TOP, STRONG_CORRELATION
from ..functions.missing import as_text, data_type, is_missing, numeric_columns
from ..functions.naming import col
from .outliers import outlier_summary
from .profile import column_overview
from .relations import top_correlations


def _held(table: DataFrame) -> DataFrame:
    """A result with one row per column, kept so that the tables built on it do not scan again."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


class Report:
    """Report tables of one DataFrame, each made when first asked for.

    The column overview, the outlier counts and the correlations are computed once and shared; they have
    at most one row per column, or per pair of numeric columns.
    """

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    @cached_property
    def overview(self) -> DataFrame:
        return _held(column_overview(self.df))

    @cached_property
    def outlier_counts(self) -> DataFrame:
        return _held(outlier_summary(self.df, numeric_columns(self.df), "iqr"))

    @cached_property
    def correlations(self) -> DataFrame:
        return _held(top_correlations(self.df))

    @property
    def kpis(self) -> DataFrame:
        return _kpis(self.overview, self.outlier_counts)

    @property
    def missing(self) -> DataFrame:
        listed = self.overview.where("null_count > 0").orderBy(F.desc("null_count"), "position")
        return listed.select("column", "null_count", "null_pct")

    @property
    def outliers(self) -> DataFrame:
        hits = self.outlier_counts.where("count > 0")
        return hits.orderBy(F.desc("count"), "column")

    @property
    def categories(self) -> DataFrame:
        found = category_columns(self.overview).orderBy("position")
        return category_section(self.df, [r["column"] for r in found.collect()])

    @property
    def category_charts(self) -> DataFrame:
        return pick_category_charts(self.overview)

    @property
    def insights(self) -> DataFrame:
        return _insights(self.overview, self.outlier_counts, self.correlations)


def category_columns(overview: DataFrame) -> DataFrame:
    return overview.where("kind = 'categorical'").select("position", "column", "unique_count")


def pick_category_charts(overview: DataFrame, *, most: int | None = None) -> DataFrame:
    """Categorical columns worth a chart: 2 to 30 values first, fewest first, then the larger ones; ``most`` cuts."""
    found = category_columns(overview).where("unique_count >= 2")
    small = F.col("unique_count") <= 30
    order = [F.when(small, 0).otherwise(1), F.when(small, F.col("unique_count")), F.col("position")]
    ranked = found.orderBy(*order)
    return (ranked if most is None else ranked.limit(most)).select("column", "unique_count")


def category_section(df: DataFrame, names: list[str], *, top: int = REPORT_CATEGORY_TOP) -> DataFrame:
    """(column, value, count, pct, valid, distinct_values): the top values of several columns at once."""
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, value string, count bigint, pct double, valid bigint, distinct_values bigint")
    cells = [F.when(~is_missing(df, c), F.struct(F.lit(c).alias("column"), as_text(col(c), data_type(df, c)).alias("value")))
             for c in names]
    counted = (
        df.select(F.inline(F.array(*cells))).where("column is not null")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    )
    totals = counted.groupBy("column").agg(F.sum("count").alias("valid"), F.count(F.lit(1)).alias("distinct_values"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")
    return best.join(F.broadcast(totals), "column").select(  # one row per column
        "column", "value", "count", (F.col("count") / F.col("valid") * 100).alias("pct"), "valid", "distinct_values")


def _kpis(overview: DataFrame, outliers: DataFrame) -> DataFrame:
    count = lambda test: F.when(test, 1).otherwise(0).cast("bigint")
    zero = F.lit(0).cast("bigint")
    per_column = overview.select(
        "row_count", F.lit(1).cast("bigint").alias("column"), count(F.col("kind") == "numeric").alias("numeric"),
        count(F.col("kind") == "categorical").alias("categorical"), count(F.col("null_count") > 0).alias("missing"),
        zero.alias("outlier"))
    per_test = outliers.select(
        zero.alias("row_count"), zero.alias("column"), zero.alias("numeric"), zero.alias("categorical"),
        zero.alias("missing"), count(F.col("count") > 0).alias("outlier"))
    return per_column.unionByName(per_test).agg(
        F.coalesce(F.max("row_count"), zero).alias("rows"), F.sum("column").alias("columns"),
        *[F.sum(n).alias(f"{n}_columns") for n in ("numeric", "categorical", "missing", "outlier")])


def _fact(kind: str, subject, other, number, share) -> list:
    return [F.lit(kind).alias("fact"), subject.alias("subject"), other.alias("other"),
            number.cast("double").alias("number"), share.cast("double").alias("share")]


def _insights(overview: DataFrame, outliers: DataFrame, corr: DataFrame) -> DataFrame:
    """Facts (fact, subject, other, number, share): table shape, the column with most gaps, the
    strongest correlation with the number of strong ones, the column with most outliers."""
    nothing = F.lit(None).cast("string")
    shape = overview.agg(F.max("row_count").alias("n"), F.count(F.lit(1)).alias("c")).select(
        *_fact("shape", nothing, nothing, F.col("n"), F.col("c")))
    first = F.struct((-F.col("null_count")).alias("a"), "position")
    gaps = overview.where("null_count > 0").agg(
        F.min_by("column", first).alias("column"), F.min_by("null_pct", first).alias("pct"),
        F.count(F.lit(1)).alias("n")).where("n > 0").select(
        *_fact("most_missing", F.col("column"), nothing, F.col("n"), F.col("pct")))
    strongest = F.struct((-F.abs("r")).alias("a"), "a", "b")
    links = corr.agg(
        F.min_by("a", strongest).alias("x"), F.min_by("b", strongest).alias("y"), F.min_by("r", strongest).alias("r"),
        F.count_if(F.abs("r") >= STRONG_CORRELATION).alias("n")).where("x is not null").select(
        *_fact("strongest_correlation", F.col("x"), F.col("y"), F.col("n"), F.col("r")))
    most = F.struct((-F.col("count")).alias("a"), "column")
    odd = outliers.where("count > 0").agg(
        F.min_by("column", most).alias("column"), F.min_by("pct", most).alias("pct"),
        F.count(F.lit(1)).alias("n")).where("n > 0").select(
        *_fact("most_outliers", F.col("column"), nothing, F.col("n"), F.col("pct")))
    return shape.unionByName(gaps).unionByName(links).unionByName(odd)
