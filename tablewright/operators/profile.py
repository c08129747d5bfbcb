"""Column statistics: all columns of a table from as few scans as possible."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import MAX_CATEGORIES, PLOT_ROWS, SEED
from ..functions.missing import (
    compact_key, data_type, is_datetime, is_missing, is_number, known, numeric_columns)
from ..functions.naming import col, require_column, resolve_columns
from .grouping import frequencies
from .ordering import order_key
from .quantiles import column_quantiles

# Chart choices per column kind and per pair of kinds, the default first.
CHARTS = {
    "numeric": ["histogram", "kde", "boxplot"],
    "categorical": ["bar", "pie"],
    "datetime": ["bar"],
    "other": ["bar"],
}
PAIR_CHARTS = {
    "num_num": ["scatter", "hexbin", "corr_line"],
    "cat_num": ["box", "violin", "bar_mean"],
    "num_cat": ["box", "violin", "bar_mean"],
    "cat_cat": ["heatmap", "stacked_bar", "grouped_bar"],
    "other": ["heatmap"],
}


def distinct_counts(df: DataFrame, columns: Sequence[str], *, approx: bool = False) -> DataFrame:
    """Rows (column, unique_count), missing values (NULL, NaN) left out.

    Exact counting deduplicates on the map side before its one shuffle; ``approx`` needs no shuffle.
    """
    names = resolve_columns(df, columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, unique_count bigint")
    texts = {c: compact_key(known(df, c), data_type(df, c)).cast("string") for c in names}
    if approx:
        wide = df.agg(*[F.approx_count_distinct(t).alias(f"u{i}") for i, t in enumerate(texts.values())])
        return wide.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"u{i}").alias("unique_count"))
            for i, c in enumerate(names)])))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), t.alias("text")) for c, t in texts.items()])
    # NULL cells stay in as one pair per column, so that a column without values still has a row.
    return (
        df.select(F.inline(cells)).distinct()
        .groupBy("column").agg(F.count("text").alias("unique_count"))
    )


def _kind(dtype: T.DataType, unique: Column) -> Column:
    if is_datetime(dtype):
        return F.lit("datetime")
    if is_number(dtype):
        return F.lit("numeric")
    if isinstance(dtype, T.BooleanType):
        return F.lit("categorical")
    return F.when(unique <= MAX_CATEGORIES, "categorical").otherwise("other")


def _needs_counting(dtype: T.DataType) -> bool:
    return not (is_datetime(dtype) or is_number(dtype) or isinstance(dtype, T.BooleanType))


def column_kinds(df: DataFrame) -> dict[str, str]:
    """Kind per column; only text-like columns are looked at, the others follow from their type."""
    open_names = [f.name for f in df.schema if _needs_counting(f.dataType)]
    unique = {r["column"]: r["unique_count"] for r in distinct_counts(df, open_names).collect()}
    kinds = {}
    for f in df.schema:
        if is_datetime(f.dataType):
            kinds[f.name] = "datetime"
        elif is_number(f.dataType):
            kinds[f.name] = "numeric"
        elif isinstance(f.dataType, T.BooleanType) or unique.get(f.name, 0) <= MAX_CATEGORIES:
            kinds[f.name] = "categorical"
        else:
            kinds[f.name] = "other"
    return kinds


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in column_kinds(df).items() if kind == "categorical"]


def column_overview(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """One row per column: position, kind, type, missing cells and share, distinct values, and for
    numbers mean, standard deviation, minimum and maximum."""
    parts = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(df.schema):
        parts.append(F.count_if(is_missing(df, f.name)).alias(f"m{i}"))
        if is_number(f.dataType):
            v = known(df, f.name).cast("double")
            parts += [F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"), F.count(v).alias(f"c{i}"),
                      F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    wide = df.agg(*parts)
    none = F.lit(None).cast("double")
    rows = []
    for i, f in enumerate(df.schema):
        num = is_number(f.dataType)
        # The spread of a single value is 0.
        std = F.when(F.col(f"c{i}") == 1, 0.0).otherwise(F.col(f"s{i}")) if num else none
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("n").alias("row_count"), F.col(f"m{i}").alias("null_count"),
            F.coalesce(F.try_divide(F.col(f"m{i}") * 100.0, "n"), F.lit(0.0)).alias("null_pct"),
            (F.col(f"a{i}") if num else none).alias("mean"), std.alias("std"),
            (F.col(f"l{i}") if num else none).alias("min"), (F.col(f"h{i}") if num else none).alias("max"),
        ))
    stats = wide.select(F.inline(F.array(*rows)))
    unique = distinct_counts(df, df.columns, approx=approx)
    joined = stats.join(F.broadcast(unique), "column", "left")  # one row per column
    kind = F.lit(None).cast("string")
    count = F.coalesce("unique_count", F.lit(0))
    for f in df.schema:
        kind = F.when(F.col("column") == f.name, _kind(f.dataType, count)).otherwise(kind)
    return joined.select(
        "position", "column", kind.alias("kind"), "dtype", "row_count", "null_count", "null_pct",
        count.alias("unique_count"), "mean", "std", "min", "max")


def table_info(df: DataFrame) -> DataFrame:
    """Row and column counts with type, missing cells and distinct values per column."""
    return column_overview(df).select(
        "position", "row_count", F.lit(len(df.columns)).alias("column_count"), "column", "dtype",
        "null_count", "unique_count")


def missing_summary(df: DataFrame) -> DataFrame:
    """Columns with missing cells, most first: (column, null_count, null_pct)."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    rows = wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"m{i}").alias("null_count"),
                 F.try_divide(F.col(f"m{i}") * 100.0, "n").alias("null_pct"))
        for i, c in enumerate(df.columns)])))
    return rows.where("null_count > 0").orderBy(F.desc("null_count"), "position").drop("position")


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, spread, five-number summary, range and IQR of each numeric column."""
    names = [c for c in (resolve_columns(df, columns) if columns else df.columns) if is_number(data_type(df, c))]
    quartiles = column_quantiles(df, names, [0.25, 0.5, 0.75])
    parts = []
    for i, c in enumerate(names):
        v = known(df, c).cast("double")
        parts += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                  F.var_samp(v).alias(f"v{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    one = lambda i, letter: F.when(F.col(f"n{i}") == 1, 0.0).otherwise(F.col(f"{letter}{i}"))
    rows = []
    for i, c in enumerate(names):
        q1, q2, q3 = (F.lit(q).cast("double") for q in quartiles[c])
        rows.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"a{i}").alias("mean"),
            one(i, "s").alias("std"), one(i, "v").alias("variance"), F.col(f"l{i}").alias("min"),
            q1.alias("q1"), q2.alias("median"), q3.alias("q3"), F.col(f"h{i}").alias("max"),
            (F.col(f"h{i}") - F.col(f"l{i}")).alias("range"), (q3 - q1).alias("iqr")))
    return df.agg(*parts).select(F.inline(F.array(*rows))).where("count > 0")


def category_summary(df: DataFrame, column: str) -> DataFrame:
    """Valid cells, distinct values, and the mode with its count and share."""
    counted = frequencies(df, column)
    best = F.struct((-F.col("count")).alias("n"), "value")
    one = counted.agg(
        F.sum("count").alias("count"), F.count("value").alias("unique"),
        F.min_by("value", best).alias("mode"), F.max("count").alias("mode_count"))
    return one.where("count > 0").withColumn("mode_pct", F.col("mode_count") / F.col("count") * 100)


def pair_kind(kinds: dict[str, str], x: str, y: str) -> str:
    short = {"numeric": "num", "categorical": "cat"}
    a, b = short.get(kinds[x]), short.get(kinds[y])
    return f"{a}_{b}" if a and b else "other"


def chart_suggestions(df: DataFrame) -> DataFrame:
    """(column, kind, chart, charts) with the default chart first among the options."""
    kinds = column_overview(df).select("position", "column", "kind")
    options = F.create_map(*[x for k, v in CHARTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    choice = options[F.col("kind")]
    return kinds.select("column", "kind", choice[0].alias("chart"), F.concat_ws(",", choice).alias("charts"))


def pair_chart_suggestions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    kinds = column_kinds(df)
    rows = []
    for x, y in pairs:
        kind = pair_kind(kinds, require_column(df, x), require_column(df, y))
        rows.append((x, y, kind, PAIR_CHARTS[kind][0], ",".join(PAIR_CHARTS[kind])))
    return df.sparkSession.createDataFrame(rows, "x string, y string, pair_kind string, chart string, charts string")


def default_column(df: DataFrame) -> str | None:
    return next(iter([*numeric_columns(df), *df.columns]), None)


def default_pair(df: DataFrame) -> tuple[str | None, str | None]:
    """The first two numeric columns, else the first two columns, else one column twice."""
    names = numeric_columns(df) if len(numeric_columns(df)) >= 2 else df.columns
    if not names:
        return None, None
    return names[0], names[1] if len(names) > 1 else names[0]


def plot_sample(
    df: DataFrame, order_by: str | Sequence[str], *, rows: int = PLOT_ROWS, seed: int = SEED
) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of the row key: the same rows on every run."""
    keys = order_key(df, order_by)
    ticket = F.xxhash64(F.lit(seed), *[col(k) for k in keys])
    return df.orderBy(ticket, *[col(k) for k in keys]).limit(rows)


