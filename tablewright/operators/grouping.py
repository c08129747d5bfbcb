"""Group summaries, frequencies and per-category tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import OTHER_LABEL
from ..functions.missing import as_text, category_text, data_type, is_missing, known
from ..functions.naming import col, require_column, resolve_columns
from .ordering import position
from .quantiles import group_quantiles


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


# Aggregates with a small mergeable state: a hot group is combined on the map side.
_AGGREGATES = {
    "count": F.count,
    "sum": _sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)),
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "size": lambda c: F.count(F.lit(1)),
}


def group_summary(
    df: DataFrame,
    group_by: str | Sequence[str],
    value: str,
    agg: str = "sum",
    *,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """One aggregate per group under the value column's name, sorted by key; NULL is a group.

    ``first``/``last`` need ``order_by``.
    """
    keys = resolve_columns(df, [group_by] if isinstance(group_by, str) else group_by)
    if not keys or value not in df.columns:
        raise ValueError("unknown group or value column")
    slim = df.withColumns({c: known(df, c) for c in [*keys, value]})
    if isinstance(data_type(df, value), T.BooleanType) and agg in ("sum", "mean", "std", "var", "median"):
        slim = slim.withColumn(value, col(value).cast("int"))  # True counts as 1
    out_name = value
    if agg == "median":
        result = group_quantiles(slim, keys, value, [0.5]).withColumnRenamed("q0", out_name)
    elif agg == "nunique":
        # Distinct pairs first: each group then only counts, so a hot group stays cheap.
        pairs = slim.select(*[col(k) for k in keys], col(value)).distinct()
        result = pairs.groupBy(*[col(k) for k in keys]).agg(F.count(col(value)).alias(out_name))
    elif agg in ("first", "last"):
        if order_by is None:
            raise ValueError(f"{agg} needs order_by")
        order = position(df, order_by)
        pick = F.min_by if agg == "first" else F.max_by
        known_at = F.when(col(value).isNotNull(), order)
        result = slim.groupBy(*[col(k) for k in keys]).agg(pick(col(value), known_at).alias(out_name))
    elif agg in _AGGREGATES:
        result = slim.groupBy(*[col(k) for k in keys]).agg(_AGGREGATES[agg](col(value)).alias(out_name))
    else:
        raise ValueError(f"unsupported aggregate: {agg}")
    return result.orderBy(*[col(k).asc_nulls_last() for k in keys])


def describe_groups(df: DataFrame, category: str, value: str, *, limit: int | None = None) -> DataFrame:
    """Count, mean, standard deviation and median of all categories, or of the first ``limit`` in sort order."""
    slim = df.select(category_text(df, category).alias("group"), known(df, value).alias("v"))
    slim = slim.where("v is not null")
    basic = slim.groupBy("group").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    first, wanted = basic, slim
    if limit is not None:
        first = basic.orderBy("group").limit(limit)
        wanted = slim.join(F.broadcast(first.select("group")), "group", "left_semi")  # limit rows
    medians = group_quantiles(wanted, ["group"], "v", [0.5]).withColumnRenamed("q0", "median")
    return first.join(medians, "group").select("group", "count", "mean", "std", "median")


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of the present values as text."""
    name = require_column(df, column)
    return (
        df.where(~is_missing(df, name)).groupBy(as_text(col(name), data_type(df, name)).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent present values with their share of all present values in percent."""
    counted = frequencies(df, column)
    present = df.where(~is_missing(df, column)).agg(F.count(F.lit(1)).alias("total"))
    total = present.first()["total"]
    return counted.orderBy(F.desc("count"), "value").limit(n).select(
        "value", "count", (F.col("count") / F.lit(max(total, 1)) * 100).alias("pct"))


def top_values_with_other(df: DataFrame, column: str, n: int = 10, *, other: str = OTHER_LABEL) -> DataFrame:
    """Top ``n`` values as category labels and one row for all others."""
    text = category_text(df, require_column(df, column))
    counted = df.groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top = counted.orderBy(F.desc("count"), "value").limit(n)
    totals = counted.agg(F.sum("count").alias("count")).select(F.lit(None).cast("string").alias("value"), "count")
    # Everything beyond the top is the grand total minus the top, so the tail is never ranked.
    both = top.select("value", "count", F.lit(False).alias("rest")).unionByName(
        top.select(F.lit(None).cast("string").alias("value"), (-F.col("count")).alias("count"), F.lit(True).alias("rest"))
    ).unionByName(totals.withColumn("rest", F.lit(True)))
    merged = both.groupBy("rest", "value").agg(F.sum("count").alias("count"))
    return merged.where("not rest or count > 0").select(
        F.when(F.col("rest"), F.lit(other)).otherwise(F.col("value")).alias("value"), "count")


def mean_per_category(
    df: DataFrame, category: str, value: str, order_by: str | Sequence[str], *, limit: int | None = None
) -> DataFrame:
    """Mean per category, for all categories or the ``limit`` seen first in key order."""
    key = position(df, order_by)
    stats = df.groupBy(category_text(df, category).alias("category")).agg(
        F.min(key).alias("seen"), F.avg(known(df, value)).alias("mean"))
    listed = stats.orderBy("seen")
    return (listed if limit is None else listed.limit(limit)).where("mean is not null").select("category", "mean")
