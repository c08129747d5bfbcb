"""Duplicate rows and values."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.missing import compact_key, data_type, is_floating, is_missing, is_text, known, nan_to_null
from ..functions.naming import col, resolve_columns, temp_name
from ..functions.values import value_label
from .ordering import order_key
from .skew import first_per_key, join_lookup


def _columns(df: DataFrame, columns: str | Sequence[str]) -> list[str]:
    names = resolve_columns(df, [columns] if isinstance(columns, str) else columns)
    if not names:
        raise ValueError("no known column to check for duplicates")
    return names


def drop_duplicates(
    df: DataFrame,
    subset: str | Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """One row per distinct row, or the first row per distinct ``subset`` value (missing equals missing)."""
    if subset is None:
        return nan_to_null(df).dropDuplicates()
    if order_by is None:
        raise ValueError("keeping the first row per value needs order_by")
    return first_per_key(nan_to_null(df), _columns(df, subset), order_key(df, order_by))


def with_duplicate_flag(
    df: DataFrame, columns: str | Sequence[str], *, dropna: bool = True, name: str = "is_duplicate"
) -> DataFrame:
    """Flag rows whose value in at least one of ``columns`` occurs more than once in that column.

    Repeated values are found by a partial aggregation and joined back, so no task ever holds all rows
    of one value.
    """
    out = df
    flags = []
    for i, c in enumerate(_columns(df, columns)):
        value = F.when(~is_missing(df, c), col(c)) if dropna else known(df, c)
        value = compact_key(value, data_type(df, c))
        flag, key = temp_name(out, f"repeated_{i}"), temp_name(out, f"value_{i}")
        out = out.withColumn(key, value)
        repeated = (
            out.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
            .select(key, F.lit(True).alias(flag))
        )
        if dropna:
            repeated = repeated.where(col(key).isNotNull())
        out = join_lookup(out, repeated, [key], null_safe=not dropna)
        flags.append(F.coalesce(col(flag), F.lit(False)))
    test = flags[0]
    for f in flags[1:]:
        test = test | f
    return out.select(*[col(c) for c in df.columns], test.alias(name))


def duplicate_rows(df: DataFrame, columns: str | Sequence[str], *, dropna: bool = True) -> DataFrame:
    flag = temp_name(df, "dup")
    return with_duplicate_flag(df, columns, dropna=dropna, name=flag).where(col(flag)).drop(flag)


def _value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, text, label, missing, n) per distinct value of each column, in one shuffle of the texts."""
    def text(c: str) -> Column:
        value = known(df, c)
        return (value + F.lit(0.0) if is_floating(data_type(df, c)) else value).cast("string")  # -0.0 is 0.0

    cells = [F.struct(F.lit(c).alias("column"), text(c).alias("text")) for c in names]
    counted = (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))
    )
    label, missing = F.lit(None).cast("string"), F.lit(False)
    for c in names:
        here, dtype = F.col("column") == c, data_type(df, c)
        label = F.when(here, value_label(F.col("text").try_cast(dtype), dtype)).otherwise(label)
        missing = F.when(here, is_missing(counted, "text") if is_text(dtype) else F.col("text").isNull()).otherwise(missing)
    return counted.select("column", "text", label.alias("label"), missing.alias("missing"), "n")


def duplicate_report(
    df: DataFrame, columns: str | Sequence[str], *, dropna: bool = True
) -> DataFrame:
    """One row per column: rows, distinct values, missing cells, repeated values and their rows."""
    counted = _value_counts(df, _columns(df, columns))
    repeated = (F.col("n") > 1) & (~F.col("missing") if dropna else F.lit(True))
    return counted.groupBy("column").agg(
        F.sum("n").alias("total_rows"),
        F.count("text").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("missing"), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count_if(repeated).alias("duplicate_value_count"),
        F.coalesce(F.sum(F.when(repeated, F.col("n"))), F.lit(0)).alias("duplicate_row_count"),
    )


def duplicate_values(
    df: DataFrame, columns: str | Sequence[str], *, dropna: bool = True, listed: int | None = None
) -> DataFrame:
    """The repeated values of each column: (column, value, count), all or the ``listed`` most repeated per column."""
    counted = _value_counts(df, _columns(df, columns)).where("n > 1")
    if dropna:
        counted = counted.where(~F.col("missing"))
    shown = [F.col("column"), F.col("label").alias("value"), F.col("n").alias("count")]
    if listed is None:
        return counted.select(*shown)
    # The rank filter keeps ``listed`` rows per column and task before the ranking shuffle.
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "label"))
    return (
        counted.withColumn("rank", rank).where(F.col("rank") <= listed)
        .select(*shown)
    )
