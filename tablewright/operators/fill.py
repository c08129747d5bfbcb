"""Filling missing values from one scalar or from neighbouring rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import data_type, is_missing, is_number, known, present
from ..functions.naming import require_column, resolve_columns
from ..functions.values import parse_cell
from .ordering import carried
from .quantiles import column_quantiles


def fill_direction(
    df: DataFrame, column: str, order_by: str | Sequence[str], *, forward: bool = True
) -> DataFrame:
    """Carry values over NULLs in key order; blank text is a value here. No fallback."""
    return carried(df, column, order_by, forward=forward)


def fill_value(df: DataFrame, column: str, text: str) -> DataFrame:
    """Fill NULLs (not blanks) with a typed constant; unknown column: as is."""
    if column not in df.columns:
        return df
    value = parse_cell(F.lit(text), data_type(df, column))
    return df.withColumn(column, F.coalesce(known(df, column), value))


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent present value and its count; the smaller value wins a tie."""
    name = require_column(df, column)
    return (
        df.select(present(df, name).alias("value")).where("value is not null")
        .groupBy("value").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value").limit(1)
    )


def fill_scalar(df: DataFrame, column: str, method: str, *, constant: str | None = None):
    """The value a fill method would put into missing cells."""
    name = require_column(df, column)
    if method == "constant":
        if constant is None or not str(constant).strip():
            raise ValueError("a constant fill needs a value")
        return df.sparkSession.range(1).select(
            parse_cell(F.lit(str(constant)), data_type(df, name))).first()[0]
    if method == "mode":
        top = most_frequent(df, name).first()
        value = None if top is None else top["value"]
    elif method == "median":
        if not is_number(data_type(df, name)):
            raise ValueError("a median needs a numeric column")
        value = column_quantiles(df, [name], [0.5])[name][0]
    elif method in ("mean", "min", "max"):
        pick = {"mean": F.avg, "min": F.min, "max": F.max}[method]
        value = df.agg(pick(present(df, name))).first()[0]
    else:
        raise ValueError(f"unsupported fill method: {method}")
    if value is None:
        raise ValueError("no value to fill from")
    return value


def fill_missing(
    df: DataFrame,
    column: str,
    method: str,
    *,
    constant: str | None = None,
    order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Fill NULL, NaN and blank cells of one column.

    ffill/bfill fall back to the other direction. A mean or median can need a fraction, so an integer
    column becomes double then.
    """
    name = require_column(df, column)
    if method in ("ffill", "bfill"):
        if order_by is None:
            raise ValueError("a directional fill needs order_by")
        return carried(df, name, order_by, forward=method == "ffill", both_ways=True, blanks=True)
    if method != "constant" and not missing_counts(df, [name]).where("missing > 0").take(1):
        return df
    value = fill_scalar(df, name, method, constant=constant)
    filler: Column = F.lit(value)
    if method in ("mode", "min", "max", "constant"):
        filler = filler.cast(data_type(df, name))
    return df.withColumn(name, F.coalesce(present(df, name), filler))


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (column, missing): cells each column would have filled, from one scan."""
    names = resolve_columns(df, columns) if columns else df.columns
    counts = df.agg(*[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(names)]
    return counts.select(F.inline(F.array(*pairs)))


def fill_targets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells per numeric column that a model-based fill would replace."""
    names = [c for c in resolve_columns(df, columns) if is_number(data_type(df, c))]
    return missing_counts(df, names)
