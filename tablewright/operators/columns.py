"""Projection and column shape: narrow transforms that stay in one code-generated stage."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import NEW_COLUMN_NAME
from ..functions import values
from ..functions.missing import as_text, data_type, is_missing, is_number, present
from ..functions.naming import (
    col, dedupe_names, require_column, resolve_columns, temp_name, unique_name)
from .ordering import with_row_number


def select_columns(df: DataFrame, names: Sequence[object]) -> DataFrame:
    """Known columns among ``names`` in request order."""
    return df.select(*[col(c) for c in resolve_columns(df, names)])


def normalize_names(df: DataFrame) -> DataFrame:
    return df.toDF(*dedupe_names(df.columns))


def convert_type(df: DataFrame, column: str, target: str) -> DataFrame:
    name = require_column(df, column)
    return df.withColumn(name, values.convert(col(name), data_type(df, name), target))


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    name = require_column(df, old)
    if new != name and new in df.columns:
        raise ValueError(f"column {new!r} already exists")
    return df.withColumnRenamed(name, new)


def delete_columns(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    wanted = [names] if isinstance(names, str) else names
    return df.drop(*resolve_columns(df, wanted))


def _constant(value: object) -> Column:
    return F.lit(None).cast("string") if value is None else F.lit(value)


def _free(df: DataFrame, name: str | None) -> str:
    if name is None:
        return unique_name(df.columns, NEW_COLUMN_NAME)
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")
    return name


def add_column(df: DataFrame, name: str, value: object = "") -> DataFrame:
    return df.withColumn(_free(df, name), _constant(value))


def append_column(df: DataFrame, name: str | None = None, value: object = None) -> DataFrame:
    """Add a constant column at the end under a given or an automatic name."""
    return df.withColumn(_free(df, name), _constant(value))


def insert_column(
    df: DataFrame, beside: str, side: str = "right", name: str | None = None, value: object = None
) -> DataFrame:
    anchor = require_column(df, beside)
    fresh = _constant(value).alias(_free(df, name))
    out = []
    for c in df.columns:
        pair = [col(c), fresh] if side == "right" else [fresh, col(c)]
        out += pair if c == anchor else [col(c)]
    return df.select(*out)


def duplicate_column(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    source = require_column(df, column)
    target = _free(df, name) if name else unique_name(df.columns, f"{source}_copy")
    return df.withColumn(target, col(source))


def move_column(df: DataFrame, column: str, to: str) -> DataFrame:
    """Put ``column`` at the position ``to`` has now; unknown names change nothing."""
    names = df.columns
    if column not in names or to not in names or column == to:
        return df
    place = names.index(to)
    rest = [c for c in names if c != column]
    rest.insert(place, column)
    return df.select(*[col(c) for c in rest])


def merge_columns(
    df: DataFrame, columns: Sequence[str], name: str, *, separator: str = "", drop_sources: bool = True
) -> DataFrame:
    """Join the texts of two or more columns, in table order; a missing value counts as ''."""
    chosen = set(resolve_columns(df, columns))
    sources = [c for c in df.columns if c in chosen]
    if len(sources) < 2:
        raise ValueError("merging needs at least two known columns")
    target = name.strip()
    if not target:
        raise ValueError("the merged column needs a name")
    if target in df.columns:
        raise ValueError(f"column {target!r} already exists")
    texts = [F.coalesce(as_text(present(df, c), data_type(df, c)), F.lit("")) for c in sources]
    merged = F.concat_ws(separator, *texts).alias(target)
    out: list[Column] = []
    for c in df.columns:
        if c == sources[0]:
            out.append(merged)
        if not (drop_sources and c in chosen):
            out.append(col(c))
    return df.select(*out)


def read_separator(text: str) -> str:
    """The typed forms of tab and newline as the characters themselves."""
    return {r"\t": "\t", r"\n": "\n"}.get(text, text)


def _parts(df: DataFrame, name: str, separator: str) -> Column:
    # A missing value has no parts; split() takes a pattern, so the separator is quoted.
    return F.split(as_text(present(df, name), data_type(df, name)), re.escape(separator), -1)


def split_column(
    df: DataFrame,
    column: str,
    separator: str,
    *,
    prefix: str | None = None,
    drop_source: bool = False,
    max_parts: int | None = None,
) -> DataFrame:
    """Cut a column at a literal separator into ``prefix_1``, ``prefix_2`` … before the source.

    The width is the largest number of parts, which takes one pass; ``max_parts`` states it instead.
    """
    name = require_column(df, column)
    if separator == "":
        raise ValueError("the separator is empty")
    stem = (prefix or name).strip()
    if not stem:
        raise ValueError("the new columns need a name prefix")
    parts = _parts(df, name, separator)
    width = max_parts or df.agg(F.max(F.size(parts))).first()[0] or 1
    taken = list(df.columns)
    pieces = []
    for i in range(max(width, 1)):
        label = unique_name(taken, f"{stem}_{i + 1}")
        taken.append(label)
        pieces.append(F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(label))
    out: list[Column] = []
    for c in df.columns:
        if c == name:
            out += pieces
        if not (drop_source and c == name):
            out.append(col(c))
    return df.select(*out)


def clear_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    gone = set(resolve_columns(df, names))
    return df.select(*[
        F.lit(None).cast(f.dataType).alias(f.name) if f.name in gone else col(f.name) for f in df.schema])


def fill_sequence(
    df: DataFrame, column: str, order_by: str | Sequence[str], *, start: int = 1, step: int = 1
) -> DataFrame:
    """Overwrite a column with start, start + step, … in key order; unknown column: as is."""
    if column not in df.columns:
        return df
    place = temp_name(df, "place")
    # The overwritten column may be part of the key, so it stays readable until the numbers exist.
    numbered = with_row_number(df, order_by, place)
    value = (col(place) - 1) * step + start
    return numbered.select(*[value.alias(c) if c == column else col(c) for c in df.columns])


def fill_methods(df: DataFrame, column: str) -> list[str]:
    """Fill methods a column of this type offers."""
    name = require_column(df, column)
    numeric = ["mean", "median", "min", "max", "knn", "mice"] if is_number(data_type(df, name)) else []
    return [*numeric, "mode", "ffill", "bfill", "constant"]
