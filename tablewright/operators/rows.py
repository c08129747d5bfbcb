"""Filters, row edits, cell edits and find/replace."""
from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.missing import any_missing, as_text, data_type, is_missing, is_text, known
from ..functions.naming import col, require_column, resolve_columns
from ..functions.values import parse_cell
from .ordering import stable_sort, with_row_number


# ---------------------------------------------------------------- filters

def match_text(df: DataFrame, query: str, column: str | None = None, *, exact: bool = False) -> Column:
    """Case-blind test of one column, or of any column, against ``query``.

    A substring test is false for NULL; NaN is no value either. An exact test is unknown for NULL, so such a row passes
    neither the test nor its negation unless another column matches.
    """
    names = [require_column(df, column)] if column is not None else df.columns
    needle = F.lit(query.strip().lower())
    tests = []
    for n in names:
        text = F.lower(as_text(known(df, n), data_type(df, n)))
        tests.append(text == needle if exact else F.coalesce(text.contains(needle), F.lit(False)))
    return reduce(lambda a, b: a | b, tests)


def search(
    df: DataFrame,
    query: str,
    column: str | None = None,
    *,
    exact: bool = False,
    exclude: bool = False,
) -> DataFrame:
    """Rows that match ``query``; an empty query with a column keeps the rows missing a value there."""
    if query.strip():
        test = match_text(df, query, column, exact=exact)
    elif column is None:
        return df
    else:
        test = is_missing(df, require_column(df, column))
    return df.where(~test if exclude else test)


def search_sorted(
    df: DataFrame, query: str, sort_by: str, order_by: str | Sequence[str], *,
    ascending: bool = True, **options,
) -> DataFrame:
    return stable_sort(search(df, query, **options), sort_by, order_by, ascending=ascending)


def drop_missing_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with a value in every column of ``subset`` (default: all columns)."""
    names = resolve_columns(df, subset) if subset else df.columns
    return df.where(~any_missing(df, names))


# ---------------------------------------------------------------- rows by id

def _ids(df: DataFrame, ids: Sequence[object] | DataFrame, row_id: str) -> DataFrame:
    """Distinct requested ids with the position of their first mention."""
    if isinstance(ids, DataFrame):
        return ids.groupBy(col(ids.columns[0]).alias("__id")).agg(F.min(col(ids.columns[1])).alias("__pos"))
    dtype = data_type(df, row_id)
    unique = list(dict.fromkeys(str(i) for i in ids))
    rows = [(text, pos) for pos, text in enumerate(unique)]
    listed = df.sparkSession.createDataFrame(rows, "__text string, __pos long")
    return listed.select(F.col("__text").try_cast(dtype).alias("__id"), "__pos").where("__id is not null")


def extract_rows(df: DataFrame, ids: Sequence[object] | DataFrame, row_id: str) -> DataFrame:
    """The listed rows in the order asked for. A table of ids has columns (id, position)."""
    row_id = require_column(df, row_id)
    wanted = _ids(df, ids, row_id)
    return (
        df.join(wanted, col(row_id) == F.col("__id"))
        .orderBy("__pos").select(*[col(c) for c in df.columns])
    )


def delete_rows(df: DataFrame, ids: Sequence[object] | DataFrame, row_id: str) -> DataFrame:
    row_id = require_column(df, row_id)
    return df.join(_ids(df, ids, row_id), col(row_id) == F.col("__id"), "left_anti")


def clear_rows(df: DataFrame, ids: Sequence[object] | DataFrame, row_id: str) -> DataFrame:
    """Empty every column but the row id, which stands for the index, in the listed rows."""
    row_id = require_column(df, row_id)
    marked = df.join(_ids(df, ids, row_id), col(row_id) == F.col("__id"), "left")
    return marked.select(*[
        col(c) if c == row_id else F.when(F.col("__pos").isNull(), col(c)).alias(c) for c in df.columns])


# ---------------------------------------------------------------- blank rows

def _blank_rows(df: DataFrame, count: int, number: str, first: Column) -> DataFrame:
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    return df.sparkSession.range(count).select(*empty, (F.col("id") + first).alias(number))


def insert_blank_rows(
    df: DataFrame,
    beside: object,
    row_id: str,
    order_by: str | Sequence[str],
    *,
    side: str = "below",
    count: int = 1,
    number: str = "row_no",
) -> DataFrame:
    """Put ``count`` empty rows above or below one row; ``number`` is the new 1-based row number.

    The shift is arithmetic on the row numbers, so the table is ordered once. Unknown row: only numbered.
    """
    numbered = with_row_number(df, order_by, number)
    anchor = numbered.where(col(row_id) == F.lit(beside).cast(data_type(df, row_id))).select(number).head()
    if anchor is None or count <= 0:
        return numbered
    at = anchor[0] + (1 if side == "below" else 0)
    moved = numbered.withColumn(number, col(number) + F.when(col(number) >= at, count).otherwise(0))
    return moved.unionByName(_blank_rows(df, count, number, F.lit(at)))


def append_blank_rows(
    df: DataFrame, order_by: str | Sequence[str], *, count: int = 1, number: str = "row_no"
) -> DataFrame:
    numbered = with_row_number(df, order_by, number)
    return numbered.unionByName(_blank_rows(df, count, number, F.lit(df.count() + 1)))


# ---------------------------------------------------------------- cell edits

_UPDATE_SCHEMA = "row_id string, column string, value string"


def cell_updates(spark, cells: Sequence[tuple[object, str, str]]) -> DataFrame:
    """A table of edits (row id, column, text) with their order; later edits of a cell win."""
    rows = [(str(r), str(c), v, i) for i, (r, c, v) in enumerate(cells)]
    return spark.createDataFrame(rows, _UPDATE_SCHEMA + ", seq long")


def _latest(df: DataFrame, updates: DataFrame, row_id: str) -> DataFrame:
    known = updates.where(F.col("column").isin(df.columns))
    key = F.col("row_id").try_cast(data_type(df, row_id))
    return (
        known.groupBy(key.alias("__id"), "column")
        .agg(F.max_by(F.struct("value"), "seq")["value"].alias("value"))
    )


def apply_updates(df: DataFrame, updates: DataFrame, row_id: str) -> DataFrame:
    """Set cells from an edit table (row_id, column, value, seq).

    Text is read by the column's type; blank or unreadable text empties the cell. Edits of unknown
    rows or columns have no effect.
    """
    row_id = require_column(df, row_id)
    latest = _latest(df, updates, row_id)
    wide = latest.groupBy("__id").agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("value")))).alias("__cells"))
    joined = df.join(wide, col(row_id) == F.col("__id"), "left")
    out = []
    for f in df.schema:
        edit = F.col("__cells")[F.lit(f.name)]
        out.append(F.when(edit.isNotNull(), parse_cell(edit["value"], f.dataType))
                   .otherwise(col(f.name)).alias(f.name))
    return joined.select(*out)


def unreadable_updates(df: DataFrame, updates: DataFrame, row_id: str) -> DataFrame:
    """Edits whose text the target column's type cannot hold."""
    latest = _latest(df, updates, require_column(df, row_id))
    bad = reduce(lambda a, b: a | b, [
        (F.col("column") == f.name) & parse_cell(F.col("value"), f.dataType).isNull() for f in df.schema])
    filled = parse_cell(F.col("value"), T.StringType()).isNotNull()
    return latest.where(bad & filled).select(F.col("__id").alias("row_id"), "column", "value")


def clear_cells(df: DataFrame, cells: Sequence[tuple[object, str]], row_id: str) -> DataFrame:
    edits = cell_updates(df.sparkSession, [(r, c, "") for r, c in cells])
    return apply_updates(df, edits, row_id)


# ---------------------------------------------------------------- find / replace

def find_replace(
    df: DataFrame,
    find: str,
    replace: str,
    *,
    columns: str | Sequence[str] | None = None,
    match_case: bool = False,
    ids: Sequence[object] | DataFrame | None = None,
    row_id: str | None = None,
) -> DataFrame:
    """Replace literal text in text columns; in other columns a value whose text contains it.

    A non-text column with a match becomes text, as the new value need not fit its type; one pass over
    those columns tells which have one. NULL never matches.
    """
    if find == "":
        raise ValueError("nothing to find")
    if columns is None:
        targets = df.columns
    else:
        targets = resolve_columns(df, [columns] if isinstance(columns, str) else columns)
    if not targets:
        return df
    scope: Column | None = None
    work = df
    if ids is not None:
        row_id = require_column(df, row_id)
        work = df.join(_ids(df, ids, row_id), col(row_id) == F.col("__id"), "left")
        scope = F.col("__pos").isNotNull()
    typed = [c for c in targets if not is_text(data_type(df, c))]
    holds = {c: as_text(known(df, c), data_type(df, c)).contains(F.lit(find)) for c in typed}
    if typed:
        inside = F.lit(True) if scope is None else scope
        hits = work.agg(*[F.max(test & inside) for test in holds.values()]).first()
        targets = [c for c in targets if c not in holds or hits[typed.index(c)]]
    pattern = ("" if match_case else "(?iu)") + re.escape(find)
    with_text = replace.replace("\\", "\\\\").replace("$", "\\$")
    out = []
    for c in df.columns:
        if c not in targets:
            out.append(col(c))
            continue
        text = as_text(known(df, c), data_type(df, c))
        if c not in holds:
            new = F.replace(text, F.lit(find), F.lit(replace)) if match_case else (
                F.regexp_replace(text, pattern, with_text))
        else:
            new = F.when(holds[c], F.lit(replace)).otherwise(text)
        out.append((new if scope is None else F.when(scope, new).otherwise(text)).alias(c))
    return work.select(*out)


def preview(df: DataFrame, rows: int) -> DataFrame:
    return df.limit(rows)


def with_row_ids(df: DataFrame, name: str = "_rid") -> DataFrame:
    """Number rows in load order: increasing along the files of a scan, not consecutive."""
    return df.select(F.monotonically_increasing_id().alias(name), *[col(c) for c in df.columns])


def apply_function(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run user code on the table; it must hand back a table."""
    result = fn(df)
    if not isinstance(result, DataFrame):
        raise TypeError("the function must return a DataFrame")
    return result
