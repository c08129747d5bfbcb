"""Row order at scale: row numbers, running totals and carried values without a global window.

A table has no positional index, so order-sensitive operators take ``order_by``: ascending columns
that identify a row. Rows are cut into balanced ranges of that key; each range is windowed on its own
and the ranges are chained by a summary with one row per range. The cut points come from a sample and
are embedded in the plan as constants, so every use of the ranges, and every retry, agrees. A table that
fits one range is windowed directly.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import SEED
from ..functions.missing import data_type, known, present
from ..functions.naming import col, require_column, temp_name

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 16_384
_SAMPLE_PER_RANGE = 30


def order_key(df: DataFrame, order_by: str | Sequence[str]) -> list[str]:
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    if not names:
        raise ValueError("order_by must name at least one column")
    return [require_column(df, n) for n in names]


def position(df: DataFrame, order_by: str | Sequence[str]) -> Column:
    """The row key as one comparable value; a single column stays plain, which aggregates faster."""
    names = order_key(df, order_by)
    return col(names[0]) if len(names) == 1 else _key(names)


def _key(names: Sequence[str]) -> Column:
    return F.struct(*[col(n).alias(f"k{i}") for i, n in enumerate(names)])


def range_cuts(df: DataFrame, order_by: Sequence[str], rows_per_range: int | None = None) -> list:
    """Cut points (key structs, ascending) that split ``df`` into about equal ranges.

    The sample is bounded by the number of ranges, never by the data.
    """
    df = df.select(*[col(n) for n in order_by])
    total = df.count()
    ranges = min(MAX_RANGES, -(-total // (rows_per_range or ROWS_PER_RANGE)))
    if ranges <= 1:
        return []
    share = min(1.0, ranges * _SAMPLE_PER_RANGE / total)
    keys = df.select(_key(order_by).alias("k"))
    picked = keys.sample(fraction=share, seed=SEED) if share < 1.0 else keys
    # Ranking the sample stays in Spark: one row per sampled key, then every n-th is a cut.
    size = F.lit(float(ranges))
    tile = F.floor(F.percent_rank().over(Window.orderBy("k")) * size)
    cuts = (
        picked.select("k", tile.alias("tile"))
        .groupBy("tile").agg(F.min("k").alias("k"))
        .where("tile > 0").orderBy("k").limit(MAX_RANGES)
    )
    return [row["k"] for row in cuts.collect()]


def range_of(df: DataFrame, order_by: Sequence[str], cuts: list) -> Column:
    """Range number of a row: a binary search of its key among the constant cut points."""
    types = [data_type(df, n) for n in order_by]
    bounds = F.array(*[
        F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(cut, types))])
        for cut in cuts
    ])
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    key = _key(order_by)

    def advance(low: Column, step: Column) -> Column:
        return F.when(F.get(bounds, low + step - 1) <= key, low + step).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def _before(part: str) -> Window:
    # One row per range (MAX_RANGES at most), so a single-task window is bounded.
    return Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)


def with_running_total(
    df: DataFrame,
    order_by: str | Sequence[str],
    amount: Column,
    name: str,
    *,
    rows_per_range: int | None = None,
    cut_by: DataFrame | None = None,
) -> DataFrame:
    """Add the sum of ``amount`` over all rows up to and including this one.

    ``cut_by`` is a cheaper table with about the same keys to take the cut points from.
    """
    keys = order_key(df, order_by)
    cuts = range_cuts(df if cut_by is None else cut_by, keys, rows_per_range)
    upto = (Window.unboundedPreceding, 0)
    if not cuts:
        return df.withColumn(name, F.sum(amount).over(Window.orderBy(*[col(k) for k in keys]).rowsBetween(*upto)))
    part, offset = temp_name(df, "range"), temp_name(df, "offset")
    ranged = df.withColumn(part, range_of(df, keys, cuts))
    inside = Window.partitionBy(part).orderBy(*[col(k) for k in keys]).rowsBetween(*upto)
    totals = ranged.groupBy(part).agg(F.sum(amount).alias(offset))
    offsets = totals.select(part, F.coalesce(F.sum(offset).over(_before(part)), F.lit(0)).alias(offset))
    local = ranged.withColumn(name, F.sum(amount).over(inside))
    joined = local.join(F.broadcast(offsets), part, "left")  # one row per range
    return joined.withColumn(name, col(name) + col(offset)).drop(part, offset)


def with_row_number(
    df: DataFrame,
    order_by: str | Sequence[str],
    name: str,
    *,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in key order."""
    return with_running_total(
        df, order_by, F.lit(1).cast("bigint"), name, rows_per_range=rows_per_range)


def carried(
    df: DataFrame,
    column: str,
    order_by: str | Sequence[str],
    *,
    forward: bool = True,
    both_ways: bool = False,
    blanks: bool = False,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Fill gaps in ``column`` with the nearest earlier (or later) value in key order.

    ``both_ways`` falls back to the opposite side; ``blanks`` also treats blank text as a gap.
    """
    keys = order_key(df, order_by)
    target = require_column(df, column)
    value = present(df, target) if blanks else F.when(~_gap(df, target), col(target))
    cuts = range_cuts(df, keys, rows_per_range)
    part, gapless = temp_name(df, "range"), temp_name(df, "value")
    result = df.withColumn(gapless, value)
    spec = Window
    if cuts:
        result = result.withColumn(part, range_of(df, keys, cuts))
        spec = Window.partitionBy(part)
    ranged, choices = result, [col(gapless)]
    for ahead in ([forward, not forward] if both_ways else [forward]):
        # A backward fill runs forward over the reversed order, which keeps the frame incremental.
        order = [col(k).asc() if ahead else col(k).desc() for k in keys]
        inside = spec.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        choices.append(F.last(gapless, ignorenulls=True).over(inside))
        if not cuts:
            continue
        carry = temp_name(df, "carry_down" if ahead else "carry_up")
        at = F.when(col(gapless).isNotNull(), _key(keys))
        edges = ranged.groupBy(part).agg((F.max_by if ahead else F.min_by)(col(gapless), at).alias(carry))
        chain = Window.orderBy(F.asc(part) if ahead else F.desc(part)).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select(part, F.last(carry, ignorenulls=True).over(chain).alias(carry))
        result = result.join(F.broadcast(edges), part, "left")  # one row per range
        choices.append(col(carry))
    if not blanks:
        choices.append(col(target))
    result = result.withColumn(target, F.coalesce(*choices))
    return result.select(*[col(c) for c in df.columns])


def _gap(df: DataFrame, name: str) -> Column:
    c = col(name)
    return c.isNull() | F.isnan(c) if data_type(df, name).typeName() in ("double", "float") else c.isNull()


def stable_sort(df: DataFrame, column: str, order_by: str | Sequence[str], *, ascending: bool = True) -> DataFrame:
    """Sort by one column, missing values last either way, ties in key order. Unknown column: as is."""
    if column not in df.columns:
        return df
    value = known(df, column)
    lead = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    return df.orderBy(lead, *[col(k) for k in order_key(df, order_by)])
