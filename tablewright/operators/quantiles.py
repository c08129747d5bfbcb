"""Exact quantiles (linear interpolation) without holding a column or a group in one task.

Whole columns: every wanted rank is searched by histograms. A pass counts the rows per bin (partial
aggregation, a bounded number of bins) and the next pass looks only into the bin that holds the rank.

Groups: equal values are counted per group, the counts are put in (group, value) order and cut into
balanced ranges, so a group that holds most of the rows is shared by many tasks.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.missing import data_type, is_number, known
from ..functions.naming import col
from .ordering import range_cuts, range_of

_BINS = 1024


@dataclass
class _Bin:
    """A value interval of one column that is known to hold some of the wanted ranks."""

    column: str
    low: float
    high: float
    below: int
    ranks: list[int]
    inside: list[Column] = field(default_factory=list)

    def bin_of(self, value: Column) -> Column:
        """Equal-width bins; the lowest and the highest value never share one, so a search always ends."""
        last = F.lit(_BINS - 1)
        if math.isinf(self.low) or math.isinf(self.high):
            return F.when(value == F.lit(-math.inf), 0).when(value == F.lit(math.inf), last).otherwise(1)
        step = self.high / _BINS - self.low / _BINS  # finite even where the range is not
        if step == 0.0:
            return F.when(value == self.low, 0).otherwise(1)
        return F.least(F.floor((value - self.low) / step), last).cast("int")


def _search(df: DataFrame, values: dict[str, Column], bins: list[_Bin]) -> tuple[dict, list[_Bin]]:
    """One histogram pass: ranks that are settled, and the narrower bins for the others."""
    tagged, insides = [], []
    for no, b in enumerate(bins):
        v = values[b.column]
        insides.append(reduce(lambda x, y: x & y, b.inside, v.isNotNull()))
        tagged.append(F.struct(
            F.lit(no).alias("no"), b.bin_of(v).alias("bin"), F.when(insides[-1], v).alias("v")))
    rows = (
        df.where(reduce(lambda x, y: x | y, insides))
        .select(F.inline(F.array(*tagged))).where("v is not null")
        .groupBy("no", "bin").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .collect()  # at most _BINS rows per searched bin
    )
    settled, narrower = {}, []
    for no, b in enumerate(bins):
        below = b.below
        for row in sorted((r for r in rows if r["no"] == no), key=lambda r: r["bin"]):
            open_ranks = []
            for rank in b.ranks:
                if not below <= rank < below + row["n"]:
                    continue
                if row["low"] == row["high"] or rank == below:
                    settled[b.column, rank] = row["low"]
                elif rank == below + row["n"] - 1:
                    settled[b.column, rank] = row["high"]
                else:
                    open_ranks.append(rank)
            if open_ranks:
                here = b.bin_of(values[b.column]) == row["bin"]
                narrower.append(_Bin(b.column, row["low"], row["high"], below, open_ranks, [*b.inside, here]))
            below += row["n"]
    return settled, narrower


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Quantiles of several numeric columns, missing values left out; None for an empty column."""
    names = [c for c in columns if is_number(data_type(df, c))]
    if not names:
        return {}
    values = {c: known(df, c).cast("double") for c in names}
    bounds = df.agg(*[
        F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).alias(f"s{i}")
        for i, v in enumerate(values.values())
    ]).first()

    wanted: dict[str, list[float]] = {}
    settled: dict[tuple[str, int], float] = {}
    bins = []
    for name, s in zip(names, bounds):
        if s["n"] == 0:
            continue
        wanted[name] = [p * (s["n"] - 1) for p in probs]
        ranks = sorted({r for h in wanted[name] for r in (math.floor(h), math.ceil(h))})
        bins.append(_Bin(name, s["low"], s["high"], 0, ranks))
    while bins:
        found, bins = _search(df, values, bins)
        settled |= found

    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in names}
    for name, positions in wanted.items():
        for j, h in enumerate(positions):
            a, b = settled[name, math.floor(h)], settled[name, math.ceil(h)]
            out[name][j] = a + (b - a) * (h - math.floor(h)) if a != b else a
    return out


def _group_positions(counted: DataFrame, keys: list[str], cuts: list) -> DataFrame:
    """Add ``upto`` (rows of the group up to this value) and ``n`` (rows of the group).

    ``counted`` holds (keys…, v, c). In (keys, v) order only the first and last group of a range can
    continue in another one, so two rows per range chain the ranges.
    """
    names = [col(k) for k in keys]
    part = "__range"
    ranged = counted.withColumn(part, range_of(counted, [*keys, "v"], cuts)) if cuts else counted
    local = Window.partitionBy(*([part] if cuts else []), *keys)
    running = ranged.select(
        "*",
        F.sum("c").over(local.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("c").over(local.orderBy("v").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
    )
    if not cuts:
        return running
    group = F.struct(*names)
    pieces = ranged.groupBy(part, *keys).agg(F.sum("c").alias("amount"))
    piece = F.struct(group.alias("g"), "amount")
    ends = pieces.groupBy(part).agg(F.array_distinct(F.array(
        F.min_by(piece, group), F.max_by(piece, group))).alias("ends"))
    near = Window.partitionBy("g").orderBy(part)
    ends = ends.select(part, F.inline("ends")).select(
        F.col(part).alias("__p"), F.col("g").alias("__g"),
        F.sum("amount").over(near.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.sum("amount").over(near.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    joined = running.join(
        F.broadcast(ends),  # two rows per range
        (F.col(part) == F.col("__p")) & group.eqNullSafe(F.col("__g")), "left")
    before = F.coalesce("before", F.lit(0))
    return joined.select(
        *names, "v", "c", (F.col("upto") + before).alias("upto"),
        (F.col("n") + before + F.coalesce("after", F.lit(0))).alias("n"))


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probs: Sequence[float],
    *,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Rows (keys…, q0, q1, …): quantiles of one column per group; NULL keys form a group.

    A group without any value has NULL quantiles.
    """
    keys = list(keys)
    names = [f"__g{i}" for i in range(len(keys))]
    slim = df.select(*[col(k).alias(n) for k, n in zip(keys, names)],
                     known(df, column).cast("double").alias("v"))
    cuts = range_cuts(slim, [*names, "v"], rows_per_range)
    # NULL values stay as a zero-weight row, which keeps groups without values.
    counted = slim.groupBy(*names, "v").agg(F.count("v").alias("c"))
    placed = _group_positions(counted, names, cuts)
    picks = []
    for p in probs:
        h = F.lit(float(p)) * (F.col("n") - 1)
        for rank in (F.floor(h), F.ceil(h)):
            covers = (F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto"))
            picks.append(F.max(F.when(covers, F.col("v"))))
    found = placed.groupBy(*names).agg(F.max("n").alias("n"), *[
        pick.alias(f"r{i}") for i, pick in enumerate(picks)])
    out = []
    for j, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("n") - 1)
        a, b = F.col(f"r{2 * j}"), F.col(f"r{2 * j + 1}")
        out.append(F.when(a == b, a).otherwise(a + (b - a) * (h - F.floor(h))).alias(f"q{j}"))
    return found.select(*[col(n).alias(k) for n, k in zip(names, keys)], *out)
