"""Chart data as small tables: histograms, densities, boxes, hexagons and fitted lines."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import category_text, known
from ..functions.naming import col, require_column
from .ordering import position
from .profile import plot_sample
from .quantiles import column_quantiles, group_quantiles
from .skew import join_lookup

KDE_POINTS = 200
VIOLIN_POINTS = 100
HEX_GRID = 35
LINE_POINTS = 50
WHISKER = 1.5


def auto_bins(n: int, most: int) -> int:
    """Bin count for ``n`` values: a twentieth of them, between 10 and ``most``."""
    return min(most, max(10, n // 20))


def _value(df: DataFrame, column: str) -> DataFrame:
    v = known(df, require_column(df, column)).cast("double")
    return df.select(v.alias("v")).where("v is not null")


def _bounds(values: DataFrame) -> tuple[int, float, float] | None:
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    return (n, low, high) if n else None


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, count, density) for equal-width bins; the last bin holds the maximum too."""
    values = _value(df, column)
    facts = _bounds(values)
    if facts is None:
        return df.sparkSession.createDataFrame(
            [], "bin int, low double, high double, count bigint, density double")
    n, low, high = facts
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    number = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
    counted = values.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    count = F.coalesce("count", F.lit(0))
    return every.join(F.broadcast(counted), "bin", "left").select(  # at most ``bins`` rows
        "bin", (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        count.alias("count"), (count / F.lit(n) / F.lit(width)).alias("density"))


def auto_histogram(df: DataFrame, column: str, *, most: int = 40) -> DataFrame:
    return histogram(df, column, auto_bins(_value(df, column).count(), most))


def _density(values: DataFrame, keys: list[str], points: int) -> DataFrame:
    """Gaussian kernel density on an even grid from minimum to maximum, per key (Scott bandwidth).

    Equal values are weighed once; the table of (value, grid point) terms is only aggregated.
    """
    counted = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    facts = [F.count("v").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("low"), F.max("v").alias("high")]
    if keys:
        rows = join_lookup(counted, values.groupBy(*keys).agg(*facts), keys)
    else:
        one = values.agg(*facts).first()
        rows = counted.withColumns({k: F.lit(v).cast("double") for k, v in one.asDict().items()})
    width = F.col("sd") * F.pow(F.col("n"), F.lit(-0.2))
    grid = rows.where("sd > 0").select(
        *keys, "v", "c", "n", width.alias("h"), "low", "high",
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / F.lit(float(points - 1))
    z = (F.col("x") - F.col("v")) / F.col("h")
    term = F.col("c") * F.exp(-0.5 * z * z) / (F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))
    return grid.withColumn("x", x).groupBy(*keys, "point", "x").agg(F.sum(term).alias("density"))


def kernel_density(
    df: DataFrame, column: str, order_by: str | Sequence[str], *, points: int = KDE_POINTS, rows: int | None = None
) -> DataFrame:
    """(point, x, density) of the column; ``rows`` asks for the plot sample instead of the whole table."""
    return _density(_value(_sampled(df, order_by, rows), column), [], points)


def _sampled(df: DataFrame, order_by: str | Sequence[str], rows: int | None) -> DataFrame:
    return df if rows is None else plot_sample(df, order_by, rows=rows)


def violin_density(
    df: DataFrame, category: str, value: str, order_by: str | Sequence[str], *,
    points: int = VIOLIN_POINTS, rows: int | None = None, limit: int | None = None,
) -> DataFrame:
    """(category, point, x, density) of all categories, or of the ``limit`` seen first; ``rows`` asks for a sample."""
    values = _categories(_sampled(df, order_by, rows), category, value, order_by, limit)
    return _density(values, ["category"], points)


def _categories(
    df: DataFrame, category: str, value: str, order_by: str | Sequence[str], limit: int | None
) -> DataFrame:
    """(category, v) rows of all categories, or of the ``limit`` seen first in key order."""
    if limit is None:
        return df.select(category_text(df, category).alias("category"), known(df, value).cast("double").alias("v")).where("v is not null")
    key = position(df, order_by)
    rows = df.select(category_text(df, category).alias("category"),
                     known(df, value).cast("double").alias("v"), key.alias("key"))
    first = rows.groupBy("category").agg(F.min("key").alias("seen")).orderBy("seen").limit(limit)
    kept = rows.join(F.broadcast(first.select("category")), "category", "left_semi")  # ``limit`` rows
    return kept.where("v is not null").select("category", "v")


def _box(q1: Column, q3: Column) -> list[Column]:
    low, high = q1 - WHISKER * (q3 - q1), q3 + WHISKER * (q3 - q1)
    v = F.col("v")
    # A whisker never ends inside the box.
    return [
        F.least(F.min(F.when(v >= low, v)), F.min(q1)).alias("whisker_low"),
        F.greatest(F.max(F.when(v <= high, v)), F.max(q3)).alias("whisker_high"),
        F.count_if((v < low) | (v > high)).alias("fliers"),
    ]


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, quartiles, whisker ends and the number of points beyond them."""
    values = _value(df, column)
    q = column_quantiles(values, ["v"], [0.25, 0.5, 0.75])["v"]
    q1, q2, q3 = (F.lit(x).cast("double") for x in q)
    return values.agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.min(q1).alias("q1"), F.min(q2).alias("median"),
        F.min(q3).alias("q3"), *_box(q1, q3))


def box_by_category(
    df: DataFrame, category: str, value: str, order_by: str | Sequence[str], *, limit: int | None = None
) -> DataFrame:
    """Box statistics of all categories, or of the ``limit`` seen first in key order."""
    values = _categories(df, category, value, order_by, limit)
    q = group_quantiles(values, ["category"], "v", [0.25, 0.5, 0.75])
    joined = join_lookup(values, q, ["category"])
    return joined.groupBy("category").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.min("q0").alias("q1"),
        F.min("q1").alias("median"), F.min("q2").alias("q3"), *_box(F.col("q0"), F.col("q2")))


def _xy(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(
        known(df, require_column(df, x)).cast("double").alias("x"),
        known(df, require_column(df, y)).cast("double").alias("y"),
    ).where("x is not null and y is not null")


def hexbin(df: DataFrame, x: str, y: str, *, grid: int = HEX_GRID) -> DataFrame:
    """(x, y, count) of the occupied hexagons of a grid ``grid`` cells wide.

    A point belongs to the nearer of two interleaved rectangular lattices' centres.
    """
    points = _xy(df, x, y)
    xlo, xhi, ylo, yhi = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if xlo is None:
        return df.sparkSession.createDataFrame([], "x double, y double, count bigint")
    tall = int(grid / 3 ** 0.5)
    xlo, xhi = (xlo - 0.1, xhi + 0.1) if xlo == xhi else (xlo, xhi)
    ylo, yhi = (ylo - 0.1, yhi + 0.1) if ylo == yhi else (ylo, yhi)
    pad = 1e-9 * (xhi - xlo)  # keeps the extreme points off the cell edges
    xlo, xhi = xlo - pad, xhi + pad
    sx, sy = (xhi - xlo) / grid, (yhi - ylo) / tall
    gx, gy = (F.col("x") - xlo) / sx, (F.col("y") - ylo) / sy
    near = F.struct(F.rint(gx).alias("i"), F.rint(gy).alias("j"))
    mid = F.struct((F.floor(gx) + 0.5).alias("i"), (F.floor(gy) + 0.5).alias("j"))
    off = lambda c: F.pow(gx - c["i"], F.lit(2)) + 3 * F.pow(gy - c["j"], F.lit(2))
    cell = F.when(off(near) < off(mid), near).otherwise(mid)
    counted = points.select(cell.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(
        (F.col("cell.i") * sx + xlo).alias("x"), (F.col("cell.j") * sy + ylo).alias("y"), "count")


def fitted_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line: slope, intercept, point count and the x range it is drawn over."""
    return _xy(df, x, y).agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max")).where("n >= 2")


def line_points(df: DataFrame, x: str, y: str, *, points: int = LINE_POINTS) -> DataFrame:
    line = fitted_line(df, x, y)
    step = (F.col("x_max") - F.col("x_min")) / F.lit(float(points - 1))
    at = line.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    at = at.withColumn("x", F.col("x_min") + F.col("point") * step)
    return at.select("point", "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("y"))


def scatter_points(
    df: DataFrame, x: str, y: str, order_by: str | Sequence[str], *, rows: int | None = None
) -> DataFrame:
    """All points, or those of a plot sample of ``rows``."""
    return _xy(_sampled(df, order_by, rows), x, y)


def pair_plot_histograms(
    df: DataFrame, columns: Sequence[str], order_by: str | Sequence[str], *, rows: int | None = None, most: int = 30
) -> DataFrame:
    """(column, bin, low, high, count): the diagonal of a pair plot; ``rows`` asks for one sample for all columns."""
    sample = _sampled(df, order_by, rows)
    names = [require_column(df, c) for c in columns]
    v = {c: known(sample, c).cast("double") for c in names}
    facts = sample.agg(*[F.struct(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
                         .alias(f"s{i}") for i, x in enumerate(v.values())]).first()
    cells, shape = [], []
    for (c, x), s in zip(v.items(), facts):
        if not s["n"]:
            continue
        low, high = (s["low"], s["high"]) if s["low"] != s["high"] else (s["low"] - 0.5, s["high"] + 0.5)
        bins = auto_bins(s["n"], most)
        width = (high - low) / bins
        shape += [(c, b, low + b * width, low + (b + 1) * width) for b in range(bins)]
        number = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("column"), number.alias("bin")))
    frame = df.sparkSession.createDataFrame(shape, "column string, bin int, low double, high double")
    counted = (
        sample.select(F.inline(F.array(*cells))).where("bin is not null")
        .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    )
    # Both sides hold at most ``most`` rows per column.
    return frame.join(F.broadcast(counted), ["column", "bin"], "left").na.fill(0, subset=["count"])
