"""Model-based filling of numeric columns: exact nearest neighbours, and chained regressions."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.missing import data_type, is_number, known
from ..functions.naming import col, resolve_columns, temp_name
from ..session import ensure_checkpoint_dir
from .ordering import range_cuts, range_of
from .skew import join_lookup

BLOCK_POINTS = 2_000
MAX_BLOCKS = 4_096
QUERY_CHUNK = 4_000
_GRID_BITS = 10
_CELLS = 4_000_000  # numbers held at once when a task compares points


def _numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    names = [c for c in resolve_columns(df, columns) if is_number(data_type(df, c))]
    if not names:
        raise ValueError("no numeric column to impute")
    return names


def _as_double(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[
        known(df, c).cast("double").alias(c) if c in names else col(c) for c in df.columns])


# ---------------------------------------------------------------- nearest neighbours
#
# A block join: the distinct points are cut into blocks of near points (Z-order), each with a bounding
# box. A point with gaps needs only the blocks whose box can hold one of its k nearest points; box
# distances are exact bounds, so nothing is missed. Blocks and box table are bounded in size, and the
# work of a block is split into chunks of its visitors.

def _z_order(coords: list[Column], low: list[float], high: list[float]) -> Column:
    """Interleaved bits of the scaled coordinates: near points get near numbers. Gaps count as 0."""
    code = F.lit(0).cast("bigint")
    bits = max(1, min(_GRID_BITS, 60 // max(len(coords), 1)))
    for d, (c, lo, hi) in enumerate(zip(coords, low, high)):
        if not hi > lo:
            continue
        cell = F.floor((c - lo) / (hi - lo) * ((1 << bits) - 1)).cast("bigint")
        cell = F.coalesce(cell, F.lit(0))
        for b in range(bits):
            bit = F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("bigint"))
            code = code + F.shiftleft(bit, b * len(coords) + d)
    return code


def _box_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scaled squared distance of each query to each box (inf: nothing to compare).

    The scale is all coordinates over shared coordinates, as in the NaN-aware distance.
    """
    shared = ~np.isnan(q)[:, None, :] & ~np.isnan(lo)[None, :, :]
    x, a, b = q[:, None, :], lo[None], hi[None]
    near = np.where(shared, np.maximum(np.maximum(a - x, x - b), 0.0), 0.0)
    far = np.where(shared, np.maximum(np.abs(x - a), np.abs(x - b)), 0.0)
    count = shared.sum(axis=2)
    scale = np.where(count > 0, q.shape[1] / np.maximum(count, 1), np.inf)
    with np.errstate(invalid="ignore"):
        least, most = scale * (near ** 2).sum(axis=2), scale * (far ** 2).sum(axis=2)
    return np.where(count > 0, least, np.inf), np.where(count > 0, most, np.inf)


def _distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    shared = ~np.isnan(q)[:, None, :] & ~np.isnan(p)[None, :, :]
    diff = np.where(shared, q[:, None, :] - p[None, :, :], 0.0)
    count = shared.sum(axis=2)
    total = (diff ** 2).sum(axis=2)
    return np.where(count > 0, total * q.shape[1] / np.maximum(count, 1), np.inf)


def fill_knn(df: DataFrame, columns: Sequence[str], *, neighbours: int = 5) -> DataFrame:
    """Fill gaps with the mean of the nearest rows that have the value (NaN-aware Euclidean distance).

    Rows at the distance of the last neighbour share the places left in equal parts. Where no row can be
    compared the column mean is used. Filled columns become double; present values stay.
    """
    names = _numeric(df, columns)
    values = [known(df, c).cast("double") for c in names]
    facts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"))
          .alias(f"s{i}") for i, v in enumerate(values)]).first()
    total, stats = facts[0], facts[1:]
    if all(s["n"] == total for s in stats):
        return df
    if total < 2:
        raise ValueError("nearest-neighbour filling needs at least two rows")
    k = max(1, min(neighbours, total - 1))
    dims = [f"x{i}" for i in range(len(names))]
    # Equal points are one point with a weight, so copies cost nothing, and gaps are filled once per point.
    points = df.select(*[v.alias(d) for v, d in zip(values, dims)]).groupBy(*dims).agg(F.count(F.lit(1)).alias("w"))
    filled = _fill_points(points, dims, stats, k)

    doubled = _as_double(df, names)
    keyed = [temp_name(df, d) for d in dims]
    for c, key in zip(names, keyed):
        doubled = doubled.withColumn(key, col(c))
    lookup = filled.select(*[col(d).alias(key) for d, key in zip(dims, keyed)],
                           *[F.col(f"f{i}").alias(f"__f{i}") for i in range(len(names))])
    joined = join_lookup(doubled, lookup, keyed, null_safe=True)
    out = []
    for f in df.schema:
        i = names.index(f.name) if f.name in names else -1
        if i < 0 or stats[i]["n"] == total:
            out.append(col(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(F.coalesce(col(f.name), F.col(f"__f{i}"), F.lit(stats[i]["mean"])).alias(f.name))
    return joined.select(*out)


def _fill_points(points: DataFrame, dims: list[str], stats: list, k: int) -> DataFrame:
    """(dims…, f0, f1, …) for every distinct point with a gap."""
    d = len(dims)
    low = [s["low"] if s["low"] is not None else 0.0 for s in stats]
    high = [s["high"] if s["high"] is not None else 0.0 for s in stats]
    pattern = F.concat(*[F.when(col(x).isNull(), "0").otherwise("1") for x in dims])
    placed = points.select("*", pattern.alias("pattern"), _z_order([col(x) for x in dims], low, high).alias("z"))
    # Cut points, boxes, queries and donors all read the distinct points, so they are stored once.
    ensure_checkpoint_dir(points.sparkSession)
    placed = placed.checkpoint()
    count = placed.count()
    per_block = max(BLOCK_POINTS, -(-count // MAX_BLOCKS))
    order = ["pattern", "z", *dims]
    cuts = range_cuts(placed, order, per_block)
    # Every (pattern, range) pair is a block: all its points have the same coordinates present.
    blocked = placed.withColumn("part", range_of(placed, order, cuts)).withColumn(
        "block", F.concat_ws(":", "pattern", "part"))
    boxes = blocked.groupBy("block", "pattern").agg(
        F.count(F.lit(1)).alias("points"), F.sum("w").alias("rows"),
        *[F.min(x).alias(f"l{i}") for i, x in enumerate(dims)], *[F.max(x).alias(f"h{i}") for i, x in enumerate(dims)])
    table = boxes.orderBy("block").toPandas()  # one row per block: at most cuts + patterns
    shared = {
        "block": table["block"].to_numpy(),
        "rows": table["rows"].to_numpy(dtype=float),
        "lo": table[[f"l{i}" for i in range(d)]].to_numpy(dtype=float),
        "hi": table[[f"h{i}" for i in range(d)]].to_numpy(dtype=float),
        "has": np.array([[ch == "1" for ch in p] for p in table["pattern"]]),
    }
    boxes_b = points.sparkSession.sparkContext.broadcast(shared)

    queries = placed.where(col("pattern").contains("0")).select(*dims)

    def visits(batches):
        s = boxes_b.value
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start:start + 256]
                q = part[dims].to_numpy(dtype=float)
                least, most = _box_bounds(q, s["lo"], s["hi"])
                for j in range(d):
                    rows = np.flatnonzero(np.isnan(q[:, j]))
                    give = np.flatnonzero(s["has"][:, j])
                    if not len(rows) or not len(give):
                        continue
                    ub, lb = most[np.ix_(rows, give)], least[np.ix_(rows, give)]
                    order_ = np.argsort(ub, axis=1)
                    reach = np.cumsum(s["rows"][give][order_], axis=1) >= k
                    first = np.where(reach.any(axis=1), reach.argmax(axis=1), len(give) - 1)
                    limit = np.take_along_axis(ub, order_, 1)[np.arange(len(rows)), first]
                    r, b = np.nonzero((lb <= limit[:, None]) & np.isfinite(lb))
                    yield part.iloc[rows[r]][dims].assign(feature=j, block=s["block"][give[b]])

    schema = ", ".join([*(f"{x} double" for x in dims), "feature int", "block string"])
    pairs = queries.mapInPandas(visits, schema).checkpoint()  # read twice: to count and to send
    # A much visited block is given to several tasks, each with a chunk of the visitors.
    chunk = F.pmod(F.xxhash64("feature", *dims), F.col("chunks")).cast("int")
    load = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("chunks"))
    spread = pairs.join(F.broadcast(load), "block").withColumn("chunk", chunk)  # one row per block
    donors = blocked.select("block", "w", *[col(x).alias(f"p{i}") for i, x in enumerate(dims)])
    donors = donors.join(F.broadcast(load), "block").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        p = right[[f"p{i}" for i in range(d)]].to_numpy(dtype=float)
        w = right["w"].to_numpy(dtype=float)
        for j, group in left.groupby("feature"):
            has = ~np.isnan(p[:, j])
            give, weight = p[has], w[has]
            step = max(1, _CELLS // max(1, len(give) * d))
            for start in range(0, len(group), step):
                part = group.iloc[start:start + step]
                dist = _distances(part[dims].to_numpy(dtype=float), give)
                order_ = np.argsort(dist, axis=1, kind="stable")
                upto = np.cumsum(weight[order_], axis=1)
                sorted_ = np.take_along_axis(dist, order_, 1)
                # The k nearest rows of this block and everything as near as the last of them.
                at = np.minimum((upto < k).sum(axis=1), dist.shape[1] - 1)
                edge = sorted_[np.arange(len(part)), at]
                r, c = np.nonzero((dist <= edge[:, None]) & np.isfinite(dist))
                if len(r):
                    out.append(part.iloc[r][dims].assign(
                        feature=j, dist=dist[r, c], v=give[c, j] * weight[c], w=weight[c]))
        columns = [*dims, "feature", "dist", "v", "w"]
        if not out:
            return pd.DataFrame(columns=columns)
        found = pd.concat(out)
        return found.groupby([*dims, "feature", "dist"], dropna=False, as_index=False).agg({"v": "sum", "w": "sum"})[columns]

    found = spread.drop("chunks").groupBy("block", "chunk").cogroup(donors.groupBy("block", "chunk")).applyInPandas(
        nearest, ", ".join([*(f"{x} double" for x in dims), "feature int", "dist double", "v double", "w double"]))
    clean = [F.when(~F.isnan(x), col(x)).alias(x) for x in dims]
    found = found.select(*clean, "feature", "dist", "v", "w")
    # At most k distances per block remain for a query, so the ranking below is short.
    rings = found.groupBy(*dims, "feature", "dist").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    before = Window.partitionBy(*dims, "feature").orderBy("dist").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.greatest(F.least(col("w"), k - F.coalesce(F.sum("w").over(before), F.lit(0.0))), F.lit(0.0))
    part = rings.withColumn("t", taken).where("t > 0")
    means = part.groupBy(*dims, "feature").agg((F.sum(col("v") / col("w") * col("t")) / F.sum("t")).alias("f"))
    return means.groupBy(*dims).agg(*[
        F.max(F.when(col("feature") == i, col("f"))).alias(f"f{i}") for i in range(d)])


# ---------------------------------------------------------------- chained regressions
#
# A row's gaps are filled by linear functions of its other cells, so the cross products of all rows with the same gaps are
# all that a regression needs, and filling a column maps them as it maps the rows. One scan gives the cross products of
# every pattern of gaps; the rounds then run on these matrices, and each row is filled once, by the map of its pattern.

MAX_PATTERNS = 4_096


def _coefficients(gram: np.ndarray, target: int, shrinkage: str) -> np.ndarray:
    """Weights of (1, columns…) that predict a column, from cross products of the rows that have it; its own weight is 0.

    ``gram`` belongs to (1, columns…). Least squares, of least norm where columns repeat each other, or ridge regression
    whose strength and noise have the greatest evidence.
    """
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    i = target - 1
    others = np.array([j for j in range(len(mean)) if j != i])
    size = np.sqrt(np.maximum(np.diag(cov)[others], 0.0))
    usable = size > 1e-9 * np.maximum(np.abs(mean[others]), 1e-300)
    others, size = others[usable], size[usable]
    weights = np.zeros(len(gram))
    if len(others):
        xx, xy = cov[np.ix_(others, others)], cov[others, i]
        if shrinkage == "evidence":
            w = _evidence(xx * n, xy * n, cov[i, i] * n, n)
        else:
            w = np.linalg.lstsq(xx / np.outer(size, size), xy / size, rcond=1e-10)[0] / size
        weights[others + 1] = w
    weights[0] = mean[i] - weights[1:] @ mean
    return weights


def _evidence(xx: np.ndarray, xy: np.ndarray, yy: float, n: float) -> np.ndarray:
    """Ridge weights where the precisions of noise and weights maximise the evidence, found in turns."""
    values, vectors = np.linalg.eigh(xx)
    values, along = np.maximum(values, 0.0), vectors.T @ xy
    noise, prior, w = n / max(yy, 1e-300), 1.0, None
    tiny = 1e-6  # of the flat prior of either precision
    for _ in range(300):
        before, w = w, vectors @ (along / (values + prior / noise))
        left = max(yy - 2 * w @ xy + w @ xx @ w, 0.0)
        used = float((noise * values / (prior + noise * values)).sum())
        prior = (used + 2 * tiny) / (float(w @ w) + 2 * tiny)
        noise = (n - used + 2 * tiny) / (left + 2 * tiny)
        if before is not None and np.abs(before - w).sum() < 1e-3:
            break
    return vectors @ (along / (values + prior / noise))


def _state(names: Sequence[str], df: DataFrame, means: Sequence[float]) -> tuple[list[Column], Column]:
    """The columns of a row less their means, 0 in the gaps, and its pattern of gaps as text."""
    values = [known(df, c).cast("double") for c in names]
    pattern = F.concat(*[F.when(v.isNull(), "0").otherwise("1") for v in values])
    return [F.coalesce(v - F.lit(m), F.lit(0.0)) for v, m in zip(values, means)], pattern


def _gram_sums(z: Sequence[Column]) -> list[Column]:
    ones = [F.lit(1.0), *z]
    return [F.sum(ones[a] * ones[b]) for a in range(len(ones)) for b in range(a, len(ones))]


def _gram(sums: Sequence[float], m: int) -> np.ndarray:
    out = np.zeros((m + 1, m + 1))
    out[np.triu_indices(m + 1)] = sums
    return out + np.triu(out, 1).T


def _filled(z: Column, steps: Column) -> Column:
    """A row's state after steps (column, its weights on (1, columns…)) where the column is a gap of the row."""
    def apply(state: Column, step: Column) -> Column:
        value = F.get(step["w"], F.lit(0)) + F.aggregate(
            F.zip_with(F.slice(step["w"], 2, F.size(state)), state, lambda w, x: w * x), F.lit(0.0), lambda t, x: t + x)
        return F.transform(state, lambda x, j: F.when(j == step["i"], value).otherwise(x))
    return F.aggregate(steps, z, apply)


def _steps(models: Sequence[tuple[int, np.ndarray]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(float(x)) for x in w]).alias("w")) for i, w in models])


class _Patterns:
    """Cross products of the rows of each pattern, and the map from a row's first state to its present one."""

    def __init__(self, patterns: Sequence[str], grams: Sequence[np.ndarray]):
        self.gaps = np.array([[c == "0" for c in p] for p in patterns])
        self.grams = np.array(grams)
        self.maps = np.tile(np.eye(self.grams.shape[1]), (len(self.gaps), 1, 1))

    def fill(self, column: int, shrinkage: str) -> None:
        gaps = self.gaps[:, column]
        if gaps.all() or not gaps.any():
            return
        step = np.eye(self.grams.shape[1])
        step[column + 1] = _coefficients(self.grams[~gaps].sum(axis=0), column + 1, shrinkage)
        self.grams[gaps] = step @ self.grams[gaps] @ step.T
        self.maps[gaps] = step @ self.maps[gaps]


def fill_mice(
    df: DataFrame, columns: Sequence[str], *, max_iter: int = 10, tolerance: float = 1e-3, shrinkage: str = "none"
) -> DataFrame:
    """Fill gaps by regressing each column on the others, round after round.

    Starts from the column means, goes through the columns with fewest gaps first, and stops early when no filled value
    moves by more than ``tolerance`` times the largest present value. ``shrinkage`` is "none" for least squares or
    "evidence" for ridge regression of the strength that the data make most likely.
    """
    if shrinkage not in ("none", "evidence"):
        raise ValueError("shrinkage is 'none' or 'evidence'")
    asked = _numeric(df, columns)
    values = [known(df, c).cast("double") for c in asked]
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(F.count_if(v.isNull()).alias("gaps"), F.avg(v).alias("mean"), F.max(F.abs(v)).alias("peak"))
        .alias(f"s{i}") for i, v in enumerate(values)]).first()
    total, stats = stats[0], dict(zip(asked, stats[1:]))
    if not any(s["gaps"] for s in stats.values()):
        return df
    if total < 2:
        raise ValueError("regression filling needs at least two rows")
    names = [c for c in asked if stats[c]["mean"] is not None]  # a column without any value stays empty
    means = [float(stats[c]["mean"]) for c in names]
    m = len(names)
    todo = sorted((i for i in range(m) if stats[names[i]]["gaps"]), key=lambda i: stats[names[i]]["gaps"])
    if not todo:
        return df
    limit = tolerance * max(float(stats[c]["peak"]) for c in names)
    rounds = max(1, min(max_iter, 50)) if m > 1 else 0
    z, pattern = _state(names, df, means)
    by_pattern = df.groupBy(pattern.alias("pattern")).agg(*[s.alias(f"g{i}") for i, s in enumerate(_gram_sums(z))])
    found = by_pattern.limit(MAX_PATTERNS + 1).collect()
    if len(found) <= MAX_PATTERNS:
        maps = _rounds(df, z, pattern, [(r["pattern"], _gram(r[1:], m)) for r in found], todo, rounds, limit, shrinkage)
        steps = df.sparkSession.createDataFrame(maps, "pattern string, steps array<struct<i: int, w: array<double>>>")
        pattern_, state = temp_name(df, "pattern"), temp_name(df, "state")
        # One row a pattern, so its size has a bound; rows without gaps need none.
        joined = df.withColumn(pattern_, pattern).withColumn(state, F.array(*z)).join(
            F.broadcast(steps.withColumnRenamed("pattern", pattern_)), pattern_, "left")
        done = joined.withColumn(state, _linear(F.col(f"`{state}`"), F.col("steps")))
    else:
        steps, state = _scanned_rounds(df, names, z, todo, rounds, limit, shrinkage), temp_name(df, "state")
        own = _own_steps(steps, names, df)
        done = df.withColumn(state, _filled(F.array(*z), own) if steps else F.array(*z))
    gapped = {names[i]: i for i in todo}
    return done.select(*[
        F.coalesce(known(df, c).cast("double"), F.get(col(state), F.lit(gapped[c])) + F.lit(means[gapped[c]])).alias(c)
        if c in gapped else col(c) for c in df.columns])


def _linear(state: Column, rows: Column) -> Column:
    """A row's state with the places in ``rows`` (i, weights on (1, first state…)) computed, all from the first state."""
    def value(r: Column) -> Column:
        products = F.zip_with(F.slice(r["w"], 2, F.size(state)), state, lambda w, x: w * x)
        return F.get(r["w"], F.lit(0)) + F.aggregate(products, F.lit(0.0), lambda t, x: t + x)
    made = F.coalesce(F.map_from_entries(F.transform(rows, lambda r: F.struct(r["i"], value(r)))), F.create_map().cast("map<int,double>"))
    return F.transform(state, lambda x, j: F.coalesce(F.element_at(made, j), x))


def _map_rows(patterns: Sequence[str], maps: np.ndarray) -> list[tuple]:
    return [(p, [(i, list(map(float, maps[k][i + 1]))) for i, c in enumerate(p) if c == "0"])
            for k, p in enumerate(patterns) if "0" in p]


def _rounds(df: DataFrame, z, pattern, grams, todo, rounds: int, limit: float, shrinkage: str) -> list[tuple]:
    """The maps of all patterns after the rounds; a scan for each round tells how far the values moved."""
    patterns = [p for p, _ in grams]
    held = _Patterns(patterns, [g for _, g in grams])
    for r in range(rounds):
        before = held.maps.copy()
        for i in todo:
            held.fill(i, shrinkage)
        if r == rounds - 1 or not np.isfinite(held.maps).all():
            break
        moved = df.sparkSession.createDataFrame(_map_rows(patterns, held.maps - before), "__p string, steps array<struct<i: int, w: array<double>>>")
        zero = df.select(pattern.alias("__p"), F.array(*z).alias("__z")).join(F.broadcast(moved), "__p")
        change = F.array_max(F.transform("steps", lambda s: F.abs(F.get(s["w"], F.lit(0)) + F.aggregate(
            F.zip_with(F.slice(s["w"], 2, F.size("__z")), F.col("__z"), lambda w, x: w * x), F.lit(0.0), lambda t, x: t + x))))
        if (zero.agg(F.max(change)).first()[0] or 0.0) <= limit:
            break
    return _map_rows(patterns, held.maps)


def _own_steps(models, names: Sequence[str], df: DataFrame) -> Column:
    """The steps of the columns that are gaps of the row."""
    gaps = F.array(*[known(df, c).isNull() for c in names])
    return F.filter(_steps(models), lambda s: F.get(gaps, s["i"]))


def _scanned_rounds(df: DataFrame, names, z, todo, rounds: int, limit: float, shrinkage: str) -> list[tuple[int, np.ndarray]]:
    """The same rounds where the patterns are too many to hold: a scan of the rows for every column."""
    models: list[tuple[int, np.ndarray]] = []
    state = lambda steps: _filled(F.array(*z), _own_steps(steps, names, df)) if steps else F.array(*z)
    m = len(names)
    for _ in range(rounds):
        before = list(models)
        for i in todo:
            rows = df.where(known(df, names[i]).isNotNull()).select(state(models).alias("x"))
            sums = rows.agg(*_gram_sums([F.get("x", F.lit(j)) for j in range(m)])).first()
            if sums[0]:
                models.append((i, _coefficients(_gram(sums, m), i + 1, shrinkage)))
        change = F.array_max(F.zip_with(state(before), state(models), lambda a, b: F.abs(a - b)))
        if (df.agg(F.max(change)).first()[0] or 0.0) <= limit:
            break
    return models
