"""Outlier tests: fixed bounds from one statistics pass, and an isolation forest."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import FOREST_LABEL, OUTLIER_SAMPLE_COLUMNS, OUTLIER_SAMPLE_ROWS, SEED
from ..functions.missing import data_type, is_number, known
from ..functions.naming import col, resolve_columns, temp_name
from ..session import ensure_checkpoint_dir
from .quantiles import column_quantiles

TREES = 100
TREE_ROWS = 256


def _numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in resolve_columns(df, columns) if is_number(data_type(df, c))]


def iqr_bounds(df: DataFrame, columns: Sequence[str], *, k: float = 1.5) -> dict[str, tuple[float, float]]:
    """Fences per column; columns with under four values or no spread have none."""
    names = _numeric(df, columns)
    counts = df.agg(F.lit(0), *[F.count(known(df, c)) for c in names]).first()[1:]
    out = {}
    for (name, (q1, q3)), n in zip(column_quantiles(df, names, [0.25, 0.75]).items(), counts):
        if n >= 4 and q3 != q1:
            reach = max(0.1, float(k)) * (q3 - q1)
            out[name] = (q1 - reach, q3 + reach)
    return out


def outlier_tests(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "iqr",
    *,
    iqr_k: float = 1.5,
    z_threshold: float = 3.0,
) -> dict[str, Column]:
    """A never-NULL test per numeric column. The bounds are constants, so a filter can reach the scan."""
    names = _numeric(df, columns)
    never = F.lit(False)
    if method == "iqr":
        bounds = iqr_bounds(df, names, k=iqr_k)
        tests = {}
        for c in names:
            v = known(df, c).cast("double")
            tests[c] = F.coalesce((v < bounds[c][0]) | (v > bounds[c][1]), never) if c in bounds else never
        return tests
    if method == "zscore":
        if not names:
            return {}
        parts = [x for c in names for x in (F.avg(known(df, c).cast("double")), F.stddev_samp(known(df, c).cast("double")))]
        stats = df.agg(*parts).first()
        tests = {}
        for i, c in enumerate(names):
            mean, std = stats[2 * i], stats[2 * i + 1]
            far = F.abs(known(df, c).cast("double") - F.lit(mean)) / F.lit(std) > z_threshold if std else never
            tests[c] = F.coalesce(far, never)
        return tests
    raise ValueError(f"unsupported outlier method: {method}")


def with_outlier_flag(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "iqr",
    *,
    iqr_k: float = 1.5,
    z_threshold: float = 3.0,
    contamination: float = 0.05,
    order_by: str | Sequence[str] | None = None,
    name: str = "is_outlier",
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """Flag rows that are outliers in at least one numeric column, or for the forest as a whole."""
    if method == "isolation_forest":
        return forest_flag(df, columns, contamination=contamination, order_by=order_by, name=name,
                           trees=trees, tree_rows=tree_rows)
    tests = list(outlier_tests(df, columns, method, iqr_k=iqr_k, z_threshold=z_threshold).values())
    return df.withColumn(name, reduce(lambda a, b: a | b, tests, F.lit(False)))


def drop_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr", **options) -> DataFrame:
    flag = temp_name(df, "outlier")
    return with_outlier_flag(df, columns, method, name=flag, **options).where(~col(flag)).drop(flag)


def split_outliers(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", **options
) -> tuple[DataFrame, int, DataFrame]:
    """(kept rows, number removed, all rows with the flag)."""
    flagged = with_outlier_flag(df, columns, method, **options)
    name = flagged.columns[-1]
    removed = flagged.where(col(name)).count()
    return flagged.where(~col(name)).drop(name), removed, flagged


def outlier_summary(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", *, contamination: float = 0.05,
    order_by: str | Sequence[str] | None = None, iqr_k: float = 1.5, z_threshold: float = 3.0,
    trees: int = TREES, tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """(column, count, pct) per numeric column from one scan; the forest gives one row for all."""
    if method == "isolation_forest":
        flagged = forest_flag(df, columns, contamination=contamination, order_by=order_by, name="__flag",
                              trees=trees, tree_rows=tree_rows)
        tests = {FOREST_LABEL: F.col("__flag")}
    else:
        flagged = df
        tests = outlier_tests(df, columns, method, iqr_k=iqr_k, z_threshold=z_threshold)
    if not tests:
        return df.sparkSession.createDataFrame([], "column string, count bigint, pct double")
    wide = flagged.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(t).alias(f"o{i}") for i, t in enumerate(tests.values())])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("count"),
                 F.coalesce(F.try_divide(F.col(f"o{i}") * 100.0, "n"), F.lit(0.0)).alias("pct"))
        for i, c in enumerate(tests)])))


def count_outlier_rows(df: DataFrame, columns: Sequence[str], method: str = "iqr", **options) -> DataFrame:
    flagged = with_outlier_flag(df, columns, method, **options)
    return flagged.agg(F.count_if(col(flagged.columns[-1])).alias("outlier_rows"),
                       F.count(F.lit(1)).alias("row_count"))


def outlier_sample(
    df: DataFrame, columns: Sequence[str], order_by: str | Sequence[str], method: str = "iqr", **options
) -> DataFrame:
    """The first flagged rows in key order, showing the first few checked columns."""
    flag = temp_name(df, "outlier")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    flagged = with_outlier_flag(df, columns, method, name=flag, **options).where(col(flag))
    shown = resolve_columns(df, columns)[:OUTLIER_SAMPLE_COLUMNS]
    return flagged.orderBy(*[col(k) for k in keys]).limit(OUTLIER_SAMPLE_ROWS).select(*[col(c) for c in shown])


# ---------------------------------------------------------------- isolation forest

def _path_credit(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows (the c(n) of the isolation-forest paper)."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(rows: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, float]]:
    """One tree as a list of (feature, cut, left child, depth credit); the right child follows the left."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list = [None]
    stack = [(0, rows, 0)]
    while stack:
        at, part, depth = stack.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(usable):
            nodes[at] = (-1, 0.0, -1, depth + float(_path_credit(len(part))))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        left = part[:, f] <= cut
        child = len(nodes)
        nodes += [None, None]
        nodes[at] = (f, cut, child, 0.0)
        stack += [(child, part[left], depth + 1), (child + 1, part[~left], depth + 1)]
    return nodes


def fit_forest(
    df: DataFrame, columns: Sequence[str], order_by: str | Sequence[str], *, trees: int = TREES, tree_rows: int = TREE_ROWS
) -> tuple[list[np.ndarray], int]:
    """Trees grown as Spark tasks, each on the ``tree_rows`` rows of the whole table that its own hash of the row key puts first.

    Rows that some tree can want are told by their hashes alone, about twice ``trees`` x ``tree_rows`` of them; each goes to
    the trees that drew it, and only nodes come to the driver.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    names = [f"x{i}" for i in range(len(columns))]
    complete = df.select(*[known(df, c).cast("double").alias(x) for c, x in zip(columns, names)],
                         F.xxhash64(F.lit(SEED), *[col(k) for k in keys]).alias("key")).na.drop(subset=names)
    total = complete.count()
    share = min(1.0, 2.0 * max(tree_rows, 64) / max(total, 1))
    ticket = lambda t: F.xxhash64("key", t)
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: ticket(t) <= F.lit(int((share - 0.5) * 2.0 ** 64)) if share < 1.0 else F.lit(True))
    rows = complete.select(*names, "key", F.explode(drawn).alias("tree")).withColumn("ticket", ticket(F.col("tree")))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        picked = part.sort_values(["ticket", *names]).head(tree_rows)[names].to_numpy()
        nodes = _grow(picked, np.random.default_rng([SEED, tree]))
        return pd.DataFrame(nodes, columns=["feature", "cut", "child", "credit"]).assign(tree=tree, node=range(len(nodes)))

    grown = rows.groupBy("tree").applyInPandas(grow, "feature int, cut double, child int, credit double, tree long, node int").toPandas()
    made = [t.sort_values("node")[["feature", "cut", "child", "credit"]].to_numpy() for _, t in grown.groupby("tree")]
    return made, min(tree_rows, total)


class _Walk:
    """All trees in one table of nodes, walked down together; a leaf leads to itself."""

    def __init__(self, forest: Sequence[np.ndarray], tree_rows: int):
        self.roots = np.cumsum([0, *map(len, forest)])[:-1]
        nodes = np.concatenate([*forest, np.empty((0, 4))])
        place = np.repeat(self.roots, [len(t) for t in forest])
        leaf = nodes[:, 0] < 0
        self.feature = np.where(leaf, 0, nodes[:, 0]).astype(np.int64)
        self.cut = np.where(leaf, np.inf, nodes[:, 1])
        self.child = np.where(leaf, np.arange(len(nodes)), nodes[:, 2] + place).astype(np.int64)
        self.credit = nodes[:, 3]
        self.levels = int(np.ceil(np.log2(max(tree_rows, 2))))

    def mean_depth(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for i in range(0, len(rows), 1024):
            part = rows[i:i + 1024]
            at = np.repeat(self.roots[:, None], len(part), axis=1)
            lines = np.arange(len(part))[None, :]
            for _ in range(self.levels):
                at = self.child[at] + (part[lines, self.feature[at]] > self.cut[at])
            out[i:i + 1024] = self.credit[at].mean(axis=0)
        return out


def forest_scores(
    df: DataFrame, columns: Sequence[str], order_by: str | Sequence[str], name: str = "anomaly_score",
    *, trees: int = TREES, tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """Anomaly score in (0, 1], higher is more isolated; NULL for rows that lack a value."""
    names = _numeric(df, columns)
    forest, size = fit_forest(df, names, order_by, trees=trees, tree_rows=tree_rows)
    if not forest:
        return df.withColumn(name, F.lit(None).cast("double"))
    shared = df.sparkSession.sparkContext.broadcast(_Walk(forest, tree_rows))  # trees x 2 * tree_rows nodes at most
    scale = float(_path_credit(size)) or 1.0

    @F.pandas_udf("double")
    def score(rows: pd.DataFrame) -> pd.Series:
        x = rows.to_numpy(dtype=float)
        whole = ~np.isnan(x).any(axis=1)
        out = np.full(len(x), np.nan)
        if whole.any():
            out[whole] = np.power(2.0, -shared.value.mean_depth(x[whole]) / scale)
        return pd.Series(out)

    packed = F.struct(*[known(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    scored = df.withColumn(name, score(packed))
    return scored.withColumn(name, F.when(~F.isnan(name), col(name)))


def forest_flag(
    df: DataFrame,
    columns: Sequence[str],
    *,
    contamination: float = 0.05,
    order_by: str | Sequence[str] | None = None,
    name: str = "is_outlier",
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """Flag the ``contamination`` share of complete rows that an isolation forest isolates first."""
    names = _numeric(df, columns)
    share = max(0.01, min(contamination, 0.5))
    if not names or df.select(*[known(df, c).alias(c) for c in names]).na.drop().limit(10).count() < 10:
        return df.withColumn(name, F.lit(False))
    score = temp_name(df, "score")
    scored = forest_scores(df, names, order_by if order_by is not None else df.columns, score,
                           trees=trees, tree_rows=tree_rows)
    # Rows are scored once and stored: the search for the cut reads the scores several times, the result once more.
    ensure_checkpoint_dir(df.sparkSession)
    scored = scored.checkpoint()
    cut = column_quantiles(scored.select(score), [score], [1 - share])[score][0]
    return scored.withColumn(name, F.coalesce(col(score) > F.lit(cut), F.lit(False))).drop(score)
