"""Embedding whitening: each distinct vector once, weighted sums and a weighted centred product, components, join back.

1. Vectors become whole numbers x; equal ones are one row of the fit list with their number of copies. A vector's weight in
   the fit is 1 or that number.
2. One pass gives the exact weighted sums, a second one the products of the centred vectors: each task multiplies its
   centred block with its weighted self, and the partial products are added row by row of the matrix.
3. The eigenvectors of the covariance, one matrix of the vectors' dimension, are found once and sent to the tasks, which
   whiten every distinct vector. The covariance of what they give is measured the same way.
4. Rows take the result of their vector by a join on 128 bits of its hash, in which hot vectors are salted.

Vectors of another length are a list of their own, with their own components.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import join_lookup
from . import shared

SCALE, SHIFT = 64, 1_000_000
# Values from here on have no exact place among long numbers; vectors that hold one are left out.
_LARGEST = float(1 << 53)
# Eigenvalues below this share of the greatest are rounding errors of none at all.
_NO_VARIANCE = 1e-13
_ROWS = 4096


def quantised(vector: Column) -> Column:
    """``floor(64 c) + 1000000`` of every entry; NULL for a vector that is NULL or empty or holds an entry that is NULL, not
    finite, or beyond 2**53 when scaled."""
    usable = (F.size(vector) > 0) & F.forall(
        vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double") * SCALE) < _LARGEST), F.lit(False)))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))


def _blocks(batch: pa.RecordBatch, vectors: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their vectors as a matrix), one block for each length and some thousand rows."""
    column = batch.column(vectors)
    lengths = np.asarray(column.value_lengths())
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        for i in range(0, len(at), _ROWS):
            rows = at[i:i + _ROWS]
            yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)


@dataclass
class Components:
    """What the vectors of one length are whitened by."""
    n: int  # the total weight
    sums: list[int]
    values: np.ndarray  # eigenvalues from the greatest down, none below 0
    vectors: np.ndarray  # unit eigenvectors, one a column
    trace: float

    @classmethod
    def of(cls, n: int, sums: list[int], covariance: np.ndarray) -> Components:
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        none = values <= _NO_VARIANCE * max(values[0], 0.0)
        return cls(n, sums, np.where(none, 0.0, values), vectors, float(np.trace(covariance)))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, the whole part of the mean taken off before the division's rounding."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        return (x - np.array(whole, np.int64)) - rest

    def whitened(self, x: np.ndarray, most: int | None) -> np.ndarray:
        """NaN stands for components without variance."""
        scale = np.where(self.values > 0, self.values, np.nan)[:most]
        return self.centred(x) @ self.vectors[:, :most] / np.sqrt(scale)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)^2, None where it is no long number."""
        far = max(int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums)), 1)
        kind = np.int64 if far * far * x.shape[1] < 1 << 63 else object
        if kind is np.int64 or not x.size:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        away = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (away ** 2).sum(axis=1).tolist()]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weight and the exact weighted sums of a task's vectors of each length."""
    total: dict[int, list] = {}
    for batch in batches:
        weight = batch.column("weight").to_numpy()
        for rows, x in _blocks(batch, "x"):
            w = weight[rows]
            n = int(w.sum())
            exact = int(np.abs(x).max()) * n < 1 << 62
            part = w @ x if exact else w.astype(object) @ x.astype(object)
            held = total.setdefault(x.shape[1], [0, [0] * x.shape[1]])
            held[0], held[1] = held[0] + n, [a + b for a, b in zip(held[1], part.tolist())]
    for d, (n, sums) in total.items():
        yield pa.RecordBatch.from_pydict({
            "d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()),
            "total": pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))})


def _products(vectors: str, centred: dict):
    """The weighted product of a task's centred vectors of each length with themselves, a row of the matrix each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy().astype(float)
            for rows, x in _blocks(batch, vectors):
                d = x.shape[1]
                y = centred[d](x)
                total[d] = total.get(d, 0.0) + (y * weight[rows, None]).T @ y
        for d, m in total.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()),
                                              "row": pa.array(list(m), pa.list_(pa.float64()))})
    return run


def _added(rows: pa.Table) -> pa.Table:
    """One row of a matrix from those of all tasks."""
    total = np.stack([np.array(r) for r in rows.column("row").to_pylist()]).sum(axis=0)
    return pa.table({"d": rows.column("d")[:1], "i": rows.column("i")[:1], "row": pa.array([total], pa.list_(pa.float64()))})


def _matrices(df: DataFrame, vectors: str, centred: dict) -> dict[int, np.ndarray]:
    """Length -> summed products; as many matrices as there are lengths, each of that many rows."""
    sql = "d int, i int, row array<double>"
    parts = df.select(vectors, "weight").mapInArrow(_products(vectors, centred), sql)
    rows = parts.groupBy("d", "i").applyInArrow(_added, sql).orderBy("d", "i").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["d"], []).append(r["row"])
    return {d: np.array(m) for d, m in out.items()}


def _answers(model: dict[int, Components], most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _blocks(batch, "x"):
                part, found = batch.take(pa.array(rows)), model[x.shape[1]]
                z = found.whitened(x, most)
                flat = pa.array(z.ravel(), pa.float64(), from_pandas=True)  # NaN becomes NULL
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * z.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("x_hash"), part.column("x_hash_2"), part.column("weight"),
                     pa.array([x.shape[1]] * len(rows), pa.int32()), pa.array(found.deviation(x), pa.int64()),
                     pa.ListArray.from_arrays(offsets, flat)],
                    names=["x_hash", "x_hash_2", "weight", "x_size", "deviation", "whitened"])
    return run


_RESULT = ["n", "deviation", "whitened", "explained", "identity_error"]


def _hashes(x: Column) -> list[Column]:
    return [F.xxhash64(x).alias("x_hash"), F.xxhash64(F.lit("again"), x).alias("x_hash_2")]


def whiten(df: DataFrame, vector: str = "embedding", weight: str = "one", components: int | None = 16) -> DataFrame:
    """The rows of ``df`` with a usable vector (see ``quantised``), and of each

    - ``n``: the total weight of the fit, the number of distinct vectors or with ``weight="count"`` that of rows,
    - ``deviation``: the exact sum over dimensions of (n x - S)^2, NULL beyond the long numbers,
    - ``whitened``: the centred vector on the first ``components`` unit eigenvectors of the covariance (None: all), each over
      the root of its eigenvalue; NULL for components without variance, as all are when there is one distinct vector,
    - ``explained``: the share of each component in the trace, NULL without any variance,
    - ``identity_error``: the largest entry of the measured covariance of ``whitened`` less the identity, over components
      with variance; NULL without any.

    Vectors of each length are fitted by themselves; there should be few lengths, and one matrix of each fits the driver.
    Repeated rows and ids take equal results, rows without an id too. Columns with the names above are replaced.
    """
    if weight not in ("one", "count"):
        raise ValueError("weight is 'one' or 'count'")
    rest = [c for c in df.columns if c not in _RESULT]
    rows = df.select(*[F.col(f"`{c}`") for c in rest], quantised(F.col(f"`{vector}`")).alias("__x")).where("__x is not null")
    times = F.lit(1).cast("long") if weight == "one" else F.count("*")
    listed = rows.groupBy(F.col("__x").alias("x")).agg(times.alias("weight"))
    fit = shared.stored(listed.select("x", *_hashes(F.col("x")), "weight"), "distinct-vectors")

    sums = fit.select("x", "weight").mapInArrow(_summed, "d int, i int, n bigint, total decimal(38,0)")
    totals: dict[int, list] = {}
    for r in sums.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("d", "i").collect():
        totals.setdefault(r["d"], []).append((r["n"], int(r["total"])))
    blank = {d: Components(s[0][0], [t for _, t in s], np.zeros(d), np.eye(d), 0.0) for d, s in totals.items()}
    products = _matrices(fit, "x", {d: c.centred for d, c in blank.items()})
    model = {d: Components.of(c.n, c.sums, products[d] / c.n) for d, c in blank.items()}

    answers = shared.stored(fit.mapInArrow(
        _answers(model, components),
        "x_hash bigint, x_hash_2 bigint, weight bigint, x_size int, deviation bigint, whitened array<double>"), "whitened")
    errors = _identity_errors(answers, model, components)
    shares = [(d, c.n, [float(v / c.trace) for v in c.values[:components]] if c.trace > 0 else [None] * len(c.values[:components]),
               errors[d]) for d, c in model.items()]
    # One row a length.
    facts = df.sparkSession.createDataFrame(shares, "__d int, n bigint, explained array<double>, identity_error double")
    keyed = rows.select(*[f"`{c}`" for c in rest], *[h.alias(f"__{i}") for i, h in enumerate(_hashes(F.col("__x")))])
    found = join_lookup(keyed, answers.drop("weight").withColumnsRenamed({"x_hash": "__0", "x_hash_2": "__1"}), ["__0", "__1"])
    return found.join(F.broadcast(facts), F.col("x_size") == F.col("__d")).select(*[F.col(f"`{c}`") for c in rest], *_RESULT)


def _identity_errors(answers: DataFrame, model: dict[int, Components], most: int | None) -> dict[int, float | None]:
    """The largest entry of the measured covariance less the identity, of each length."""
    active = {d: int((c.values[:most] > 0).sum()) for d, c in model.items()}
    widest = max(active.values(), default=0)
    means = {r["x_size"]: r for r in answers.groupBy("x_size").agg(*[
        (F.sum(F.get("whitened", F.lit(i)) * F.col("weight")) / F.sum("weight")).alias(f"m{i}") for i in range(widest)],
        F.sum("weight").alias("n")).collect()}
    out: dict[int, float | None] = {}
    for d, k in active.items():
        if not k:
            out[d] = None
            continue
        mean = np.array([means[d][f"m{i}"] for i in range(k)])
        these = answers.where(F.col("x_size") == d).select(F.slice("whitened", 1, k).alias("z"), "weight")
        products = _matrices(these, "z", {k: lambda z, mean=mean: z - mean})[k]
        out[d] = float(np.abs(products / model[d].n - np.eye(k)).max())
    return out
