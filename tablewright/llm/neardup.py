"""Embedding near-duplicates: Euclidean p-stable hashing in several tables, followed by exact cosines.

Vectors are brought to length 1, where cosine 0.9 is a distance of sqrt(0.2). A table projects them on k Gaussian
directions, shifts and quantises with a bucket width; vectors in the same bucket are compared. k follows from the number
of vectors, so that unrelated ones fill a bucket to a bounded number, and the number of tables from the wanted chance of
a pair at the threshold to share a bucket somewhere. Every pair that is compared is compared exactly, in double
precision where single precision cannot tell, so a link is never wrong; with the default chance about one in a hundred of
the pairs that lie just at the threshold is missed, and fewer of closer ones.

Equal vectors are one class from the start and count by their number. Classes are stored once, some thousand packed in a
row, with a byte of their bucket number in each table. The tables' buckets are dealt to units of some megabytes, and a round
ships the classes of as many units as its share of the disk allows; its shuffle files go before the next round begins. A
bucket with many classes is cut into blocks, and every two blocks are compared in a task of their own. A pair counts in
the first table in which it meets, so that no list of pairs is ever made: a task gives for each class how many vectors it
links with, and a spanning forest of links.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import shared
from .components import components

THRESHOLD = 0.9
# Bucket width, unrelated vectors in a bucket, chance for a pair at the threshold to meet, classes in a block.
_WIDTH, _CROWD, _CHANCE, _BLOCK = 2.0, 32, 0.99, 8192
_SEED = 7
# Classes in a row of the packed table and in a step of a task; bytes of a unit, and of a round if the vectors have less.
_PACK, _STEP, _UNIT_BYTES, _ROUND_BYTES = 4096, 1 << 16, 32 << 20, 256 << 20
# Buckets up to these sizes are compared many at a time; pairs that are looked at together.
_TIERS, _PAIRS = (8, 16, 32, 64), 1 << 17


def meeting_chance(distance: float, width: float = _WIDTH) -> float:
    """The chance that one quantised projection puts two vectors at this distance into one bucket."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(classes: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections in a table, number of tables) for a number of vectors."""
    near, far = meeting_chance(math.sqrt(2 - 2 * threshold)), meeting_chance(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(classes / _CROWD, 1.0)) / -math.log(far)))
    return k, math.ceil(math.log(1 - _CHANCE) / math.log(1 - near ** k))


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows brought to length 1 in double precision; rows that cannot be compared hold something that is not finite."""
    x = raw.astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        x /= np.where((norm > 0) & np.isfinite(norm), norm, np.nan)[:, None]
    return x


_SEEN_SQL = "deal bigint, vec_id bigint, class bigint, size bigint, vector binary"


def _usable(kind: str):
    """For each row its class, a digest of its vector's direction or NULL if that cannot be compared; and for each class of
    a batch its size and a vector as it came, so that one with many vectors has a row a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, count = batch.column("embedding"), batch.num_rows
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            classes, usable, vectors = np.zeros(count, np.int64), np.zeros(count, bool), [b""] * count
            for d in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == d)
                for i in range(0, len(at), _PACK):
                    rows = at[i:i + _PACK]
                    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)  # NULL becomes NaN
                    raw = flat.astype(kind).reshape(len(rows), d)
                    x = _unit(raw) + 0.0
                    for j in np.flatnonzero(np.isfinite(x).all(axis=1)).tolist():
                        digest = hashlib.blake2b(x[j].tobytes(), digest_size=8).digest()
                        classes[rows[j]] = int.from_bytes(digest, "little", signed=True)
                        usable[rows[j]], vectors[rows[j]] = True, raw[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(count)), batch.column("vec_id"), pa.array(classes, mask=~usable),
                 pa.nulls(count, pa.int64()), pa.nulls(count, pa.binary())], ["deal", "vec_id", "class", "size", "vector"])
            at = np.flatnonzero(usable)
            found, first, n = np.unique(classes[at], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.nulls(len(found), pa.int64()), pa.array(found), pa.array(n, pa.int64()),
                 pa.array([vectors[j] for j in at[first].tolist()], pa.binary())], ["deal", "vec_id", "class", "size", "vector"])
    return run


@lru_cache(maxsize=4)
def _directions(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, shifts and odd multipliers of each table, the same in every task."""
    rng = np.random.default_rng([_SEED, dim])
    a, b = rng.standard_normal((dim, k * tables)), rng.uniform(0, _WIDTH, k * tables)
    m = rng.integers(0, 1 << 62, k * tables, dtype=np.int64) | 1
    return np.ascontiguousarray(a.reshape(dim, tables, k).swapaxes(0, 1)), b.reshape(tables, k), m.reshape(tables, k)


def bucket_numbers(x: np.ndarray, k: int, tables: int, table: int) -> np.ndarray:
    """The bucket number of each vector in a table; vectors of other lengths never meet."""
    a, b, m = _directions(x.shape[1], k, tables)
    cells = np.floor((x @ a[table] + b[table]) / _WIDTH).astype(np.int64)
    with np.errstate(over="ignore"):
        return (cells * m[table]).sum(axis=1) * 31 + x.shape[1]


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Numbers whose highest bits depend on all bits of those given."""
    with np.errstate(over="ignore"):
        n = numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (n ^ (n >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _class_kind(dim: int, tables: int, kind: str) -> np.dtype:
    """A class as it is stored: a byte of its bucket number in each table tells most buckets apart."""
    return np.dtype([("class", "<i8"), ("size", "<i8"), ("marks", "u1", (tables,)), ("x", kind, (dim,))])


def _shipped_kind(dim: int, table: int, kind: str) -> np.dtype:
    """A class as a table ships it: with its bucket and the marks of the tables before."""
    return np.dtype([("bucket", "<i8"), ("class", "<i8"), ("size", "<i8"), ("marks", "u1", (table,)), ("x", kind, (dim,))])


_ROW, _CLASSES, _CROWDED = 0, 1, 2
_PACKED = pa.schema([("what", pa.int32()), ("vec_id", pa.int64()), ("class", pa.int64()), ("dim", pa.int32()),
                     ("bytes", pa.int64()), ("data", pa.binary()), ("table", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64())])
_PACKED_SQL = "what int, vec_id bigint, class bigint, dim int, bytes bigint, data binary, table int, bucket bigint, n bigint"


def _batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of some columns of a schema, the others NULL."""
    count = max(map(len, columns.values()))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)


def _packed(k: int, tables: int, kind: str, classes: int, block: int):
    """The rows as they come; then all partial rows of some classes, packed; and buckets that may be crowded, by what is
    seen here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            rows = np.asarray(batch.column("vector").is_null().to_numpy(zero_copy_only=False))
            some = batch.filter(pa.array(rows))
            if some.num_rows:
                yield _batch(_PACKED, what=[_ROW] * some.num_rows, vec_id=some.column("vec_id"), **{"class": some.column("class")})
            if not rows.all():
                held.append(batch.filter(pa.array(~rows)).select(["class", "size", "vector"]))
        if not held:
            return
        whole = pa.Table.from_batches(held)
        ids, at, which = np.unique(whole.column("class").to_numpy(), return_index=True, return_inverse=True)
        sizes = np.zeros(len(ids), np.int64)
        np.add.at(sizes, which.ravel(), whole.column("size").to_numpy())
        vectors = whole.column("vector").take(pa.array(at)).to_pylist()
        least = max(3, math.ceil(block * len(ids) / classes / 2))
        lengths = np.array([len(v) for v in vectors])
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            raw = np.frombuffer(b"".join(vectors[j] for j in rows.tolist()), kind).reshape(len(rows), -1)
            x, dim = _unit(raw), raw.shape[1]
            out = np.empty(len(rows), _class_kind(dim, tables, kind))
            out["class"], out["size"], out["x"] = ids[rows], sizes[rows], raw
            for table in range(tables):
                numbers = bucket_numbers(x, k, tables, table)
                mixed = _mixed(numbers)
                out["marks"][:, table] = mixed >> np.uint64(56)
                slots = (mixed >> np.uint64(40)).astype(np.int64) & 0xFFFF
                many = (np.bincount(slots, minlength=1 << 16) >= least)[slots]
                if many.any():
                    found, n = np.unique(numbers[many], return_counts=True)
                    found, n = found[n >= least], n[n >= least]
                    yield _batch(_PACKED, what=[_CROWDED] * len(found), table=[table] * len(found), bucket=found, n=n)
            for i in range(0, len(out), _PACK):
                data = out[i:i + _PACK].tobytes()
                yield _batch(_PACKED, what=[_CLASSES], dim=[dim], bytes=[len(data)], data=[data])
    return run


@dataclass(frozen=True)
class _Layout:
    """How the buckets are dealt: ``parts`` units a table, crowded buckets by table: sorted numbers, blocks, places."""
    k: int
    tables: int
    kind: str
    parts: int
    crowded: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


_DEALT = pa.schema([("table", pa.int32()), ("part", pa.int64()), ("i", pa.int32()), ("j", pa.int32()),
                    ("blocks", pa.int32()), ("dim", pa.int32()), ("data", pa.binary())])
_DEALT_SQL = "table int, part bigint, i int, j int, blocks int, dim int, data binary"


def _own_block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return ((_mixed(ids) >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)


def _dealt(layout: _Layout, begin: int, end: int):
    """The classes that the units from ``begin`` to ``end`` compare."""
    k, tables, parts = layout.k, layout.tables, layout.parts

    def table_rows(stored: np.ndarray, x: np.ndarray, table: int) -> Iterator[dict]:
        numbers = bucket_numbers(x, k, tables, table)
        part = ((_mixed(numbers) >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
        at = np.flatnonzero((part >= begin - table * parts) & (part < end - table * parts))

        def shipped(rows: np.ndarray) -> np.ndarray:
            some = np.empty(len(rows), _shipped_kind(x.shape[1], table, layout.kind))
            some["bucket"], some["class"], some["size"] = numbers[rows], stored["class"][rows], stored["size"][rows]
            some["marks"], some["x"] = stored["marks"][rows, :table], stored["x"][rows]
            return some

        if table in layout.crowded:
            known, blocks, places = layout.crowded[table]
            found = np.minimum(np.searchsorted(known, numbers[at]), len(known) - 1)
            full = known[found] == numbers[at]
            for c in np.unique(found[full]).tolist():
                rows, n = at[full & (found == c)], int(blocks[c])
                own = _own_block(stored["class"][rows], n)
                for b in np.unique(own).tolist():
                    data = shipped(rows[own == b]).tobytes()
                    for other in range(n):
                        yield {"table": table, "part": parts + int(places[c]), "i": min(b, other), "j": max(b, other),
                               "blocks": n, "dim": x.shape[1], "data": data}
            at = at[~full]
        at = at[np.argsort(part[at], kind="stable")]
        some, cuts = shipped(at), [0, *(np.flatnonzero(np.diff(part[at])) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield {"table": table, "part": int(part[at[a]]), "i": 0, "j": 0, "blocks": 1, "dim": x.shape[1],
                       "data": some[a:b].tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, data = batch.column("dim").to_pylist(), batch.column("data")
            for dim in sorted(set(dims)):
                packs, each = [i for i, d in enumerate(dims) if d == dim], max(1, _STEP // _PACK)
                for i in range(0, len(packs), each):
                    stored = np.frombuffer(b"".join(data[j].as_py() for j in packs[i:i + each]),
                                           _class_kind(dim, tables, layout.kind))
                    x = _unit(stored["x"])
                    for table in range(begin // parts, (end - 1) // parts + 1):
                        rows, size = [], 0
                        for row in table_rows(stored, x, table):
                            rows.append(row)
                            size += len(row["data"])
                            if size > _UNIT_BYTES:
                                yield pa.RecordBatch.from_pylist(rows, schema=_DEALT)
                                rows, size = [], 0
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, schema=_DEALT)
    return run


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


class _Unit:
    """Classes of some buckets of a table, sorted by bucket: their links, counted and as a forest."""

    def __init__(self, layout: _Layout, table: int, rows: np.ndarray, limit: float):
        self.layout, self.table, self.limit = layout, table, limit
        self.ids, self.sizes = rows["class"], rows["size"].astype(np.float64)
        self.marks, self.x = np.ascontiguousarray(rows["marks"]), _unit(rows["x"])
        self.short = self.x.astype(np.float32)
        # What single precision may be off by: the rounding of both vectors and of as many products and sums.
        self.slack = (self.x.shape[1] + 8) * 1.2e-7
        self.totals, self.parent = np.zeros(len(rows)), np.arange(len(rows))
        self.numbers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting, self.held = [], 0

    def block(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        """Compare all of ``left`` with all of ``right``, each pair once where they are the same."""
        step = max(1, _PAIRS * 8 // max(1, len(right)))
        columns = self.short[right]
        for i in range(0, len(left), step):
            first = i if same else 0
            dots = self.short[left[i:i + step]] @ columns[first:].T
            p, q = np.nonzero(dots >= self.limit - self.slack)
            keep = q > p if same else np.ones(len(p), bool)
            p, q = p[keep], q[keep]
            self.add(left[i + p], right[first + q], dots[p, q])

    def band(self, rows: np.ndarray, run: np.ndarray, most: int) -> None:
        """Compare within runs of at most ``most`` rows: tiles of rows with as many rows again."""
        tiles = -(-len(rows) // most)
        x = np.zeros(((tiles + 1) * most, self.short.shape[1]), np.float32)
        x[:len(rows)] = self.short[rows]
        pairs = np.lib.stride_tricks.as_strided(
            x, (tiles, 2 * most, x.shape[1]), (most * x.strides[0], *x.strides), writeable=False)
        step = max(1, _PAIRS * 4 // (2 * most * most))
        for i in range(0, tiles, step):
            some = pairs[i:i + step]
            dots = np.matmul(some[:, :most], some.transpose(0, 2, 1))
            hits = np.flatnonzero(dots >= self.limit - self.slack)
            tile, place = np.divmod(hits, 2 * most * most)
            p, q = np.divmod(place, 2 * most)
            start = (i + tile) * most
            keep = (q > p) & (start + q < len(rows))
            p, q, hits = (start + p)[keep], (start + q)[keep], hits[keep]
            keep = run[p] == run[q]
            self.add(rows[p[keep]], rows[q[keep]], dots.ravel()[hits[keep]])

    def add(self, p: np.ndarray, q: np.ndarray, dots: np.ndarray) -> None:
        """Take the pairs that link and that no table before has brought together."""
        for i in range(0, len(p), _PAIRS):
            a, b, d = p[i:i + _PAIRS], q[i:i + _PAIRS], dots[i:i + _PAIRS]
            linked, unsure = np.ones(len(a), bool), np.flatnonzero(d < self.limit + self.slack)
            linked[unsure] = np.einsum("ij,ij->i", self.x[a[unsure]], self.x[b[unsure]]) >= self.limit
            self.waiting.append((a[linked], b[linked]))
            self.held += len(self.waiting[-1][0])
            if self.held >= _PAIRS:
                self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        p, q = (np.concatenate(c) for c in zip(*self.waiting))
        self.waiting, self.held = [], 0
        for i in range(0, len(p), _PAIRS):
            a, b = p[i:i + _PAIRS], q[i:i + _PAIRS]
            new = ~self.met(a, b)
            self.link(a[new], b[new])

    def met(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether a table before has brought the pair together: equal marks are held against the bucket numbers."""
        out = np.zeros(len(p), bool)
        alike = self.marks[p] == self.marks[q]
        for table in np.flatnonzero(alike.any(axis=0)).tolist():
            at = np.flatnonzero(alike[:, table] & ~out)
            if not len(at):
                continue
            if table not in self.numbers:
                self.numbers[table] = np.empty(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
            numbers, known = self.numbers[table]
            a, b = p[at], q[at]
            wanted = np.zeros(len(known), bool)
            wanted[a] = wanted[b] = True
            wanted = np.flatnonzero(wanted & ~known)
            if len(wanted):
                numbers[wanted] = bucket_numbers(self.x[wanted], self.layout.k, self.layout.tables, table)
                known[wanted] = True
            out[at] = numbers[a] == numbers[b]
        return out

    def link(self, p: np.ndarray, q: np.ndarray) -> None:
        for ends, others in ((p, q), (q, p)):
            self.totals += np.bincount(ends, weights=self.sizes[others], minlength=len(self.ids))
        while len(p):
            a, b = self.parent[p], self.parent[q]
            apart = a != b
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            # Each root hooks to one smaller root, so no circle comes up.
            hooked, at = np.unique(np.maximum(a, b), return_index=True)
            self.parent[hooked] = np.minimum(a, b)[at]
            self.edges.append((self.ids[p[at]], self.ids[q[at]]))
            while (self.parent != (further := self.parent[self.parent])).any():
                self.parent = further

    def found(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        linked = np.flatnonzero(self.totals)
        if not len(linked):
            return
        a, b = (np.concatenate(c) for c in zip(*self.edges))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([self.ids[linked], a]), pa.int64()),
            pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(b, pa.int64())]),
            pa.concat_arrays([pa.array(self.totals[linked].astype(np.int64)), pa.nulls(len(a), pa.int64())])], schema=_OUT)


def _compared(layout: _Layout, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ordered by unit and pair of blocks: the groups come one after the other."""
        key, held = None, {}
        for batch in batches:
            data = batch.column("data")
            for n, row in enumerate(zip(*[batch.column(c).to_pylist() for c in ("table", "part", "i", "j", "blocks", "dim")])):
                if row[:5] != key:
                    yield from group(key, held)
                    key, held = row[:5], {}
                held.setdefault(row[5], []).append(data[n].as_py())
        yield from group(key, held)

    def group(key, held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for dim in sorted(held):
            table, _, i, j, blocks = key
            rows = np.frombuffer(b"".join(held.pop(dim)), _shipped_kind(dim, table, layout.kind))
            if blocks > 1:
                unit = _Unit(layout, table, rows, limit)
                own = _own_block(np.ascontiguousarray(rows["class"]), blocks)
                unit.block(np.flatnonzero(own == i), np.flatnonzero(own == j), i == j)
                yield from unit.found()
                continue
            _, which, n = np.unique(rows["bucket"], return_inverse=True, return_counts=True)
            order = np.argsort(which.ravel(), kind="stable")
            order = order[n[which.ravel()[order]] > 1]
            if not len(order):
                continue
            run, n = which.ravel()[order], n[n > 1]
            unit, sizes = _Unit(layout, table, rows[order], limit), np.repeat(n, n)
            for least, most in zip((0, *_TIERS), _TIERS):
                if len(at := np.flatnonzero((sizes > least) & (sizes <= most))):
                    unit.band(at, run[at], most)
            starts = np.cumsum(n) - n
            for c in np.flatnonzero(n > _TIERS[-1]).tolist():
                at = np.arange(starts[c], starts[c] + n[c])
                unit.block(at, at, True)
            yield from unit.found()
    return run


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it has ended, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _found(packed: DataFrame, k: int, tables: int, kind: str, threshold: float, block: int, round_bytes: int) -> DataFrame:
    """(a, NULL, n): class a links with n vectors more; (a, b, NULL): a link of the forest."""
    spark, sql = packed.sparkSession, "a bigint, b bigint, n bigint"
    packs = packed.where(F.col("what") == _CLASSES).select("dim", "data", "bytes")
    total = packs.agg(F.sum("bytes")).first()[0]
    if not total:
        return spark.createDataFrame([], sql)
    crowded = packed.where(F.col("what") == _CROWDED).groupBy("table", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    by_table: dict[int, list] = {}
    for place, r in enumerate(crowded.orderBy("table", "bucket").collect()):
        by_table.setdefault(r["table"], []).append((r["bucket"], -(-r["n"] // block), place))
    unit = max(1, min(_UNIT_BYTES, round_bytes // (4 * spark.sparkContext.defaultParallelism)))
    layout = _Layout(k, tables, kind, -(-total // unit), {t: tuple(np.array(c, np.int64) for c in zip(*b)) for t, b in by_table.items()})
    units, paths = max(1, round_bytes // -(-total // layout.parts)), []
    for begin in range(0, tables * layout.parts, units):
        end = min(begin + units, tables * layout.parts)
        dealt = packs.select("dim", "data").mapInArrow(_dealt(layout, begin, end), _DEALT_SQL)
        group = ["table", "part", "i", "j"]
        links = dealt.repartition(end - begin, *group).sortWithinPartitions(*group).mapInArrow(
            _compared(layout, threshold), sql)
        paths.append(shared.stored_path(links, "vector-links"))
    return spark.read.schema(sql).parquet(*paths)


def near_duplicates(df: DataFrame, embedding: str = "embedding", id_column: str = "vec_id", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``df``.

    A vector that is NULL, zero or holds a NULL or non-finite component links with nothing and is its own component.
    Rows that repeat an id are vectors like any other; a row without an id links too but names no component.
    """
    with _shuffles_removed(df.sparkSession):
        return _near_duplicates(df, embedding, id_column, threshold)


def _near_duplicates(df: DataFrame, embedding: str, id_column: str, threshold: float) -> DataFrame:
    spark = df.sparkSession
    single = df.select(embedding).schema[0].dataType.simpleString() == "array<float>"
    kind, of = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(embedding).cast(of).alias("embedding"))
    seen = rows.mapInArrow(_usable(kind), _SEEN_SQL)
    # The rows are read twice, first for the number of classes, so that their vectors are written only once, with marks.
    each = seen.where("vector is not null").groupBy("class").agg(F.sum(F.length("vector")).alias("bytes"))
    count, total = each.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    k, tables = plan(count, threshold)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // _UNIT_BYTES))
    packed = seen.repartition(parts, "deal").mapInArrow(_packed(k, tables, kind, count, _BLOCK), _PACKED_SQL)
    packed = shared.stored(packed, "vectors", by="what")
    vectors = packed.where(F.col("what") == _ROW).select("vec_id", "class")
    usable = vectors.where("class is not null")
    classes = shared.stored(usable.groupBy("class").agg(
        F.count("*").alias("size"), F.min("vec_id").alias("first")), "vector-classes")
    found = _found(packed, k, tables, kind, threshold, _BLOCK, max(_ROUND_BYTES, total))
    totals = found.where("n is not null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("b is not null").select("a", "b"))
    named = classes.select("class", "size", "first").join(totals, "class", "left").join(
        roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = shared.stored(named.select("class", "size", "first", "root", F.coalesce("linked", F.lit(0)).alias("linked")), "named")
    firsts = shared.stored(named.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    known = shared.stored(named.join(firsts, "root").select(
        "class", "component_id", (F.col("linked") + F.col("size") - 1).alias("n_links")), "vector-components")
    lone = vectors.where("class is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = usable.select("vec_id", "class").join(known, "class").select("vec_id", "n_links", "component_id")
    return joined.union(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
