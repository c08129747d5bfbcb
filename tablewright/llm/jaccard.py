"""N-gram Jaccard join: a partition of the universe of shingles, one-deletion neighbourhoods and exact checks.

A document is the set of its distinct five-word shingles; two documents link when |r & s| / |r | s| is 0.75 or more.

1. Shingles are hashed and counted once. A shingle of one set alone can be in no intersection, so from here on a set is
   its size and its shared shingles; sets with fewer than 0.75 of their shingles shared have no partner.
2. Sets of similar size form a band. The band's universe is cut into m segments by hash, with m above the largest
   symmetric difference that linked sets can have. Every set indexes, under its own band, the hash of its part in each
   segment, and in some segments also that of the part less one element (the one-deletion neighbourhood).
3. Linked sets differ by at most H elements; H follows from the set's size and the largest partner it can have. A set probes its own band and the one below with units whose sum is above
   H less its own unshared shingles: one unit for a segment that must be equal, two for one that may differ by one
   element. By the pigeonhole principle a probe meets every partner. Units are chosen by cost, the number of sets that
   hold the rarest shingle of the segment, so empty and frequent segments are left out.
4. Sets that meet are compared exactly: each with the one it meets most often, then sets of different components with
   some at random. What is left in different components and still meets is compared block by block, as products of
   matrices of sets and shingles, and only links that connect components come back, so that no group of near copies is
   expanded into pairs.

Shingles and sets are told apart by 64 bits of hash.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import shared
from .components import components
from .lines import mix

SHINGLE = 5
# Text bytes hashed at once, and stored bytes of input for each partition of shingles.
_CHUNK_BYTES, _PARTITION_BYTES = 1 << 21, 12 << 20
# A shingle of so many sets of one chunk is announced once and not sent for each of them.
_HOT = 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 11)
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_DEAR = 1 << 20  # the cost of a unit that everything would meet


@cache
def _powers(factor: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, factor, np.uint64)]), dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash) of all distinct shingles, ordered by hash and document."""
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    gap = _BLANK[data]
    before = np.concatenate([[True], gap[:-1]])
    begin, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    with np.errstate(over="ignore"):
        size = max(_CHUNK_BYTES * 2, 1 << int(len(data)).bit_length())
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE_VALUES[data] * _powers(_FACTOR, size)[:len(data)])])
        word = mix((sums[end] - sums[begin]) * _powers(_INVERSE, size)[begin], 1)
        first = np.searchsorted(begin, starts)
        count = np.diff(first)
        doc = np.repeat(np.arange(len(texts)), count)
        last = np.repeat(first[1:], count)  # one past the document's last word
        at = np.arange(len(word))
        hashes, padded = np.zeros(len(word), np.uint64), np.concatenate([word, np.zeros(SHINGLE, np.uint64)])
        for k in range(SHINGLE):  # a text of fewer words is one shingle of all of them
            part = padded[k:k + len(word)]
            hashes = hashes * _FACTOR + np.where(at + k < last, part, np.uint64(0))
    whole = (at + SHINGLE <= last) | (at == np.repeat(first[:-1], count))
    hashes, doc = mix(hashes[whole], 2), doc[whole]
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh], hashes[fresh]


def _set_names(doc: np.ndarray, hashes: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and name of each document's set; the name is a hash of its elements, 0 for the empty set."""
    size = np.bincount(doc, minlength=docs)
    sums = np.zeros(docs, np.uint64)
    order = np.argsort(doc, kind="stable")
    filled = np.flatnonzero(size)
    if len(filled):
        with np.errstate(over="ignore"):
            starts = np.concatenate([[0], np.cumsum(size[filled])[:-1]])
            sums[filled] = mix(np.add.reduceat(mix(hashes[order], 3), starts) + size[filled].astype(np.uint64), 4)
    return size, sums.view(np.int64)


# Ascending hashes travel as differences, byte plane by byte plane: the upper planes are zeros that compress away.
def _pack(ascending: np.ndarray) -> bytes:
    deltas = np.diff(ascending, prepend=np.uint64(0))
    return deltas.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("hashes", pa.binary()), ("sets", pa.binary()),
                     ("sizes", pa.binary()), ("at", pa.binary()), ("counts", pa.binary()),
                     ("ids", pa.list_(pa.int64()))])
_PACKED_SQL = ("part int, kind tinyint, hashes binary, sets binary, sizes binary, at binary, counts binary, "
               "ids array<bigint>")
_PAIRS, _ANNOUNCED, _KNOWN, _DOCUMENTS = range(4)


def _row(part: int, kind: int, hashes=None, sets=None, sizes=None, counts=None, ids=None) -> dict:
    """A row of packed arrays; names of sets repeat, so they are a table with numbers into it."""
    row = dict.fromkeys(_PACKED.names) | {"part": part, "kind": kind, "ids": ids}
    if hashes is not None:
        row["hashes"] = hashes
    if sets is not None:
        names, where, at = np.unique(sets, return_index=True, return_inverse=True)
        row |= {"sets": names.tobytes(), "sizes": sizes[where].astype(np.uint32).tobytes(),
                "at": at.astype(np.min_scalar_type(max(1, len(names) - 1))).tobytes()}
    if counts is not None:
        row["counts"] = counts.tobytes()
    return row


def _open(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Names and sizes of the sets of a packed row, one for each element."""
    names, sizes = np.frombuffer(row["sets"], np.int64), np.frombuffer(row["sizes"], np.uint32)
    at = np.frombuffer(row["at"], np.min_scalar_type(max(1, len(names) - 1)))
    return names[at], sizes[at]


def _batches(rows: list[dict], schema: pa.Schema = _PACKED) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _parts(values: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of 64-bit values, numbered from 0."""
    return ((values >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cuts(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, begin, end) of the runs of an ascending array."""
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    return list(zip(part[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(part)]))


def _send(parts: int):
    """Documents -> packed rows, dealt by ranges of shingle hashes."""
    def chunk(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        doc, hashes = shingle_sets(texts)
        size, name = _set_names(doc, hashes, len(texts))
        rows = [_row(int(_parts(name.view(np.uint64)[:1], parts)[0]), _DOCUMENTS, sets=name, sizes=size, ids=ids)]
        once = np.zeros(len(texts), bool)
        once[np.unique(name, return_index=True)[1]] = True  # equal sets of the chunk are sent once
        doc, hashes = doc[once[doc]], hashes[once[doc]]
        begin = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        run = np.diff([*begin, len(hashes)])
        hot = np.repeat(run >= _HOT, run)
        for part, i, j in _cuts(_parts(hashes[~hot], parts)):
            cold, owner = hashes[~hot][i:j], doc[~hot][i:j]
            rows.append(_row(part, _PAIRS, _pack(cold), name[owner], size[owner]))
        if hot.any():
            loud = begin[run >= _HOT]
            for part, i, j in _cuts(_parts(hashes[loud], parts)):
                rows.append(_row(part, _ANNOUNCED, _pack(hashes[loud][i:j]),
                                 counts=run[run >= _HOT][i:j].astype(np.uint32)))
            owner, known = doc[hot], hashes[hot]
            order = np.argsort(name[owner].view(np.uint64), kind="stable")
            owner, known = owner[order], known[order]
            for part, i, j in _cuts(_parts(name[owner].view(np.uint64), parts)):
                rows.append(_row(part, _KNOWN, known[i:j].tobytes(), name[owner[i:j]], size[owner[i:j]]))
        return _batches(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append((text or "").encode())
                held += len(texts[-1])
                if held >= _CHUNK_BYTES:
                    yield chunk(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield chunk(ids, texts)
    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[dict[int, list[dict]], list[dict]]:
    by_kind, through = {_PAIRS: [], _ANNOUNCED: [], _KNOWN: []}, []
    for batch in batches:
        for row in batch.to_pylist():
            (through if row["kind"] == _DOCUMENTS else by_kind[row["kind"]]).append(row)
    return by_kind, through


def _joined(arrays: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.empty(0, dtype)


def _share(parts: int):
    """A range of shingle hashes -> the shingles that two sets or more hold, dealt by ranges of set names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, through = _gathered(batches)
        opened = [_open(r) for r in rows[_PAIRS]]
        hashes = _joined([_unpack(r["hashes"]) for r in rows[_PAIRS]], np.uint64)
        sets, sizes = _joined([o[0] for o in opened], np.int64), _joined([o[1] for o in opened], np.uint32)
        loud = _joined([_unpack(r["hashes"]) for r in rows[_ANNOUNCED]], np.uint64)
        loud_n = _joined([np.frombuffer(r["counts"], np.uint32) for r in rows[_ANNOUNCED]], np.uint32)
        order = np.argsort(hashes, kind="stable")
        hashes, sets, sizes = hashes[order], sets[order], sizes[order]
        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        several = again.copy()
        several[:-1] |= again[1:]
        several |= np.isin(hashes, loud)
        hashes, sets, sizes = hashes[several], sets[several], sizes[several]
        order = np.lexsort((sets, hashes))
        hashes, sets, sizes = hashes[order], sets[order], sizes[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (sets[1:] != sets[:-1])
        hashes, sets, sizes = hashes[fresh], sets[fresh], sizes[fresh]
        names, where, held = np.unique(hashes, return_inverse=True, return_counts=True)
        announced = np.zeros(len(names), np.int64)
        if len(loud):
            at = np.minimum(np.searchsorted(names, loud), max(0, len(names) - 1))
            hit = names[at] == loud if len(names) else np.zeros(len(loud), bool)
            np.add.at(announced, at[hit], loud_n[hit].astype(np.int64))
        total = (held + announced)[where]
        keep = total > 1
        hashes, sets, sizes, total = hashes[keep], sets[keep], sizes[keep], total[keep]
        order = np.argsort(sets.view(np.uint64), kind="stable")
        hashes, sets, sizes, total = hashes[order], sets[order], sizes[order], total[order]
        out = [_row(part, _PAIRS, hashes[i:j].tobytes(), sets[i:j], sizes[i:j], np.minimum(total[i:j], 255).astype(np.uint8))
               for part, i, j in _cuts(_parts(sets.view(np.uint64), parts))]
        out += [r | {"part": r["part"]} for r in rows[_KNOWN] + through]
        for i in range(0, len(out), 1000):
            yield _batches(out[i:i + 1000])
    return run


_SETS = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("shared", pa.list_(pa.int64())), ("costs", pa.binary()),
                   ("doc_id", pa.int64()), ("is_set", pa.bool_())])
_SETS_SQL = "node bigint, n int, shared array<bigint>, costs binary, doc_id bigint, is_set boolean"


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of set names -> the sets that can have partners, and a row for each document."""
    rows, through = _gathered(batches)
    for row in through:
        names, sizes = _open(row)
        filled = sizes > 0
        yield pa.RecordBatch.from_arrays([
            pa.array(names, mask=~filled), pa.array(sizes.astype(np.int32)),
            pa.nulls(len(names), pa.list_(pa.int64())), pa.nulls(len(names), pa.binary()),
            pa.array(row["ids"], pa.int64()), pa.array(np.zeros(len(names), bool))], schema=_SETS)
    both = rows[_PAIRS] + rows[_KNOWN]
    opened = [_open(r) for r in both]
    hashes = _joined([np.frombuffer(r["hashes"], np.uint64) for r in both], np.uint64)
    costs = _joined([np.frombuffer(r["counts"], np.uint8) if r["counts"] is not None else
                     np.full(len(o[0]), 255, np.uint8) for r, o in zip(both, opened)], np.uint8)
    sets, sizes = _joined([o[0] for o in opened], np.int64), _joined([o[1] for o in opened], np.uint32)
    held, at = np.unique(sets, return_inverse=True)
    # Sets that reach the share even if every element came once only; the exact count follows.
    many = np.bincount(at, minlength=len(held))[at] * 4 >= sizes.astype(np.int64) * 3
    hashes, costs, sets, sizes = hashes[many], costs[many], sets[many], sizes[many]
    order = np.lexsort((hashes, sets))
    hashes, costs, sets, sizes = hashes[order], costs[order], sets[order], sizes[order]
    fresh = np.ones(len(sets), bool)
    fresh[1:] = (sets[1:] != sets[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, costs, sets, sizes = hashes[fresh], costs[fresh], sets[fresh], sizes[fresh]
    begin = np.flatnonzero(sets != np.roll(sets, 1)) if len(sets) and sets[0] != sets[-1] else np.arange(len(sets) > 0)
    end = np.append(begin[1:], len(sets)).astype(int)
    out = []
    for i, j in zip(begin.tolist(), end.tolist()):
        if 4 * (j - i) >= 3 * int(sizes[i]):
            out.append({"node": int(sets[i]), "n": int(sizes[i]), "shared": hashes[i:j].view(np.int64),
                        "costs": costs[i:j].tobytes(), "doc_id": None, "is_set": True})
        if len(out) == 1000:
            yield _batches(out, _SETS)
            out = []
    if out:
        yield _batches(out, _SETS)


@cache
def _bands(limit: int) -> np.ndarray:
    """First sizes of the bands: a set of one band can link with sets of the next, and not with those beyond."""
    firsts = [1]
    while firsts[-1] <= limit:
        firsts.append(firsts[-1] * 4 // 3 + 1)
    return np.array(firsts)


def _band(n: int) -> int:
    return int(np.searchsorted(_bands(1 << 32), n, side="right")) - 1


def _segments(band: int) -> tuple[int, int, int]:
    """Largest size of a band, its number of segments, and how many of these have one-deletion neighbourhoods."""
    largest = int(_bands(1 << 32)[band + 1]) - 1
    segments = (largest * 4 // 3 + largest) // 7 + 1
    return largest, segments, segments if segments <= 8 else max(8, -(-segments * 15 // 100))


class _Parts:
    """A set's parts in the segments of a band."""

    def __init__(self, shared_: np.ndarray, costs: np.ndarray, band: int):
        self.largest, self.m, self.deletable = _segments(band)
        seg = (mix(shared_, 20 + band) % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        seg, value, cost = seg[order], mix(shared_[order], 5), costs[order].astype(np.int64)
        begin = np.flatnonzero(np.diff(seg, prepend=-1))
        self.salt = mix(np.arange(self.m, dtype=np.uint64), 1000 + band)
        self.filled = seg[begin]
        self.size = np.zeros(self.m, np.int64)
        self.size[self.filled] = np.diff([*begin, len(seg)])
        sums, self.cheapest = np.zeros(self.m, np.uint64), np.full(self.m, _DEAR, np.int64)
        with np.errstate(over="ignore"):
            sums[self.filled] = np.add.reduceat(value, begin)
            self.cheapest[self.filled] = np.minimum.reduceat(cost, begin)
            self.whole = mix(sums ^ self.salt, 6)
            near = seg < self.deletable
            self.near_seg = seg[near]
            self.near = mix((sums[self.near_seg] - value[near]) ^ self.salt[self.near_seg], 6)
        # What the part less one element would meet: as many as hold its rarest remaining element.
        near_cost, near_at = cost[near], self.near_seg
        second = np.full(self.m, _DEAR, np.int64)
        rarest_once = np.zeros(self.m, bool)
        for s, i, j in _cuts(near_at):
            if j - i > 1:
                low = np.sort(near_cost[i:j])
                second[s], rarest_once[s] = low[1], True
        self.second = np.where(rarest_once, second + self.cheapest * np.maximum(self.size - 1, 0) + self.size, _DEAR)

    def probes(self, units: int) -> tuple[np.ndarray, np.ndarray]:
        """Segments to probe as a whole, and those to probe with one deletion besides: the cheapest ``units``."""
        deletable = np.arange(min(self.deletable, self.m))
        cost = np.concatenate([self.cheapest, np.maximum(self.second[deletable], self.cheapest[deletable] + 1)])
        chosen = np.argsort(cost, kind="stable")[:units]
        near = chosen[chosen >= self.m] - self.m
        return np.union1d(chosen[chosen < self.m], near), near


def signatures(n: int, shared_: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A set's signatures with marks of those it is found by and those it probes with."""
    held, home = len(shared_), _band(n)
    # An intersection has at most the shared elements, so a partner has at most this size; a set that has no partner of
    # its own size or above is found by none, since probes go from the larger set to the smaller.
    most = 7 * held // 3 - n
    out = [(np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, bool))]
    for band in (home, home - 1):
        found = band == home and most >= n
        largest = min(n, most, _segments(band)[0]) if band >= 0 else 0
        probes = largest >= max(-(-3 * n // 4), int(_bands(1 << 32)[band])) if band >= 0 else False
        units = (n + largest) // 7 - (n - held) + 1 if probes else 0
        if not found and units <= 0:
            continue
        parts = _Parts(shared_, costs, band)
        probe, probe_near = np.zeros(parts.m, bool), np.zeros(len(parts.near), bool)
        if units > 0:
            whole, near = parts.probes(units)
            probe[whole] = True
            probe_near = np.isin(parts.near_seg, near)
        keep = np.full(parts.m, found) | probe
        keep_near = np.full(len(parts.near), found) | probe_near
        out.append((np.concatenate([parts.whole[keep], parts.near[keep_near]]),
                    np.full(int(keep.sum() + keep_near.sum()), found),
                    np.concatenate([probe[keep], probe_near[keep_near]])))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


_SIGNED_SQL = "sig bigint, node bigint, n int, held int, found boolean, probe boolean"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for node, n, tokens, costs in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            sig, found, probe = signatures(n, np.array(tokens, np.int64).view(np.uint64), np.frombuffer(costs, np.uint8))
            parts.append((sig.view(np.int64), np.full(len(sig), node, np.int64), np.full(len(sig), n, np.int32),
                          np.full(len(sig), len(tokens), np.int32), found, probe))
            if len(parts) == 500:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*parts)], ["sig", "node", "n", "held", "found", "probe"])
                parts = []
        if parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*parts)], ["sig", "node", "n", "held", "found", "probe"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) and whether their sets link."""
    for end in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"),
                                       F.col("shared").alias(f"shared_{end}")), end)
    both = F.size(F.array_intersect("shared_a", "shared_b")).cast("long")
    counted = pairs.select("a", "b", both.alias("both"), (F.col("n_a") + F.col("n_b")).alias("total"))
    return counted.select("a", "b", (7 * F.col("both") >= 3 * F.col("total")).alias("linked"))


# Rounds of random comparisons before all that is left is compared, and comparisons of a set in each round.
_ROUNDS, _TRIES = 3, 8
# Sets of a crowd that is compared as one; sets and shingles of a block; shingles looked at together.
_CROWD_SETS, _BLOCK_SETS, _BLOCK_SHINGLES, _COLUMNS = 1 << 16, 1024, 1 << 21, 4096


def _live(sets: DataFrame) -> DataFrame:
    """Signatures where a set can meet another; of signatures with the same sets, one."""
    signed = shared.stored(sets.mapInArrow(_sign, _SIGNED_SQL), "signatures")
    met = (signed.groupBy("sig").agg(
               F.count("*").alias("size"), F.bit_xor(F.xxhash64("node", "found", "probe")).alias("members"),
               F.max("found").alias("found"), F.max("probe").alias("probe"),
               F.min("node").alias("low"), F.max("node").alias("high"))
           .where("found and probe and low <> high")
           .groupBy("size", "members").agg(F.min("sig").alias("sig")).select("sig", "size"))
    return shared.stored(signed.join(shared.stored(met, "met"), "sig"), "live")


def _can_link(n: str, held: str, other_n: str, other_held: str) -> Column:
    """Whether two sets of these sizes with so many shared elements can have an intersection that is large enough."""
    return 7 * F.least(held, other_held).cast("long") >= 3 * (F.col(n) + F.col(other_n)).cast("long")


def _centres(live: DataFrame) -> DataFrame:
    """(node, pivot): the set that is met most often, where one that meets many others goes before one that does not."""
    scores = live.groupBy("node").agg(F.sum("size").alias("score"))
    scored = live.join(shared.stored(scores, "scores"), "node")
    chosen = shared.stored(scored.where("probe").groupBy("sig").agg(
        F.max(F.struct("score", "node")).alias("best")), "pivots")
    met = live.select("sig", "node").join(chosen, "sig").where(F.col("node") != F.col("best.node"))
    return (met.groupBy("node", "best").agg(F.count("*").alias("k")).groupBy("node")
            .agg(F.max(F.struct("k", "best")).alias("top")).select("node", F.col("top.best.node").alias("pivot")))


def _placed(live: DataFrame, links: DataFrame) -> DataFrame:
    """The signatures at which sets of different components meet, with their components."""
    roots = components(links)
    placed = shared.stored(live.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    split = placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return shared.stored(placed.join(shared.stored(split.select("sig"), "split"), "sig"), "open")


def _tries(open_: DataFrame, round_: int) -> DataFrame:
    """(node, pivot) of other components: at each signature a random set, of these some for each set."""
    order = F.xxhash64("sig", "node", F.lit(round_))
    chosen = shared.stored(open_.where("probe").groupBy("sig").agg(
        F.min(F.struct(order.alias("h"), "node", "n", "held", "root")).alias("p")), "pivots")
    met = open_.join(chosen, "sig").where((F.col("root") != F.col("p.root")) & _can_link("n", "held", "p.n", "p.held"))
    met = met.select("node", F.col("p.node").alias("pivot")).distinct()
    some = F.slice(F.sort_array(F.collect_list(F.struct(F.xxhash64("pivot", F.lit(round_)).alias("h"), "pivot"))), 1, _TRIES)
    return met.groupBy("node").agg(some.alias("s")).select("node", F.explode("s.pivot").alias("pivot"))


def _links(sets: DataFrame) -> DataFrame:
    """Links between sets that connect all sets that are connected."""
    live = _live(sets)
    pairs = _centres(live).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    links = shared.stored(_compared(pairs, sets).where("linked").select("a", "b"), "star")
    for round_ in range(_ROUNDS):
        open_ = _placed(live, links)
        if open_.isEmpty():
            return links
        more = _compared(_tries(open_, round_).select(F.col("node").alias("a"), F.col("pivot").alias("b")), sets)
        more = shared.stored(more.where("linked").select("a", "b"), "more-links")
        if more.isEmpty():
            break
        links = links.union(more)
    rest = _compared_in_blocks(_crowds(_placed(live, links)), sets)
    return links.union(shared.stored(rest, "rest-links"))


def _crowds(open_: DataFrame) -> DataFrame:
    """(crowd, by_sig, node, root): every two sets of different components that meet are together in some crowd.

    A crowd is all sets that are connected by meeting. Where that is too many, each signature is one of its own.
    """
    open_ = open_.select("sig", "node", "root")
    centre = open_.groupBy("sig").agg(F.min("node").alias("b"))
    together = components(open_.select("sig", F.col("node").alias("a")).join(shared.stored(centre, "centres"), "sig").select("a", "b"))
    named = shared.stored(open_.join(together.withColumnRenamed("root", "crowd"), "node", "left").withColumn(
        "crowd", F.coalesce("crowd", "node")), "met")
    sizes = named.groupBy("crowd", "node").agg(F.lit(1)).groupBy("crowd").agg((F.count("*") > _CROWD_SETS).alias("by_sig"))
    sized = named.join(shared.stored(sizes, "crowd-sizes"), "crowd")
    return sized.select(F.when(F.col("by_sig"), F.col("sig")).otherwise(F.col("crowd")).alias("crowd"), "by_sig", "node", "root").distinct()


def _compared_in_blocks(crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that connect all sets of the crowds that are connected.

    A crowd is dealt to blocks of bounded size, and each two blocks, or one with itself, are compared by one task, which
    gives back a forest of links and not the pairs.
    """
    held = shared.stored(crowds.join(sets.select("node", "n", "shared"), "node"), "crowds")
    blocks = held.groupBy("crowd", "by_sig").agg(F.ceil(F.greatest(
        F.count("*") / _BLOCK_SETS, F.sum(F.size("shared")) / _BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = held.join(shared.stored(blocks, "blocks"), ["crowd", "by_sig"]).withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit("block")), "blocks").cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "crowd", "by_sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "root", "shared")
    return each.groupBy("crowd", "by_sig", "i", "j").applyInArrow(_block_links, "a bigint, b bigint")


def _block_links(group: pa.Table) -> pa.Table:
    group = group.combine_chunks()
    node, n, root, block = (group.column(c).to_numpy() for c in ("node", "n", "root", "block"))
    listed = group.column("shared").combine_chunks()
    owner = np.repeat(np.arange(len(node)), np.diff(listed.offsets.to_numpy()))
    _, shingle, count = np.unique(listed.flatten().to_numpy(), return_inverse=True, return_counts=True)
    keep = count[shingle] > 1  # the others are in no intersection
    owner, shingle = owner[keep], (np.cumsum(count > 1) - 1)[shingle[keep]]
    order = np.argsort(shingle, kind="stable")
    owner, shingle = owner[order], shingle[order]
    first = block == group.column("i")[0].as_py()
    second = block == group.column("j")[0].as_py()
    both = np.zeros((int(first.sum()), int(second.sum())), np.float32)  # whole numbers below 2**24 are exact
    for begin in range(0, int(shingle.max(initial=-1)) + 1, _COLUMNS):
        i, j = np.searchsorted(shingle, [begin, begin + _COLUMNS])
        has = np.zeros((len(node), min(_COLUMNS, int(shingle[-1]) + 1 - begin)), np.float32)
        has[owner[i:j], shingle[i:j] - begin] = 1
        both += has[first] @ has[second].T
    linked = (7 * both.astype(np.int64) >= 3 * (n[first, None].astype(np.int64) + n[None, second])) & (
        root[first, None] != root[None, second])
    x, y = np.nonzero(linked)
    ends = np.sort(np.stack([root[first][x], root[second][y]]), axis=0)
    _, where = np.unique(ends, axis=1, return_index=True)
    parent: dict[int, int] = {}
    a, b = [], []
    for k in where.tolist():  # a link between two components that no earlier ones connect
        u, v = (int(e[k]) for e in ends)
        while u in parent:
            u = parent[u]
        while v in parent:
            v = parent[v]
        if u != v:
            parent[max(u, v)] = min(u, v)
            a.append(int(node[first][x[k]]))
            b.append(int(node[second][y[k]]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def join(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``df``.

    Words are runs without separators, A-Z lower-cased; a text of one to four words is one shingle, a NULL text or one
    without words has none and links with nothing. Rows with equal sets are one node, so copies and repeated rows cost
    nothing. A row with a NULL id can connect others but names no component: ``component_id`` is the smallest id that
    is not NULL, or NULL if there is none.
    """
    parts = shared.partitions_for(df, _PARTITION_BYTES)
    sent = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_send(parts), _PACKED_SQL)
    common = sent.repartitionById(parts, F.col("part")).mapInArrow(_share(parts), _PACKED_SQL)
    tables = shared.stored(common.repartitionById(parts, F.col("part")).mapInArrow(_collect, _SETS_SQL), "shingle-sets")
    documents, sets = tables.where("not is_set"), tables.where("is_set")
    roots = components(_links(sets))
    # A class is a component of sets, or a set on its own; its name is the smallest id of its documents.
    placed = shared.stored(documents.join(roots, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "node").alias("root")), "classes")
    names = shared.stored(placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    named = placed.join(names, "root", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id"))
                        .otherwise(F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows of ``df`` without near copies: of each component the document of the smallest id, once.

    Rows of one id and unrelated texts are documents of their own. Rows without an id are no copies of others and stay.
    """
    own = df.where(F.col(id_column).isNotNull()).withColumn("__key", F.xxhash64(id_column, text))
    named = join(own.select("__key", text), text, "__key").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    placed = own.select("__key", F.col(id_column).alias("__id")).distinct().join(shared.stored(named, "named"), "__key")
    kept = placed.groupBy("component_id").agg(F.min(F.struct("__id", "__key"))["__key"].alias("__key"))
    first = own.join(shared.stored(kept.select("__key"), "kept"), "__key", "left_semi").dropDuplicates(["__key"]).select(*[f"`{c}`" for c in df.columns])
    return first.union(df.where(F.col(id_column).isNull()))
