"""Periodic runs in texts: suffix trees of a document and its reversal, and Lyndon roots extended both ways.

A run is a stretch of words with smallest period p that no neighbour extends. Ukkonen's algorithm builds the suffix trees
of a word sequence and of its reversal; an Euler tour of each answers in constant time how far two places agree to the
right and to the left, as the depth of the lowest common ancestor of two leaves. The leaves in order of the tour rank the
suffixes, and the next smaller and the next greater suffix of every place bound the longest Lyndon words that begin there
under the two orders of the alphabet. Every run has such a word as its root, so extending each of them both ways finds all
runs, at most as many as there are words.

In a run of at least four periods every pair of neighbouring words is found three times or more. Stretches are cut at rarer
pairs, again and again until none is left; trees are built over what remains, which is all of any run.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import shared

LEAST_WORDS, LEAST_PERIODS = 6, 4
_SLICE_BYTES = 1 << 20
_BLOCK = 16


def suffix_tree(s: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ukkonen's tree of ``s``, which ends with a symbol found nowhere else.

    Returned are the nodes below each node as edges (parent, child) ordered by parent and first symbol, the length of the
    edge into each node, and the leaf of each suffix. Node 0 is the root.
    """
    n, k = len(s), max(s) + 1
    start, end, link, edges = [0], [0], [0], {}
    leaves = []
    node, edge, length, rest = 0, 0, 0, 0
    for i, c in enumerate(s):
        rest += 1
        last = 0
        while rest:
            if not length:
                edge = i
            key = node * k + s[edge]
            child = edges.get(key)
            if child is None:
                edges[key] = len(start)
                leaves.append(len(start))
                start.append(i)
                end.append(n)
                link.append(0)
                if last:
                    link[last] = node
                    last = 0
            else:
                begin = start[child]
                whole = end[child] - begin
                if length >= whole:
                    edge += whole
                    length -= whole
                    node = child
                    continue
                if s[begin + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                split = len(start)
                edges[key] = split
                start += (begin, i)
                end += (begin + length, n)
                link += (0, 0)
                leaves.append(split + 1)
                start[child] = begin + length
                edges[split * k + c] = split + 1
                edges[split * k + s[begin + length]] = child
                if last:
                    link[last] = split
                last = split
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    order = np.argsort(keys)
    children = np.fromiter(edges.values(), np.int64, len(edges))[order]
    return keys[order] // k, children, np.array(end) - np.array(start), np.array(leaves)


class CommonExtension:
    """How many words two suffixes of a sequence share at their beginning, in constant time, and their order."""

    def __init__(self, words: list[int]):
        """``words`` are positive numbers."""
        parents, children, lengths, leaves = suffix_tree([*words, 0])
        nodes = len(lengths)
        first = np.searchsorted(parents, np.arange(nodes + 1)).tolist()
        below, size = children.tolist(), lengths.tolist()
        depth, seen, tour = [0] * nodes, [0] * nodes, []
        stack = [0]
        while stack:  # a node is pushed again, as its complement, between its children
            node = stack.pop()
            if node < 0:
                tour.append(depth[~node])
                continue
            seen[node] = len(tour)
            here = depth[node]
            tour.append(here)
            for child in below[first[node]:first[node + 1]][::-1]:
                depth[child] = here + size[child]
                stack += (~node, child)
        self.place = np.array(seen)[leaves]  # of each suffix in the tour; also its rank among the suffixes
        padded = np.zeros(-(-len(tour) // _BLOCK) * _BLOCK + _BLOCK, np.int32)
        padded[:len(tour)] = tour
        self.tour = padded
        blocks = padded.reshape(-1, _BLOCK)
        self.upto = np.minimum.accumulate(blocks, axis=1).ravel()
        self.onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 * (span := 1 << (len(self.table) - 1)) <= len(blocks):
            low = self.table[-1]
            self.table.append(np.minimum(low[:-span], low[span:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common lengths of the suffixes at ``a`` and those at ``b``, all different from each other."""
        a, b = self.place[a], self.place[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        out = np.empty(len(low), np.int64)
        first, last = low // _BLOCK, high // _BLOCK
        near = first == last
        if near.any():
            at = np.minimum(low[near, None] + np.arange(_BLOCK), high[near, None])
            out[near] = self.tour[at].min(axis=1)
        far = ~near
        low, high, first, last = low[far], high[far], first[far] + 1, last[far]
        found = np.minimum(self.onward[low], self.upto[high])
        level = np.frexp(np.maximum(last - first, 1))[1] - 1
        for k in np.unique(level):
            at = (level == k) & (last > first)
            found[at] = np.minimum(found[at], np.minimum(self.table[k][first[at]], self.table[k][last[at] - (1 << k)]))
        out[far] = found
        return out


def next_beyond(rank: list[int]) -> list[int]:
    """For each place the next one of a smaller rank, or the length."""
    n = len(rank)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        r, j = rank[i], i + 1
        while j < n and rank[j] > r:
            j = out[j]
        out[i] = j
    return out


def runs(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs of at least LEAST_WORDS words and LEAST_PERIODS periods, by start and period."""
    n = len(words)
    numbers = (np.unique(words, return_inverse=True)[1] + 1).tolist()
    ahead, back = CommonExtension(numbers), CommonExtension(numbers[::-1])
    rank = ahead.place
    at = np.arange(n)
    found = []
    for order in (rank, -rank):
        period = np.array(next_beyond(order.tolist()))[:n] - at
        # A run of several periods has a root that is followed by its first word again.
        root = np.flatnonzero((LEAST_PERIODS * period <= n) & (at + period < n))
        root = root[words[root] == words[root + period[root]]]
        p = period[root]
        right, left = ahead(root, root + p), back(n - root, n - root - p)
        found.append(np.stack([root - left, left + p + right, p], axis=1))
    both = np.concatenate(found)
    both = both[(both[:, 1] >= LEAST_WORDS) & (both[:, 1] >= LEAST_PERIODS * both[:, 2])]
    return np.unique(both[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def stretches(words: np.ndarray, document: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the parts of single documents that can hold runs; all pairs in a part are found three times in it."""
    at = np.flatnonzero(document[1:] == document[:-1])
    pair = np.unique(words[at] * (int(words.max(initial=0)) + 1) + words[at + 1], return_inverse=True)[1]
    while len(at):
        begin = np.diff(at, prepend=-2) > 1
        begin[1:] |= document[at[1:]] != document[at[:-1]]
        part = np.cumsum(begin) - 1
        _, where, count = np.unique(part * (int(pair.max()) + 1) + pair, return_inverse=True, return_counts=True)
        keep = (count[where] >= LEAST_PERIODS - 1) & (np.bincount(part)[part] >= LEAST_WORDS - 1)
        if keep.all():
            first = np.flatnonzero(begin)
            return list(zip(at[first].tolist(), (at[np.append(first[1:], len(at)) - 1] + 2).tolist()))
        at, pair = at[keep], pair[keep]
    return []


def runs_of(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """The runs of each text, and its words joined by blanks without those that a run repeats."""
    split = [t.split() for t in texts]
    sizes = [len(w) for w in split]
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    number: dict[bytes, int] = {}
    for w in split:
        for x in w:
            if x not in number:
                number[x] = len(number)
    words = np.fromiter((number[x] for w in split for x in w), np.int64, int(bounds[-1]))
    document = np.repeat(np.arange(len(texts)), sizes)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    dropped = np.zeros(len(words) + 1, np.int64)
    for begin, end in stretches(words, document):
        these = runs(words[begin:end])
        if len(these):
            d = int(document[begin])
            np.add.at(dropped, these[:, 0] + these[:, 2] + begin, 1)
            np.add.at(dropped, these[:, 0] + these[:, 1] + begin, -1)
            found[d].append(these + [begin - int(bounds[d]), 0, 0])
    kept = np.cumsum(dropped) == 0
    out = []
    for d, w in enumerate(split):
        if found[d]:
            w = [x for x, k in zip(w, kept[bounds[d]:bounds[d + 1]].tolist()) if k]
        out.append(b" ".join(w))
    return [np.concatenate(f) if f else np.empty((0, 3), np.int64) for f in found], out


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def _found(text: str, schema: pa.Schema):
    rest = [c for c in schema.names if c not in ("runs", "collapsed")]

    def emit(batch: pa.RecordBatch, begin: int, texts: list[bytes]) -> pa.RecordBatch:
        found, collapsed = runs_of(texts)
        flat = np.concatenate(found)
        each = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        part = batch.slice(begin, len(texts))
        return pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in rest], pa.ListArray.from_arrays(pa.array(offsets), each).cast(schema.field("runs").type),
             pa.array([c.decode() for c in collapsed], pa.string())], names=[*rest, "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held, size = 0, [], 0
            for value in batch.column(text):
                held.append((value.as_py() or "").encode())
                size += len(held[-1])
                if size >= _SLICE_BYTES:
                    yield emit(batch, begin, held)
                    begin, held, size = begin + len(held), [], 0
            if held:
                yield emit(batch, begin, held)
    return run


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``runs``, an array of (start, length, period) in words by start and period, and ``collapsed``.

    Words are stretches without blank, tab and line ends. A run has at least 6 words and 4 periods, its period is its
    smallest, and no neighbouring word extends it. ``collapsed`` is the text of the words that stay, joined by blanks, when
    each run keeps its first period only. A text that is NULL, empty or without words has no runs and collapses to the
    empty text. Repeated rows are answered each for itself. Columns named ``runs`` or ``collapsed`` are replaced.

    A document is searched in one task, with memory in proportion to its longest part that can hold runs.
    """
    rest = df.select(*[f"`{c}`" for c in df.columns if c not in ("runs", "collapsed") or c == text])
    keep = [f for f in rest.schema.fields if f.name not in ("runs", "collapsed")]
    schema = T.StructType([*keep, T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    return rest.mapInArrow(_found(text, shared.arrow_schema(schema)), schema)


def greatest(runs_: str = "runs"):
    """The run of the greatest exact length / period; of equal ones that of the smallest start, then period; else NULL."""
    def better(best, r):
        left, right = best["length"] * r["period"], r["length"] * best["period"]
        return F.when(best.isNull() | (right > left), r).otherwise(best)
    return F.aggregate(runs_, F.lit(None).cast(_RUN), better)  # in order of start and period, so the first of ties stays
