"""Line deduplication: a sharded minimal perfect hash over all distinct lines, probed for counts instead of a join.

1. Each document gives its distinct line keys as pairs of 64-bit hashes; only these small rows are counted.
2. The distinct keys are dealt to shards by hash. Each shard builds a minimal perfect hash (levels of bit arrays, the
   keys that collide in one level move to the next) and lays out two arrays in its order: a fingerprint and the number
   of documents of each key, in the narrowest integer type that holds them.
3. Documents probe the shards. The few keys found in a large share of all documents are looked up from a table whose
   size has a bound; all others go to the shard of their hash, so no shard gets much more than its share.
4. The keys to drop come back per document, and its text is cut.

Different lines are told apart by 128 bits of hash.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import shared

KEYS_PER_SHARD = 1 << 16
# Keys with more than this share of all (document, key) pairs are hot; there are at most 1 / share of them.
HOT_SHARE = 1 / 2048
# Bits per key of a level, and the number of levels after which the rest is kept in a list.
_GAMMA, _LEVELS = 2.0, 24

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        z = x + _GOLDEN * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * _MIX_1
        z = (z ^ (z >> np.uint64(27))) * _MIX_2
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: each key gets its own number below their count."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.bits = [np.unpackbits(x).astype(bool) for x in levels]
        starts = np.cumsum([0, *[int(b.sum()) for b in self.bits]])
        self.ranks = [np.cumsum(b, dtype=np.int64) - 1 + s for b, s in zip(self.bits, starts)]
        self.first_rest = int(starts[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(64, -(-int(len(left) * _GAMMA) // 8) * 8)
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys; a key outside the set gets some number, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            at = (mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.first_rest + at[hit]
        return out


def _joint(high: np.ndarray, low: np.ndarray, seed: int) -> np.ndarray:
    return mix(high, seed) ^ mix(mix(low, seed + 1), seed + 2)


def build_shard(shard: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> dict:
    """One shard's row: seed, levels of the perfect hash, fingerprint and count arrays in its order."""
    seed = 0
    while len(np.unique(keys := _joint(high, low, seed))) < len(keys):
        seed += 3
    hashed = PerfectHash.build(keys)
    at = hashed.index(keys)
    prints, totals = np.empty(len(keys), np.uint32), np.empty(len(keys), np.min_scalar_type(int(counts.max())))
    prints[at], totals[at] = (low & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts
    return {"shard": shard, "seed": seed, "levels": [x.tobytes() for x in hashed.levels], "rest": hashed.rest.tobytes(),
            "prints": prints.tobytes(), "counts": totals.tobytes(), "width": totals.itemsize}


def probe_shard(row: dict, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The number of documents of each key, 0 for keys that are not in the shard."""
    hashed = PerfectHash([np.frombuffer(x, np.uint8) for x in row["levels"]], np.frombuffer(row["rest"], np.uint64))
    prints = np.frombuffer(row["prints"], np.uint32)
    counts = np.frombuffer(row["counts"], np.dtype(f"u{row['width']}"))
    at = hashed.index(_joint(high, low, row["seed"]))
    known = at >= 0
    known[known] = prints[at[known]] == (low[known] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.zeros(len(high), np.int64)
    out[known] = counts[at[known]]
    return out


_SHARD = "shard int, seed int, levels array<binary>, rest binary, prints binary, counts binary, width int"


def line_key(line: bytes) -> bytes:
    """A line without separators at its ends and with A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


Key = Callable[[bytes], bytes]


def _digests(lines: Iterable[bytes], key: Key, least_chars: int) -> list[bytes | None]:
    """16 bytes of hash for each line, None where its key is too short to count."""
    out = []
    for line in lines:
        k = key(line)
        counts = len(k) >= least_chars and (least_chars <= 1 or len(k.decode("utf-8", "replace")) >= least_chars)
        out.append(xxhash.xxh3_128_digest(k) if counts else None)
    return out


def _pairs(key: Key, least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, digests, sizes = batch.column("__row").to_numpy(zero_copy_only=False), [], []
            for text in batch.column("__text").to_pylist():
                found = {d for d in _digests(text.encode().split(b"\n"), key, least_chars) if d is not None}
                digests.extend(found)
                sizes.append(len(found))
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, sizes)), pa.array(both[:, 0]), pa.array(both[:, 1])], ["row", "high", "low"])
    return run


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([build_shard(int(pdf["shard"].iloc[0]), pdf["high"].to_numpy().view(np.uint64),
                                     pdf["low"].to_numpy().view(np.uint64), pdf["n"].to_numpy())])


def _probe(min_docs: int):
    def run(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked[["row", "high", "low"]]
        if not len(index):
            return asked.iloc[:0]
        n = probe_shard(index.iloc[0].to_dict(), asked["high"].to_numpy().view(np.uint64),
                        asked["low"].to_numpy().view(np.uint64))
        return asked[n >= min_docs]
    return run


def _cut(text_at: int, key: Key, least_chars: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drops in zip(batch.column(text_at).to_pylist(), batch.column("__drops").to_pylist()):
                lines = (text or "").encode().split(b"\n")
                left = lines
                if drops:
                    drops = {bytes.fromhex(d[:16])[::-1] + bytes.fromhex(d[16:])[::-1] for d in drops}
                    left = [x for x, d in zip(lines, _digests(lines, key, least_chars)) if d not in drops]
                kept.append(b"\n".join(left).decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            fresh = {"n_lines": n_lines, "n_dropped": n_dropped}
            columns = [pa.array(kept, f.type) if i == text_at else pa.array(fresh[f.name], f.type)
                       if f.name in fresh else batch.column(f.name) for i, f in enumerate(schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
    return run


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """The index over a table of distinct keys (high, low, n), one row per shard."""
    return counts.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, _SHARD)


def _shard(shards: int):
    return F.pmod(F.xxhash64("high"), F.lit(shards)).cast("int")


def frequent_pairs(pairs: DataFrame, counts: DataFrame, min_docs: int) -> DataFrame:
    """The (row, high, low) of ``pairs`` whose key is in ``min_docs`` documents or more."""
    spark = pairs.sparkSession
    total, n_keys = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // KEYS_PER_SHARD))
    index = shared.stored(build_index(counts, shards), "line-index")
    # At most 1 / HOT_SHARE keys are above this count, whatever the size of the tables.
    hot = F.broadcast(counts.where(F.col("n") > max(min_docs, int(total * HOT_SHARE))).select("high", "low"))
    asked = pairs.join(hot, ["high", "low"], "left_anti").withColumn("shard", _shard(shards))
    probed = index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(
        _probe(min_docs), "row long, high long, low long")
    return pairs.join(hot, ["high", "low"], "left_semi").select("row", "high", "low").union(probed)


def drop_frequent_lines(df: DataFrame, text: str = "text", min_docs: int = 10, key: Key = line_key,
                        least_chars: int = 1) -> DataFrame:
    """Documents without the lines whose key is in ``min_docs`` documents or more, plus ``n_lines`` and ``n_dropped``.

    Every row is a document of its own: a repeated row counts again, and ids may be NULL. A NULL or empty text is one
    empty line and comes back empty; an empty key is never dropped. Other columns stay as they are; columns named
    ``n_lines`` or ``n_dropped`` are replaced, names that begin with two underscores are reserved.
    """
    # What a document loses depends on its text alone, so rows are named by a hash of it. Two texts of equal hash would
    # share one list of frequent keys, which changes nothing: both lose every frequent key.
    named = df.withColumn("__row", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    texts = named.select("__row", F.coalesce(F.col(text), F.lit("")).alias("__text"))
    pairs = shared.stored(texts.mapInArrow(_pairs(key, least_chars), "row long, high long, low long"), "line-keys")
    counts = shared.stored(pairs.groupBy("high", "low").agg(F.count("*").alias("n")), "line-counts")
    digest = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("high", "low")])
    drops = shared.stored(
        frequent_pairs(pairs, counts, min_docs).groupBy(F.col("row").alias("__row"))
        .agg(F.collect_set(digest).alias("__drops")), "line-drops")
    fields = [f for f in df.schema if f.name not in ("n_lines", "n_dropped")]
    out = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    joined = named.join(drops.hint("shuffle_hash"), "__row", "left").select(*[f.name for f in fields], "__drops")
    return joined.mapInArrow(
        _cut([f.name for f in fields].index(text), key, least_chars, shared.arrow_schema(out)), out)
