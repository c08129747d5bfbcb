"""SentencePiece encoding and decoding: the best path through the lattice of pieces, by a parallel max-plus scan.

A text is encoded as the sequence of vocabulary pieces with the greatest sum of scores. Pieces hold word
marks only at their start or are runs of marks, so units, each a run of marks and the word behind it, are independent and
repeated ones are looked up. Giant documents are cut into chunks of fixed length, at any
character: a chunk gives the matrix of best scores from each entry state (how many of its first characters an earlier
piece covers) to each exit state (how far its last piece reaches beyond it). Max-plus products of these matrices are
associative, so blocks of chunks are multiplied in parallel, then the blocks of a document; that fixes the state at
every boundary, and each chunk is traced back on its own. Scores are integers, so the order of sums does not matter.

A model whose scores are merge ranks (0, -1, -2, ...) holds no log-probabilities; its pieces get those of Zipf's law,
-log(rank + 1). Characters outside the vocabulary become byte pieces, and so does a word mark that stands in the text,
which makes decoding exact for every text. Of paths with equal scores any one may be taken, the same in every run.
"""
from __future__ import annotations

import math
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from . import shared

MARK = "▁"
# A word mark of the text itself, while marks stand for blanks: a code point that no text holds.
_LITERAL = "\udc81"
# Scores are multiples of 1 / _SCALE, so that sums over a word are exact in single precision too.
_SCALE, _NONE = 1 << 12, -(1 << 60)
_UNKNOWN_PENALTY = 10  # below the lowest score, for a character outside the vocabulary
_LONG_WORD = 200
# A unit: a run of marks and what follows up to the next mark; a text that begins inside a unit has its rest first.
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# The start of a unit behind another character.
_START = re.compile(f"[^{MARK}]{MARK}")
CHUNK_CHARS = 1 << 14
_BLOCK_CHUNKS = 256
_CACHED_WORDS = 120_000
_BATCH_BYTES = 1 << 20


@dataclass
class Pieces:
    """A vocabulary: piece -> (score, id), the byte pieces, and the texts of all ids."""
    scores: dict[str, tuple[int, int]]
    bytes_: list[int]
    texts: dict[int, bytes]
    longest: int
    unknown: int
    searcher: object  # the library's own lattice search over the same pieces and scores
    words: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self):
        # Every beginning of a piece, so that a search stops where no piece goes on.
        self.found = {s[:n]: None for s in self.scores for n in range(1, len(s))} | self.scores
        self.lines_apart = not any("\n" in s for s in self.scores)

    @classmethod
    def load(cls, model: bytes) -> Pieces:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        if any(MARK in p.id_to_piece(i).lstrip(MARK) for i in plain):
            raise ValueError("the model has pieces with a word mark behind another character, so units are not independent")
        given = [p.get_score(i) for i in plain]
        ranks = sorted(given, reverse=True)
        merges = all(s == int(s) for s in given) and ranks[-1] < -1000
        log = {i: -math.log(1 - s) if merges else s for i, s in zip(plain, given)}
        scores = {p.id_to_piece(i): (round(log[i] * _SCALE), i) for i in plain}
        hexes = {p.id_to_piece(i): i for i in range(p.get_piece_size()) if p.is_byte(i)}
        if len(hexes) != 256:
            raise ValueError("the model has no byte pieces, so not every text can be encoded")
        texts = {i: p.id_to_piece(i).replace(MARK, " ").encode() for i in plain}
        bytes_ = [hexes[f"<0x{b:02X}>"] for b in range(256)]
        texts |= {i: bytes([b]) for b, i in enumerate(bytes_)}
        kinds = [(p.id_to_piece(i), scores[p.id_to_piece(i)][0] / _SCALE if i in log else 0.0,
                  1 if i in log else 2 if p.is_unknown(i) else 3 if p.is_control(i) else 6 if p.is_byte(i) else 5)
                 for i in range(p.get_piece_size())]
        lowest = min(score for score, _ in scores.values())
        return cls(scores, bytes_, texts, max(map(len, scores)), lowest - _UNKNOWN_PENALTY * _SCALE,
                   sentencepiece.SentencePieceProcessor(model_proto=unigram_model(kinds)))

    def forward(self, s: str, begin: int, end: int) -> tuple[list[int], list[int]]:
        """Best scores from ``begin`` to each position up to ``end + longest - 1``, by pieces that start before
        ``end``, and the start of the last piece of each."""
        top = min(len(s), end + self.longest - 1)
        best, back = [_NONE] * (top - begin + 1), [-1] * (top - begin + 1)
        best[0], found, scores = 0, self.found, self.scores
        for at in range(begin, end):
            here = best[at - begin]
            if here <= _NONE:
                continue
            if s[at] not in scores:
                score, i = here + self.unknown, at + 1 - begin
                if score > best[i]:
                    best[i], back[i] = score, at
            for stop in range(at + 1, top + 1):
                piece = s[at:stop]
                if piece not in found:
                    break
                if (hit := found[piece]) is not None and (score := here + hit[0]) > best[stop - begin]:
                    best[stop - begin], back[stop - begin] = score, at
        return best, back

    def path(self, s: str, begin: int, back: list[int], stop: int) -> bytes:
        """Ids of the best path from ``begin`` to ``stop`` as little-endian 32-bit integers."""
        ids = []
        while stop > begin:
            at = back[stop - begin]
            found = self.scores.get(s[at:stop])
            ids.extend([found[1]] if found is not None else [self.bytes_[b] for b in reversed(_utf8(s[at]))])
            stop = at
        return array("i", ids[::-1]).tobytes()

    def marked(self, s: str) -> bytes:
        """Ids of symbols that begin with a word mark."""
        return self.marked_all([s])[0]

    def marked_all(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that begin with a word mark, unit by unit; units seen before are looked up."""
        if len(self.words) > _CACHED_WORDS:
            self.words.clear()
        get, split = self.words.get, [_UNIT.findall(t) for t in texts]
        fresh = {w for words in split for w in words if get(w) is None}
        # Where no piece holds a line end, the lines of a unit are independent as well.
        parts = {w: w.split("\n") if self.lines_apart else [w] for w in fresh}
        ids = self._searched({x for p in parts.values() for x in p})
        end = array("i", [self.bytes_[10]]).tobytes()
        for w, p in parts.items():
            self.words[w] = end.join(map(ids.__getitem__, p))
        return [b"".join(map(get, words)) for words in split]

    def _searched(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of short texts by the library's search, of all others by the one here."""
        short = [x for x in parts if x and len(x) <= _LONG_WORD and _LITERAL not in x]
        own, bytes_ = set(parts), set(self.bytes_)
        out = {}
        for x, ids in zip(short, self.searcher.encode(short, num_threads=1) if short else []):
            if bytes_.isdisjoint(ids) and 0 not in ids:
                out[x] = array("i", ids).tobytes()
                own.discard(x)
        for x in own:
            out[x] = self.path(x, 0, self.forward(x, 0, len(x))[1], len(x))
        return out

    def score(self, ids: bytes) -> int:
        """The score of a path; bytes count by character."""
        by_id, total = {i: score for score, i in self.scores.values()}, 0
        for i in np.frombuffer(ids, "<i4").tolist():
            if i in by_id:
                total += by_id[i]
            elif self.texts[i][0] & 0xC0 != 0x80:  # the first byte of a character
                total += self.unknown
        return total

    def _cuts(self, s: str, n: int) -> tuple[int, int]:
        """Starts of the first and the last unit that no entering and no leaving piece crosses, or -1."""
        if (begun := _START.search(s, self.longest - 1, n)) is None:
            return -1, -1
        first = begun.end() - 1
        last = s.rfind(MARK, first, n)
        while s[last - 1] == MARK:
            last -= 1
        return first, last

    def _exits(self, s: str, begin: int, n: int) -> np.ndarray:
        best, _ = self.forward(s, begin, n)
        out = np.full(self.longest, _NONE, np.int64)
        part = best[n - begin:n - begin + self.longest]
        out[:len(part)] = part
        return out

    def matrix(self, s: str, n: int) -> np.ndarray:
        """Best scores of a chunk of n symbols from each entry to each exit state.

        The units between the two cuts add the same to all of them and are left out.
        """
        first, last = self._cuts(s, n)
        out = np.full((self.longest, self.longest), _NONE, np.int64)
        entries = range(min(self.longest, n + 1))
        if first < 0:
            for i in entries:
                out[i] = self._exits(s, i, n)
            return out
        exits = self._exits(s, last, n)
        for i in entries:
            enter = self.forward(s[:first], i, first)[0][first - i]
            out[i] = np.where((exits > _NONE) & (enter > _NONE), enter + exits, _NONE)
        return out

    def trace(self, s: str, n: int, entry: int, exit_: int) -> bytes:
        """Ids of the chunk's pieces for given states; a piece belongs to the chunk it starts in."""
        first, last = self._cuts(s, n)
        if first < 0:
            return self.path(s, entry, self.forward(s, entry, n)[1], n + exit_)
        enter = self.path(s, entry, self.forward(s[:first], entry, first)[1], first)
        middle = self.marked(s[first:last]) if last > first else b""
        return enter + middle + self.path(s, last, self.forward(s, last, n)[1], n + exit_)

    def decode(self, ids) -> str:
        """The text; the blank in front of the first word was added by the encoder."""
        return b"".join(map(self.texts.__getitem__, ids))[1:].decode()


def _field(number: int, value: bytes | int | float) -> bytes:
    """A field of a serialised protocol buffer."""
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3 | 5) + struct.pack("<f", value) if isinstance(value, float) else varint(number << 3) + varint(value)


def unigram_model(pieces: list[tuple[str, float, int]]) -> bytes:
    """A model file of the unigram kind from (piece, score, type); texts go in as they are."""
    listed = b"".join(_field(1, _field(1, p.encode()) + _field(2, float(s)) + _field(3, kind)) for p, s, kind in pieces)
    trainer = _field(3, 1) + _field(35, 1)  # unigram, byte pieces
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return listed + _field(2, trainer) + _field(3, normalizer)


def _utf8(char: str) -> bytes:
    return MARK.encode() if char == _LITERAL else char.encode()


def symbols(text: str) -> str:
    return text.replace(MARK, _LITERAL).replace(" ", MARK)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product of two matrices of scores."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), _NONE)


def boundary_states(matrices: list[np.ndarray], entry: int, exit_: int) -> list[int]:
    """The states before, between and after the matrices on the best path from ``entry`` to ``exit_``."""
    ahead = [np.full(len(matrices[0]), _NONE, np.int64)]
    ahead[0][entry] = 0
    for m in matrices:
        ahead.append(np.maximum((ahead[-1][:, None] + m).max(axis=0), _NONE))
    states = [exit_]
    for scores, m in zip(reversed(ahead[:-1]), reversed(matrices)):
        states.append(int(np.argmax(scores + m[:, states[-1]])))
    return states[::-1]


_loaded: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """The model, loaded once in each worker process."""
    if model not in _loaded:
        _loaded[model] = Pieces.load(model)
    return _loaded[model]


def _lists(ids: list[bytes | None]) -> pa.Array:
    sizes = [0 if x is None else len(x) // 4 for x in ids]
    offsets = pa.array(np.cumsum([0, *sizes], dtype=np.int32), mask=np.array([*[x is None for x in ids], False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(x for x in ids if x), "<i4")))


def _encode(model: bytes, column: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(model)
        for whole in batches:
            for batch in _sliced(whole):
                texts = [MARK + symbols(t) if t else "" for t in batch.column("__text").to_pylist()]
                ids = p.marked_all(texts)
                yield pa.RecordBatch.from_arrays(
                    [_lists(ids).cast(f.type) if f.name == column else batch.column(f.name) for f in schema], schema=schema)
    return run


def _sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts have a bounded length, but for single rows."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("__text")), 0).to_numpy())
    begin = 0
    while begin < batch.num_rows:
        before = int(sizes[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, before + _BATCH_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


_CHUNKS_SQL = "key string, no int, n int, text string"
_CHUNKS = pa.schema([("key", pa.string()), ("no", pa.int32()), ("n", pa.int32()), ("text", pa.string())])


def _chunk(longest: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = range(0, len(text), size)
                for some in range(0, len(starts), _BLOCK_CHUNKS):
                    part = starts[some:some + _BLOCK_CHUNKS]
                    yield pa.RecordBatch.from_pydict({
                        "key": [key] * len(part), "no": [some + i for i in range(len(part))],
                        "n": [min(size, len(text) - a) for a in part],
                        "text": [text[a:a + size + longest - 1] for a in part]}, schema=_CHUNKS)
    return run


def _chunk_symbols(no: int, n: int, text: str) -> tuple[str, int]:
    """Symbols and length of a chunk; the first has the mark in front of the text."""
    return (MARK + symbols(text), n + 1) if no == 0 else (symbols(text), n)


def _matrices(model: bytes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _pieces(model)
        for f in frames:
            made = [p.matrix(*_chunk_symbols(no, n, t)).tobytes() for no, n, t in zip(f["no"], f["n"], f["text"])]
            yield pd.DataFrame({"key": f["key"], "block": f["no"] // _BLOCK_CHUNKS, "no": f["no"], "matrix": made})
    return run


def _square(data: bytes) -> np.ndarray:
    m = np.frombuffer(data, np.int64)
    return m.reshape(math.isqrt(len(m)), -1)


def _block(f: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for m in map(_square, f.sort_values("no")["matrix"]):
        whole = m if whole is None else product(whole, m)
    return pd.DataFrame({"key": f["key"].iloc[:1], "block": f["block"].iloc[:1], "matrix": [whole.tobytes()]})


def _between_blocks(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("block")
    states = boundary_states([_square(m) for m in f["matrix"]], 0, 0)
    return pd.DataFrame({"key": f["key"], "block": f["block"], "entry": states[:-1], "exit": states[1:]})


def _within_block(f: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values("no")
    states = boundary_states([_square(m) for m in f["matrix"]], int(ends["entry"].iloc[0]), int(ends["exit"].iloc[0]))
    return pd.DataFrame({"key": f["key"], "no": f["no"], "entry": states[:-1], "exit": states[1:]})


def _traced(model: bytes):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _pieces(model)
        for f in frames:
            ids = [np.frombuffer(p.trace(*_chunk_symbols(no, n, t), i, j), "<i4")
                   for no, n, t, i, j in zip(f["no"], f["n"], f["text"], f["entry"], f["exit"])]
            yield pd.DataFrame({"key": f["key"], "no": f["no"], "ids": ids})
    return run


def _giants(texts: DataFrame, model: bytes, chunk: int) -> DataFrame:
    """(key, ids) of the distinct texts (key, text), by chunks."""
    longest = _pieces(model).longest
    chunks = shared.stored(texts.dropDuplicates(["key"]).select("key", "text").mapInArrow(
        _chunk(longest, chunk), _CHUNKS_SQL), "piece-chunks")
    matrices = shared.stored(chunks.mapInPandas(_matrices(model), "key string, block int, no int, matrix binary"), "piece-matrices")
    blocks = matrices.groupBy("key", "block").applyInPandas(_block, "key string, block int, matrix binary")
    ends = blocks.groupBy("key").applyInPandas(_between_blocks, "key string, block int, entry int, exit int")
    states = matrices.groupBy("key", "block").cogroup(ends.groupBy("key", "block")).applyInPandas(
        _within_block, "key string, no int, entry int, exit int")
    traced = chunks.join(states, ["key", "no"]).mapInPandas(_traced(model), "key string, no int, ids array<int>")
    in_order = F.sort_array(F.collect_list(F.struct("no", "ids")))
    return traced.groupBy("key").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))


def read_model(path: str | os.PathLike) -> bytes:
    """A model file of the driver; tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, model: bytes, text: str = "text", output: str = "piece_ids", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The table with an array of piece ids for each text; NULL and empty texts have none.

    A column of the output's name is replaced; names that begin with two underscores are reserved. Texts of up to
    ``chunk_chars`` characters are encoded where they lie, longer ones by chunks, each distinct text once.
    """
    if chunk_chars < 2 * _pieces(model).longest:
        raise ValueError("chunks must be longer than two pieces")
    spark = df.sparkSession
    columns = [c for c in df.columns if c != output or c == text]
    body = df.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    out = T.StructType([*[f for f in df.schema if f.name != output], T.StructField(output, T.ArrayType(T.IntegerType()))])
    big = F.length("__text") > chunk_chars
    # Spark keeps a shipped function for each task; the model's half megabyte travels with it.
    small = body.where(~big).mapInArrow(_encode(model, output, shared.arrow_schema(out)), out)
    large = body.where(big).withColumn("__key", F.md5("__text"))
    ids = shared.stored(_giants(large.select(F.col("__key").alias("key"), F.col("__text").alias("text")), model, chunk_chars), "giant-ids")
    whole = large.join(ids.hint("shuffle_hash"), large["__key"] == ids["key"]).select(
        *[F.col(f.name) for f in out if f.name != output], F.col("ids").alias(output))
    return small.union(whole)


@cache
def _piece_texts(model: bytes) -> pa.Array:
    """The bytes of every id: all that decoding needs of a model."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    return pa.array([bytes([int(t[3:5], 16)]) if p.is_byte(i) else t.replace(MARK, " ").encode()
                     for i in range(p.get_piece_size()) for t in [p.id_to_piece(i)]], pa.binary())


def decoded(ids: pa.ListArray, texts: pa.Array) -> pa.Array:
    """The texts of lists of ids, less the blank in front of the first word; NULL stays NULL."""
    parts = texts.take(ids.flatten())
    stop = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy())])
    lists = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
    bounds = stop[lists]
    data = np.frombuffer(parts.buffers()[2], np.uint8)[:bounds[-1]] if bounds[-1] else np.empty(0, np.uint8)
    filled = np.diff(bounds) > 0
    bounds, data = bounds - np.concatenate([[0], np.cumsum(filled)]), np.delete(data, bounds[:-1][filled])
    whole = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])
    return pc.if_else(ids.is_valid(), whole.cast(pa.string()), None)


def _decode(model: bytes, ids: str, output: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = _piece_texts(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays(
                    [decoded(some.column(ids), texts).cast(f.type) if f.name == output else some.column(f.name) for f in schema],
                    schema=schema)
    return run


def decode(df: DataFrame, model: bytes, ids: str = "piece_ids", output: str = "text") -> DataFrame:
    """The table with the text of each array of ids in ``output``, replacing a column of that name; NULL stays NULL."""
    out = T.StructType([*[f for f in df.schema if f.name != output], T.StructField(output, T.StringType())])
    return df.mapInArrow(_decode(model, ids, output, shared.arrow_schema(out)), out)
