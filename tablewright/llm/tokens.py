"""Token-id files: each document compressed on its own with one dictionary that is trained on serialised id arrays.

A part file holds, in ascending order of doc_id:

    magic, SHA-256 of the dictionary, width of an id in bytes
    the documents, each a Zstandard frame of its little-endian ids
    index: doc_ids, a byte for each that is present, offsets of the frames (one more than documents), numbers of ids
    number of documents, place of the index, magic

so one document is read with two range reads. The dictionary lies beside the parts. A table of the parts says how many
ids come before each. Ids are narrow unsigned integers: two bytes for vocabularies of up to 65 536.
"""
from __future__ import annotations

import gc
import hashlib
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import files, shared

MAGIC = b"TWTOKEN1"
_HEAD, _TAIL = "<8s32sB", "<QQ8s"
_HEAD_BYTES, _TAIL_BYTES = struct.calcsize(_HEAD), struct.calcsize(_TAIL)
# The dictionary is fitted on so many documents, with the first ids of each, whatever the size of the table.
SAMPLE_DOCUMENTS, SAMPLE_IDS, DICTIONARY_BYTES = 512, 4096, 64 << 10
_BATCH_BYTES, _PART_BYTES = 1 << 20, 12 << 20
# A generation of looked-up words: so many words or bytes of them; the one before it is kept as well.
_CACHED_WORDS, _CACHED_BYTES = 220_000, 24 << 20


_MARKS = ".,!?;:#$%&*"
# Letters of scripts before this one are told from other characters by Python as by the splitter.
_BEYOND_LATIN = "\u0250"
# Byte-level vocabularies spell bytes that do not print as characters from 256 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_UNPRINTED = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
# Neighbouring white space as Python knows it.
_SPACES = r"[\s\v\x1c-\x1f\x{85}\p{Z}]{2}"
# Whether a vocabulary's merges take plain letters as they are shows on these.
_PROBES = ("the", "quick", "BROWN", "xqzzv", "Foxjumpsoverthelazydog", "Übergröße", "àèìòùçñ", "łódź")


def _spelled(word: str) -> str:
    """A word's bytes as byte-level vocabularies spell them."""
    return word.encode().decode("latin-1").translate(_UNPRINTED)


# Letters below _BEYOND_LATIN, a word of nothing else, and their spelling, character by character.
_LETTERS = [chr(c) for c in range(ord(_BEYOND_LATIN)) if chr(c).isalpha()]
_LETTERS_ONLY = f"^[{''.join(_LETTERS)}]+$"
_SPELLED = {ord(c): _spelled(c) for c in _LETTERS}
# A word that the punctuation behind it is cut from ends so; and what stands before that punctuation.
_CUT_END, _BEFORE_MARKS = r"[\pL\pN]$", f"(?s)^.*[^{_MARKS}]"
# White space of ASCII beside the blank and the line end.
_ODD_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"


class Encoder:
    """Ids of texts, each as little-endian bytes, with repeated words looked up.

    It is for byte-level vocabularies. Their splitter always starts a new piece at a single blank between other
    characters, so texts are encoded word by word; texts with neighbouring white space or special tokens go whole.
    """

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_SPACES, *map(re.escape, special)])
        # Numbers of looked-up words in the two generations; the ids of number n end at ends[n + 1].
        self.words: dict[str, int] = {}
        self.before: dict[str, int] = {}
        self.bytes = 0
        self.ids, self.ends = array(self.dtype.char), array("q", [0])
        # Tokens that begin with a blank, and the line end, are the first ones of a word.
        self.blank = blank = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]
        self.letters_apart = all([t.id for t in self.tokenizer.model.tokenize(blank + _spelled(w))]
                                 == self.tokenizer.encode(" " + w, add_special_tokens=False).ids for w in _PROBES)
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.blanks, self.line_ends = (np.zeros(self.tokenizer.get_vocab_size(), bool) for _ in range(2))
        for token, i in self.tokenizer.get_vocab().items():
            self.blanks[i] = token.startswith(blank)
            self.line_ends[i] = [i] == line_end

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, self.dtype) for c in coded]

    def _add_letters(self, words: list[str]) -> None:
        """Ids of words of plain letters. A blank and such a word are one piece to the splitter, so the library merges it at once."""
        tokenize, blank = self.tokenizer.model.tokenize, self.blank
        for i in range(0, len(words), 4096):
            pieces = [tokenize(blank + (w if w.isascii() else w.translate(_SPELLED))) for w in words[i:i + 4096]]
            self._add(array(self.dtype.char, [t.id for piece in pieces for t in piece]), list(map(len, pieces)))

    def _add(self, ids: array, sizes: list[int]) -> None:
        ends = np.cumsum(sizes, dtype=np.int64) + len(self.ids)
        self.ids.extend(ids)
        self.ends.frombytes(ends.tobytes())

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words as they stand in a text; many are encoded as one text and told apart by their first tokens.

        A word is spelled with the blank before it; one that begins with a line end or two tabs has none.
        """
        out: dict[str, bytes] = {}
        plain, lines, odd = [], [], []
        for w in words:
            if w and not w[0].isspace() and not w[-1].isspace():
                plain.append(w)
            elif w[:1] == "\n" and len(w) > 1 and not w[-1].isspace():
                lines.append(w)
            else:
                odd.append(w)
        for w, ids in zip(odd, self._encode([w[2:] if w[:2] == "\t\t" else w if w[:1] == "\n" else " " + w for w in odd])):
            out[w] = ids.tobytes()
        out.update(self._encode_joined(plain, " ", self.blanks))
        out.update(self._encode_joined(lines, "", self.line_ends))
        return [out[w] for w in words]

    def _encode_joined(self, words: list[str], before: str, begins: np.ndarray) -> Iterator[tuple[str, bytes]]:
        """Words with ``before`` in front of them, in texts of a thousand; ``begins`` marks the tokens they start with."""
        size = self.dtype.itemsize
        for i in range(0, len(words), 20_000):
            groups = [words[j:j + 1000] for j in range(i, min(i + 20_000, len(words)), 1000)]
            for group, ids in zip(groups, self._encode([before + before.join(g) for g in groups])):
                starts = np.flatnonzero(begins[ids])
                if len(starts) == len(group):
                    data, cuts = ids.tobytes(), (starts * size).tolist()
                    cuts.append(len(data))
                    yield from zip(group, [data[a:b] for a, b in zip(cuts, cuts[1:])])
                else:  # a word with white space of its own
                    yield from zip(group, [x.tobytes() for x in self._encode([before + w for w in group])])

    def _turn(self) -> None:
        """Start a generation of words; the last one is kept, so that words in use stay."""
        if len(self.words) > _CACHED_WORDS or self.bytes > _CACHED_BYTES:
            kept = np.fromiter(self.words.values(), np.int64, len(self.words))
            ids, sizes = self._gathered(kept)
            self.before, self.words, self.bytes = dict(zip(self.words, range(len(kept)))), {}, 0
            self.ids, self.ends = array(self.dtype.char), array("q", [0])
            self.ids.frombytes(ids.tobytes())
            self.ends.frombytes(np.cumsum(sizes, dtype=np.int64).tobytes())

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of looked-up words one after the other, and the number of each word's."""
        ends = np.frombuffer(self.ends, np.int64)
        starts, sizes = ends[numbers], ends[numbers + 1] - ends[numbers]
        return _runs(np.frombuffer(self.ids, self.dtype), starts, sizes), sizes

    def _numbers(self, names: pa.Array) -> np.ndarray:
        """Numbers of distinct words; those not seen lately are encoded."""
        self._turn()
        words = names.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        lost = np.flatnonzero(at < 0)
        at[lost] = np.fromiter(map(self.before.get, map(words.__getitem__, lost.tolist()), repeat(-1)), np.int64, len(lost))
        fresh = np.flatnonzero(at < 0)
        letters = pc.match_substring_regex(names.take(pa.array(fresh)), _LETTERS_ONLY).to_numpy(zero_copy_only=False) & self.letters_apart
        made = [[words[i] for i in some.tolist()] for some in (fresh[letters], fresh[~letters])]
        before = len(self.ids)
        at[np.concatenate([fresh[letters], fresh[~letters]])] = np.arange(len(fresh)) + len(self.ends) - 1
        self._add_letters(made[0])
        others = self._encode_words(made[1])
        self._add(array(self.dtype.char, b"".join(others)), [len(x) // self.dtype.itemsize for x in others])
        self.words.update(zip(map(words.__getitem__, lost.tolist()), at[lost].tolist()))
        self.bytes += sum(map(len, made[0])) + sum(map(len, made[1])) + (len(self.ids) - before) * self.dtype.itemsize
        return at

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, and the number of each word's."""
        # Between a letter or digit and the punctuation behind it a new piece starts, so both are looked up apart.
        bases = pc.utf8_rtrim(words, characters=_MARKS)
        cut = pc.and_(pc.less(pc.binary_length(bases), pc.binary_length(words)), pc.match_substring_regex(bases, _CUT_END))
        marks = pc.binary_join_element_wise("\t\t", pc.replace_substring_regex(words.filter(cut), _BEFORE_MARKS, ""), "")
        parts = pa.concat_arrays([pc.if_else(cut, bases, words), marks]).dictionary_encode()
        numbers = self._numbers(parts.dictionary)[parts.indices.to_numpy()]
        behind = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        order = np.argsort(np.concatenate([np.arange(len(words)), behind]), kind="stable")  # each word, then its punctuation
        ids, sizes = self._gathered(numbers[order])
        both = np.zeros(len(numbers), np.int64)
        both[order] = sizes
        size = both[:len(words)]
        size[behind] += both[len(words):]
        return ids, size

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text with the end id behind them; NULL counts as empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole)
        parted = pc.invert(whole)
        out = np.empty(len(texts), object)
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for i, ids in zip(odd.tolist(), self._encode(texts.take(pa.array(odd)).to_pylist())):
            out[i] = ids.tobytes() + self.end
        # No word of the other texts begins with two tabs.
        body = pc.binary_join_element_wise("\t\t", pc.replace_substring(texts.filter(parted), "\n", " \n"), "")
        split = pc.split_pattern(body, " ")
        coded = split.flatten().dictionary_encode()
        data, size = self._looked_up(coded.dictionary)
        at = coded.indices.to_numpy()
        length = size[at]
        stop = np.concatenate([[0], np.cumsum(length)])
        flat = _runs(data, (np.cumsum(size) - size)[at], length)
        bounds = stop[split.offsets.to_numpy()].tolist()
        for i, a, b in zip(np.flatnonzero(parted.to_numpy(zero_copy_only=False)).tolist(), bounds, bounds[1:]):
            out[i] = flat[a:b].tobytes() + self.end
        return out.tolist()


def _runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``data`` that begin at ``starts``, one after the other."""
    stops = np.cumsum(sizes)
    return data[np.repeat(starts - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)]


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, end_id: int | None) -> Encoder:
    """One encoder for each worker process."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _encoded(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the ids of their column ``text``."""
    gc.disable()  # nothing here makes cycles, and the collector would walk the looked-up words again and again
    try:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy())
            begin = 0
            while begin < batch.num_rows:  # rows up to a number of bytes, one at least
                before = int(sizes[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, before + _BATCH_BYTES, side="right")))
                some = batch.slice(begin, end - begin)
                yield some, encoder.encode(some.column("text"))
                begin = end
    finally:
        gc.enable()


def _sampled(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end_id)
        for _, ids in _encoded(batches, encoder):
            yield pa.RecordBatch.from_pydict({"ids": [x[:SAMPLE_IDS * encoder.dtype.itemsize] for x in ids]},
                                             schema=pa.schema([("ids", pa.binary())]))
    return run


def train_dictionary(documents: DataFrame, path: str, end_id: int | None) -> bytes:
    """A dictionary from the documents whose hashed id is smallest, SAMPLE_DOCUMENTS of them; empty if they are too few."""
    hashed = documents.select(F.xxhash64("doc_id").alias("h"), "text")
    limit = hashed.select("h").orderBy("h").limit(SAMPLE_DOCUMENTS).agg(F.max("h")).first()[0]
    if limit is None:
        return b""
    sample = hashed.where(F.col("h") <= limit).select("text").mapInArrow(_sampled(path, end_id), "ids binary")
    ids = [bytes(r["ids"]) for r in sample.limit(SAMPLE_DOCUMENTS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _compressed(path: str, end_id: int | None, dictionary: bytes, bounds: list[int]):
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("frame", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end_id)
        pack = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_content_size=True)
        for batch, ids in _encoded(batches, encoder):
            names = batch.column("doc_id").to_pylist()
            part = [0 if n is None else int(np.searchsorted(bounds, n, side="right")) for n in names]
            yield pa.RecordBatch.from_pydict({
                "part": part, "doc_id": names, "n_ids": [len(x) // encoder.dtype.itemsize for x in ids],
                "frame": [pack.compress(x) for x in ids]}, schema=schema)
    return run


_PARTS_SQL = "part int, path string, documents bigint, ids bigint, bytes bigint"


def _written(folder: str, dictionary: bytes, width: int):
    digest = hashlib.sha256(dictionary).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        part = batch.column("part")[0].as_py()
        path = f"{folder}/part-{part:06d}.tok"
        names, present, sizes, counts = [], [], [_HEAD_BYTES], []

        def write(stream) -> None:
            nonlocal batch
            stream.write(struct.pack(_HEAD, MAGIC, digest, width))
            while batch is not None:
                for name, n, frame in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "frame")]):
                    stream.write(frame)
                    names.append(name or 0)
                    present.append(name is not None)
                    sizes.append(len(frame))
                    counts.append(n)
                batch = next(batches, None)
            offsets = np.cumsum(sizes, dtype="<u8")
            stream.write(np.array(names, "<i8").tobytes() + np.array(present, "u1").tobytes() + offsets.tobytes()
                         + np.array(counts, "<u8").tobytes())
            stream.write(struct.pack(_TAIL, len(names), int(offsets[-1]), MAGIC))

        files.write_file(path, write)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "path": [path], "documents": [len(names)], "ids": [sum(counts)],
            "bytes": [sum(sizes)]})
    return run


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int | None = 0, text: str = "text",
          id_column: str = "doc_id") -> DataFrame:
    """Write the token files of all documents into ``folder``; the table of parts, with ``start``, the ids before each.

    NULL texts count as empty, and every document ends with ``end_id``. Documents without an id come first, and equal
    ids are ordered by the number of ids and the compressed bytes. The tokenizer is a file every worker can read.
    """
    spark = df.sparkSession
    documents = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dictionary = train_dictionary(documents, tokenizer, end_id)
    files.write_file(f"{folder}/dictionary", lambda stream: stream.write(dictionary))
    parts = shared.partitions_for(df, _PART_BYTES)
    bounds = documents.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    frames = documents.mapInArrow(_compressed(tokenizer, end_id, dictionary, list(bounds or [])),
                                  "part int, doc_id bigint, n_ids bigint, frame binary")
    ordered = frames.repartitionById(parts, F.col("part")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "n_ids", "frame")
    width = _encoder(tokenizer, end_id).dtype.itemsize
    written = shared.stored(ordered.mapInArrow(_written(folder, dictionary, width), _PARTS_SQL), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return written.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


class Part:
    """A part file open for reading."""

    def __init__(self, file, dictionary: bytes):
        size = file.size()
        magic, digest, width = struct.unpack(_HEAD, file.read_at(_HEAD_BYTES, 0))
        n, at, tail = struct.unpack(_TAIL, file.read_at(_TAIL_BYTES, size - _TAIL_BYTES))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the token file was written with another dictionary")
        index = file.read_at(size - _TAIL_BYTES - at, at)
        self.file, self.dtype = file, np.dtype(f"<u{width}")
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.present = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 9 * n).astype(np.int64)
        self.counts = np.frombuffer(index, "<u8", n, 17 * n + 8).astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def document(self, number: int) -> np.ndarray:
        """The ids of one document, read from its place in the file."""
        begin, end = self.offsets[number:number + 2]
        return np.frombuffer(self.unpack.decompress(self.file.read_at(end - begin, begin)), self.dtype)

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document by its id."""
        first = int(np.count_nonzero(~self.present))
        at = first + int(np.searchsorted(self.doc_ids[first:], doc_id))
        return self.document(at) if at < len(self.doc_ids) and self.doc_ids[at] == doc_id else None

    def blocks(self, most: int = 4 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
        """First number and ids of runs of documents, each run read at once."""
        begin, n = 0, len(self.counts)
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(self.offsets, self.offsets[begin] + most, side="right")) - 1)
            base = self.offsets[begin]
            data = self.file.read_at(int(self.offsets[end] - base), int(base))
            cuts = (self.offsets[begin:end + 1] - base).tolist()
            yield begin, [np.frombuffer(self.unpack.decompress(data[i:j]), self.dtype) for i, j in zip(cuts, cuts[1:])]
            begin = end


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _read(folder: str, output, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                if dictionary is None:
                    with files.reading(f"{folder}/dictionary") as f:
                        dictionary = f.read()
                with files.reading(path) as f:
                    part = Part(f, dictionary)
                    starts = start + np.concatenate([[0], np.cumsum(part.counts)]).astype(np.int64)
                    for first, ids in part.blocks():
                        some = slice(first, first + len(ids))
                        yield pa.RecordBatch.from_arrays([
                            pa.array(part.doc_ids[some], mask=~part.present[some]), pa.array(starts[some]),
                            pa.array([len(x) for x in ids], pa.int64()), output(ids)], schema=schema)
    return run


def _as_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))


def _as_checksums(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())


def read(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents in the files that a table of parts lists."""
    return _by_part(parts).mapInArrow(_read(folder, _as_lists, _READ), "doc_id bigint, start bigint, n_tokens bigint, ids array<int>")


def checksums(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): as ``read``, with the CRC-32 of the ids as 32-bit integers instead of them."""
    schema = pa.schema([*list(_READ)[:3], ("ids_crc32", pa.int64())])
    return _by_part(parts).mapInArrow(_read(folder, _as_checksums, schema), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _by_part(parts: DataFrame) -> DataFrame:
    """One part in each task."""
    n = parts.agg(F.max("part")).first()[0]
    return parts.repartitionById((n or 0) + 1, F.col("part"))
