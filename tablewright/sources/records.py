"""Records that run over line ends, put together from lines that many tasks read.

Spark cuts files into blocks at lines. Whether a block begins inside a record is unknown to its task, so each block reports
how it ends for every way it can begin: a quoted field of a delimited file open or not, a JSON string open or not and how
much deeper the brackets are. Chained in order of the blocks these reports tell how each block begins, and a second pass
cuts every block into its records. The pieces of records that cross blocks are joined by the block they begin in.

One report for each block comes to the driver, some hundred bytes for each 128 MB of a file.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

_BLOCK_SQL = "file string, start bigint"
_PIECES_SQL = "file string, owner bigint, start bigint, whole boolean, value string"
_PIECES = pa.schema([("file", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("whole", pa.bool_()), ("value", pa.string())])
_PIECE_BATCH = 4096


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the bytes of each line without its line feed, and the block of the file it lies in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, block, lines) of parts of single blocks, in order."""
    for batch in batches:
        begin = 0
        if not batch.num_rows:
            continue
        files, starts = batch.column(1).dictionary_encode(), batch.column(2).to_pylist()
        names = files.indices.to_pylist()
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or starts[i] != starts[begin] or names[i] != names[begin]:
                yield files.dictionary[names[begin]].as_py(), starts[begin], batch.column(0).slice(begin, i - begin)
                begin = i


# ---------------------------------------------------------------- delimited text


def open_after(line: bytes, is_open: bool, sep: bytes) -> bool:
    """Whether a quoted field is open at the end of a line; a quote opens a field only as its first character."""
    at, end = 0, len(line)
    while True:
        if is_open:
            at = line.find(b'"', at)
            while at >= 0 and line[at + 1:at + 2] == b'"':  # a doubled quote stands for one
                at = line.find(b'"', at + 2)
            if at < 0:
                return True
            at, is_open = line.find(sep, at + 1), False
            if at < 0:
                return False
            at += len(sep)
        elif line[at:at + 1] == b'"':
            at, is_open = at + 1, True
        else:
            at = line.find(sep, at, end)
            if at < 0:
                return False
            at += len(sep)


def _delimited_report(sep: bytes) -> Callable:
    """How a block ends if it begins closed and if it begins open, whether some line of it begins closed even if it begins
    open, and whether a line of it ends open if it begins closed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reports: dict[tuple[str, int], list[bool]] = {}
        for file, start, lines in _blocks(batches):
            held = reports.setdefault((file, start), [False, True, False, False])
            for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                held[0], held[1] = open_after(line, held[0], sep), open_after(line, held[1], sep)
                held[2] |= not held[1]
                held[3] |= held[0]
        for (file, start), held in reports.items():
            yield pa.RecordBatch.from_pydict({"file": [file], "start": pa.array([start], pa.int64()), "ends": [held]})
    return run


def open_blocks(lines: DataFrame, sep: str) -> tuple[dict[tuple[str, int], int], bool]:
    """Blocks that begin inside a quoted field, (file, start) -> the block that the record begins in; and whether any record
    runs over a line end."""
    rows = lines.mapInArrow(_delimited_report(sep.encode()), f"{_BLOCK_SQL}, ends array<boolean>").collect()
    owners, file, is_open, owner, over = {}, None, False, 0, False
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            file, is_open = r["file"], False
        closed, opened, begins, runs_over = r["ends"]
        over |= is_open or runs_over
        if is_open:
            owners[file, r["start"]] = owner
        if not is_open or begins:
            owner = r["start"]
        is_open = opened if is_open else closed
    return owners, over


def _delimited_pieces(sep: bytes, encoding: str, owners: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, owner, is_open, heading, out = None, [], 0, False, False, []

        def end(whole: bool) -> None:
            nonlocal held, heading
            text = b"\n".join(held)
            if whole:
                text = text.removesuffix(b"\r")
            head = heading and text.strip() != b""
            out.append((key[0], -1 if head else owner, key[1], whole, text.decode(encoding)))
            heading &= not head
            held = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECES.types)], schema=_PIECES)
            out.clear()
            return made

        for file, start, lines in _blocks(batches):
            if (file, start) != key:
                if held:
                    end(False)
                key, owner = (file, start), owners.get((file, start), start)
                is_open, heading = (file, start) in owners, start == 0
            quoted = pc.match_substring(lines, '"').to_pylist()
            for line, quotes in zip(lines.to_pylist(), quoted):
                held.append(line)
                if quotes:
                    is_open = open_after(line, is_open, sep)
                if not is_open:
                    end(owner == start)
                    owner = start
                if len(out) >= _PIECE_BATCH:
                    yield batch()
        if held:
            end(False)
        if out:
            yield batch()
    return run


def _joined(pieces: DataFrame) -> DataFrame:
    """(file, owner, value): whole records as they are, pieces of others joined in order of their blocks."""
    parts = pieces.where("not whole").groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("start", "value"))).alias("parts"))
    text = F.regexp_replace(F.array_join("parts.value", "\n"), r"\r$", "")
    return pieces.where("whole").select("file", "owner", "value").union(parts.select("file", "owner", text.alias("value")))


def delimited_records(lines: DataFrame, sep: str, encoding: str, owners: dict) -> DataFrame:
    """(file, owner, value): one row a record, the text of all its lines; ``owner`` is the block that it begins in, -1 for the
    first record of a file that is not blank.

    Of the pieces of a block only its last record, if it is not ended, and the end of an earlier one are not whole.
    """
    pieces = lines.mapInArrow(_delimited_pieces(sep.encode(), encoding, owners), _PIECES_SQL)
    return _joined(pieces)


# ---------------------------------------------------------------- JSON documents

_JSON_MARK = re.compile(rb'["\\[\]{},]')


def _walk(line: bytes, in_string: bool) -> Iterator[tuple[int, bytes, bool]]:
    """(place, mark, whether inside a string behind it) of a line's brackets, commas and string ends."""
    at, escaped = 0, -1
    while m := _JSON_MARK.search(line, at):
        at, mark = m.end(), m[0]
        if mark == b"\\":
            at += in_string
        elif mark == b'"':
            in_string = not in_string
            yield m.start(), mark, in_string
        elif not in_string:
            yield m.start(), mark, False


_DEEPER = {b"[": 1, b"{": 1, b"]": -1, b"}": -1}


def _json_report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For a block that begins outside and inside a string: whether it ends inside one, and how much deeper it ends."""
    reports: dict[tuple[str, int], list] = {}
    for file, start, lines in _blocks(batches):
        held = reports.setdefault((file, start), [[False, 0], [True, 0]])
        for line in lines.to_pylist():
            for state in held:
                for _, mark, inside in _walk(line, state[0]):
                    state[0] = inside
                    state[1] += _DEEPER.get(mark, 0)
    for (file, start), ((a, up), (b, up_inside)) in reports.items():
        yield pa.RecordBatch.from_pydict({
            "file": [file], "start": pa.array([start], pa.int64()), "inside": [[a, b]], "deeper": pa.array([[up, up_inside]], pa.list_(pa.int64()))})


def json_states(lines: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """How each block begins: inside a string or not, and how deep. A file that does not end as it began is no document."""
    rows = lines.mapInArrow(_json_report, f"{_BLOCK_SQL}, inside array<boolean>, deeper array<bigint>").collect()
    out, file, state = {}, None, (False, 0)
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            if state != (False, 0):
                raise ValueError(f"{file} ends inside a JSON value")
            file = r["file"]
        out[file, r["start"]] = state
        state = (r["inside"][state[0]], state[1] + r["deeper"][state[0]])
    if state != (False, 0):
        raise ValueError(f"{file} ends inside a JSON value")
    return out


def _json_pieces(states: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, held, cut = None, [], [], False
        inside, depth = False, 0

        def end(whole: bool) -> None:
            text = b" ".join(held).removeprefix(b"\xef\xbb\xbf").strip()
            if text or not whole:
                out.append((key[0], int(cut), key[1], whole, text.decode()))
            held.clear()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECES.types)], schema=_PIECES)
            out.clear()
            return made

        for file, start, lines in _blocks(batches):
            if (file, start) != key:
                if key is not None:
                    end(False)
                key, cut = (file, start), False
                inside, depth = states[key]
            for line in lines.to_pylist():
                begin = 0
                for at, mark, inside in _walk(line, inside):
                    depth += _DEEPER.get(mark, 0)
                    if depth < 0 or (mark == b"{" and depth == 1):
                        raise ValueError(f"{file} is not one JSON array")
                    # The outer brackets and the commas between elements are no part of an element.
                    if (mark == b"[" and depth == 1) or (mark == b"]" and depth == 0) or (mark == b"," and depth == 1):
                        held.append(line[begin:at])
                        end(cut)
                        cut, begin = True, at + 1
                held.append(line[begin:])
                if len(out) >= _PIECE_BATCH:
                    yield batch()
        if key is not None:
            end(False)
        if out:
            yield batch()
    return run


def json_elements(lines: DataFrame, states: dict) -> DataFrame:
    """(value): the elements of the one top-level array of each file, each as one line of text.

    A block gives the end of an element that began earlier, whole elements, and the beginning of one that it does not end.
    Beginnings, numbered in order of the blocks, name the elements that the other pieces go with.
    """
    pieces = lines.mapInArrow(_json_pieces(states), _PIECES_SQL)
    order = Window.partitionBy("file").orderBy("start", "owner")  # two rows a block at most
    parts = pieces.where("not whole").withColumn("element", F.sum("owner").over(order)).groupBy("file", "element").agg(
        F.sort_array(F.collect_list(F.struct("start", "owner", "value"))).alias("parts"))
    text = F.trim(F.array_join("parts.value", " "))
    return pieces.where("whole").select("value").union(parts.select(text.alias("value")).where("value <> ''"))
