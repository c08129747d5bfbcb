"""WARC archives with a two-level capture index.

Writing: every page becomes a record of its own gzip member, so that it can be read alone. Of pages with equal payloads
the one with the largest id is stored as a response, the others as revisits that refer to it; only digests are grouped,
and each page then finds its response by its digest.

Index: captures are sorted by key, the URL with its host reversed, so that pages of a site are neighbours. A range of
keys is one file of compressed blocks of lines with a sparse directory behind them, the first key of each block. A
lookup sends each key to the ranges that can hold it, finds its blocks by binary search in the directory, reads only
those, and finds the lines by binary search again. Captures are then read from the archives by place, neighbours at once.
"""
from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import files, shared

BLOCK_LINES = 512
_INDEX_PARTS_MOST = 4096  # the bounds of so many index files are known to every task at most
_LINES_PER_PART, _READ_BYTES = 1 << 20, 4 << 20
_DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
_ID = "<urn:x-page:{}>"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels from the top down, then path and query; no scheme, port or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
    except ValueError:
        return url
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + query


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> tuple[bytes, str]:
    """A record as a gzip member, and the base32 SHA-1 of its payload; ``refers_to`` makes it a revisit."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {_DATE}",
            f"WARC-Record-ID: {_ID.format('none' if page_id is None else page_id)}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(body)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_ID.format(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    pack = zlib.compressobj(level, wbits=31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush(), digest


def parse(member: bytes) -> dict:
    """A record read back; a response's digest and size are those of the bytes it holds."""
    data = zlib.decompress(member, wbits=31)
    head, body = data.split(b"\r\n\r\n", 1)
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    body = body[:int(fields["Content-Length"])]
    http, payload = body.split(b"\r\n\r\n", 1)
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != told:
            raise ValueError("the payload is not the one that was written")

    def page(name: str) -> int | None:
        value = fields.get(name, "<urn:x-page:none>")[len("<urn:x-page:"):-1]
        return None if value == "none" else int(value)

    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": told, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"),
            "payload": payload if fields["WARC-Type"] == "response" else None}


_CAPTURES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("archive", pa.string()),
                       ("offset", pa.int64()), ("length", pa.int64())])
_CAPTURES_SQL = "key string, page_id bigint, digest string, archive string, offset bigint, length bigint"


def _archived(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows may arrive in another order when a task runs again, so every attempt has an archive of its own; the captures
        # of the attempt that counts name it.
        task = TaskContext.get()
        path = f"{folder}/archive-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        rows: list[tuple] = []

        def write(stream) -> None:
            offset = 0
            for batch in batches:
                for start in range(0, batch.num_rows, 200):
                    some = batch.slice(start, 200)
                    for page_id, url, html, owner in zip(*[c.to_pylist() for c in some.columns]):
                        revisit = owner if owner is not None and owner != page_id else None
                        member, digest = record(page_id, url, (html or "").encode(), revisit, level)
                        stream.write(member)
                        rows.append((url_key(url), page_id, digest, path, offset, len(member)))
                        offset += len(member)

        files.write_file(path, write)
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 10_000]), _CAPTURES.types)], schema=_CAPTURES)
    return run


def archive(df: DataFrame, folder: str, html: str = "html", url: str = "url", id_column: str = "page_id",
            least_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write the pages' archives into ``folder``; the table of captures.

    A NULL html is an empty payload. Payloads of fewer than ``least_bytes`` are always responses. Rows that share the
    largest id of a payload are all responses; a row without an id revisits, unless no row of its payload has one.
    """
    pages = df.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digests = pages.withColumn("digest", F.sha1(body))
    if least_bytes > 0:
        digests = digests.withColumn("digest", F.when(F.length(body) >= least_bytes, F.col("digest")))
    owners = shared.stored(digests.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("owner")), "page-owners")
    owned = digests.join(owners.hint("shuffle_hash"), "digest", "left").select("page_id", "url", "html", "owner")
    return shared.stored(owned.mapInArrow(_archived(folder, level), _CAPTURES_SQL), "captures")


_PARTS_SQL = "part int, path string, first string, last string, lines bigint"


def _indexed(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        path, lines, directory, state = f"{folder}/index-{part:06d}-{task.taskAttemptId()}.cdx", [], [], {"first": None, "last": None, "n": 0}

        def write(stream) -> None:
            place = 0

            def block() -> None:
                nonlocal place
                data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
                stream.write(data)
                directory.append((lines[0][0], place, len(data)))
                place += len(data)
                lines.clear()

            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns]):
                    lines.append(row)
                    state["first"] = row[0] if state["first"] is None else state["first"]
                    state["last"], state["n"] = row[0], state["n"] + 1
                    if len(lines) == BLOCK_LINES:
                        block()
            if lines:
                block()
            tail = zlib.compress(json.dumps(directory).encode())
            stream.write(tail + len(tail).to_bytes(8, "little"))

        files.write_file(path, write)
        if state["n"]:
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": [path], "first": [state["first"]], "last": [state["last"]],
                "lines": [state["n"]]})
    return run


def index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index files of a table of captures into ``folder``; the table of these files."""
    lines = captures.count()
    parts = max(1, min(_INDEX_PARTS_MOST, max(lines // _LINES_PER_PART, min(
        int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines // BLOCK_LINES))))
    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id", "archive", "offset")
    return shared.stored(ordered.mapInArrow(_indexed(folder), _PARTS_SQL), "index-parts")


class IndexFile:
    """An index file open for lookups."""

    def __init__(self, file):
        size = file.size()
        n = int.from_bytes(file.read_at(8, size - 8), "little")
        self.file, self.directory = file, json.loads(zlib.decompress(file.read_at(n, size - 8 - n)))
        self.firsts = [x[0] for x in self.directory]
        self.at, self.lines, self.keys = -1, [], []

    def _open(self, block: int) -> None:
        if block != self.at:
            _, place, n = self.directory[block]
            self.lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(n, place)).split(b"\n")]
            self.at, self.keys = block, [x[0] for x in self.lines]

    def find(self, key: str) -> Iterator[list]:
        """All captures of a key."""
        block = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while block < len(self.firsts) and self.firsts[block] <= key:
            self._open(block)
            yield from self.lines[bisect.bisect_left(self.keys, key):bisect.bisect_right(self.keys, key)]
            block += 1


def _sent(bounds: list[tuple[int, str, str]]):
    """Keys -> (part, key) for every index file whose range covers the key."""
    bounds = sorted(bounds, key=lambda b: (b[1], b[2]))
    firsts, lasts = [b[1] for b in bounds], [b[2] for b in bounds]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(bounds[i][0], k) for k in f["key"] for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pd.DataFrame(rows, columns=["part", "key"]).astype({"part": "int32"})
    return run


def _found(paths: dict[int, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, list[str]] = {}
        for batch in batches:
            for part, key in zip(*[c.to_pylist() for c in batch.columns]):
                keys.setdefault(part, []).append(key)
        for part, wanted in keys.items():
            with files.reading(paths[part]) as file:
                opened, rows = IndexFile(file), []
                for key in sorted(wanted):
                    rows.extend(opened.find(key))
                    if len(rows) >= 10_000:
                        yield _captures(rows)
                        rows = []
                if rows:
                    yield _captures(rows)
    return run


def _captures(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CAPTURES.types)], schema=_CAPTURES)


def lookup(urls: DataFrame, parts: DataFrame, url: str = "url") -> DataFrame:
    """The captures of the distinct keys of a table of URLs; URLs without captures give no row."""
    listed = parts.collect()  # _INDEX_PARTS_MOST rows at most
    bounds = [(r["part"], r["first"], r["last"]) for r in listed]
    keys = urls.select(F.col(url).alias("url")).mapInPandas(_keys, "key string").distinct()
    sent = keys.mapInPandas(_sent(bounds), "part int, key string")
    n = max([r["part"] for r in listed], default=0) + 1
    return sent.repartitionById(n, F.col("part")).mapInArrow(_found({r["part"]: r["path"] for r in listed}), _CAPTURES_SQL)


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"key": [url_key(u) for u in f["url"]]})


_RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                      ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_RECORDS_SQL = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
                "refers_to bigint, payload binary")


def _fetched(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas().sort_values(["archive", "offset"])
            for path, places in frame.groupby("archive", sort=False):
                offsets, ends = places["offset"].to_numpy(), (places["offset"] + places["length"]).to_numpy()
                with files.reading(path) as file:
                    i = 0
                    while i < len(offsets):
                        j = max(i + 1, int(np.searchsorted(ends, offsets[i] + _READ_BYTES, side="right")))
                        data, base = file.read_at(int(ends[j - 1] - offsets[i]), int(offsets[i])), offsets[i]
                        rows = [parse(data[a - base:b - base]) for a, b in zip(offsets[i:j], ends[i:j])]
                        if not with_payload:
                            rows = [r | {"payload": None} for r in rows]
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
                        i = j
    return run


def fetch(captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of captures, read from their archives by place; payloads of responses only if asked for."""
    near = F.floor(F.col("offset") / F.lit(_READ_BYTES))
    dealt = captures.select("archive", "offset", "length").repartition(
        int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), "archive", near)
    return dealt.mapInArrow(_fetched(with_payload), _RECORDS_SQL)
