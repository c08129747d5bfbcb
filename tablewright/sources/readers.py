"""Loading tables: suffix dispatch, delimiters, encodings and format probes on top of Spark's readers."""
from __future__ import annotations

import csv
import io
import json
import re
import zlib
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.missing import nan_to_null
from ..functions.naming import dedupe_names
from ..pages.elements import page_tables
from ..session import scratch_path
from . import records

# Suffixes of two parts, tried before the last part alone.
COMPOUND_SUFFIXES = (".csv.gz", ".tsv.gz", ".txt.gz", ".json.gz", ".parquet.gz")
# Delimiter of each delimited-text suffix.
DELIMITED = {
    ".csv": ",", ".csv.gz": ",", ".tsv": "\t", ".tsv.gz": "\t", ".txt": ",", ".txt.gz": ",",
    ".dat": ",", ".log": ",", ".psv": "|",
}
DOCUMENTS = {
    ".json": "json", ".json.gz": "json", ".jsonl": "jsonl", ".ndjson": "jsonl",
    ".parquet": "parquet", ".parquet.gz": "parquet", ".xml": "xml", ".html": "html", ".htm": "html",
}
# Text encodings tried in order, and delimiters tried in order.
ENCODINGS = ("utf-8", "cp949", "euc-kr")
DELIMITERS = (",", "\t", ";", "|")
# The JVM's names of the Korean code pages.
_CHARSETS = {"utf-8": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR"}
_HEAD = 1 << 16


def resolve_suffix(path: str) -> str:
    name = PurePosixPath(str(path)).name.lower()
    for suffix in COMPOUND_SUFFIXES:
        if name.endswith(suffix):
            return suffix
    return PurePosixPath(name).suffix


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of the first file under a path, read through Hadoop's file system without a Spark job."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(root) or []:
        if status.isFile():
            found.append(status)
            continue
        found += [s for s in fs.listStatus(status.getPath()) if s.isFile() and s.getPath().getName()[0] not in "_."]
    files = [s for s in found if s.getLen() > 0]
    if not files:
        return b""
    first = min(files, key=lambda s: s.getPath().toString())
    stream = fs.open(first.getPath())
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(first.getLen(), _HEAD)))
    finally:
        stream.close()


def charset_option(spark: SparkSession, encoding: str) -> str:
    """The charset name for Spark's text formats; beyond UTF they need the session's Java-charset switch."""
    name = _CHARSETS.get(encoding.lower(), encoding)
    if not name.upper().startswith("UTF"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return name


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: for each known encoding whether it reads every line."""
    fits = dict.fromkeys(ENCODINGS, True)
    for batch in batches:
        text = b"\n".join(v or b"" for v in batch.column(0).to_pylist())  # no character of these encodings holds a line feed
        for name in [n for n, ok in fits.items() if ok]:
            try:
                text.decode(name)
            except UnicodeDecodeError:
                fits[name] = False
    yield pa.RecordBatch.from_pydict({n.replace("-", "_"): [ok] for n, ok in fits.items()})


def _probe(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The encoding of all lines of all files, and whether any line holds a quote; one pass, in the JVM where UTF-8 fits."""
    value = F.col("value")
    facts = spark.read.text(path).agg(
        F.coalesce(F.bool_and(F.is_valid_utf8(value)), F.lit(True)).alias("utf_8"),
        F.coalesce(F.bool_or(F.contains(value.cast("binary"), F.lit(b'"'))), F.lit(False)).alias("quotes")).first()
    if facts["utf_8"]:
        return "utf-8", facts["quotes"]
    columns = [n.replace("-", "_") for n in ENCODINGS]
    lines = spark.read.text(path).select(value.cast("binary"))
    fits = lines.mapInArrow(_readable, ", ".join(f"{c} boolean" for c in columns)).agg(
        *[F.coalesce(F.bool_and(c), F.lit(True)).alias(c) for c in columns]).first()
    for name, column in zip(ENCODINGS, columns):
        if fits[column]:
            return name, facts["quotes"]
    raise ValueError(f"none of the known encodings reads {path}")


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that reads every line of every file; an error if none does."""
    return _probe(spark, path)[0]


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The first delimiter that cuts all records into one and the same number (> 1) of fields; those in quotes do not cut.

    Where quotes hold line ends for a delimiter, its records are put together first.
    """
    lines = records.raw_lines(spark, path)
    encoding, quotes = _probe(spark, path)
    for delimiter in DELIMITERS:
        owners = records.open_blocks(lines, delimiter)[0] if quotes else {}
        values = records.delimited_records(lines, delimiter, encoding, owners).select("value") if quotes else spark.read.text(path)
        record = F.regexp_replace("value", '"[^"]*"', "") if quotes else F.col("value")
        n = F.length(record) - F.length(F.replace(record, F.lit(delimiter), F.lit("")))
        low, high = values.where("trim(value) <> ''").agg(F.min(n), F.max(n)).first()
        if low is not None and low == high > 0:
            return delimiter
    return ","


def probe_format(spark: SparkSession, path: str) -> str:
    """Format of a file without a suffix, from its first bytes."""
    head = _head(spark, path)
    start = head.lstrip(b"\xef\xbb\xbf \t\r\n")[:512].lower()
    if head.startswith(b"PAR1"):
        return "parquet"
    if start.startswith((b"{", b"[")):
        return "json"
    if start.startswith(b"<?xml"):
        return "xml"
    if start.startswith(b"<"):
        return "html"
    return "text"


def header_names(names: Sequence[str]) -> list[str]:
    """Names of a header as columns: nameless ones get their place, repeated ones .1, .2 … that no other column has."""
    named = [n if n != "" else f"Unnamed: {i}" for i, n in enumerate(names)]
    out: list[str] = []
    for n in named:
        if n in out:
            k = 1
            while f"{n}.{k}" in out or f"{n}.{k}" in named:
                k += 1
            n = f"{n}.{k}"
        out.append(n)
    return out


def _header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str] | None:
    """The fields of the first record that is not blank; of several files, that of the first by name."""
    head = _head(spark, path)
    full = len(head) == _HEAD
    if head.startswith(b"\x1f\x8b"):
        head = zlib.decompressobj(31).decompress(head)
    text = head.decode(encoding, errors="ignore").removeprefix("\ufeff")
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
    names = next((r for r in reader if any(f.strip() for f in r)), None)
    if names is not None and full and len(text.splitlines()) <= reader.line_num:
        raise ValueError(f"the header of {path} is longer than {_HEAD} bytes")
    return names


# Types of text columns from the narrow to the wide, with the texts that may be of them.
_TYPES = (
    ("int", r"[+-]?\d{1,10}"), ("bigint", r"[+-]?\d{1,19}"), ("double", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?Infinity|NaN|[+-]?Inf"),
    ("date", r"\d{4}-\d\d?-\d\d?"), ("timestamp", r"\d{4}-\d\d?-\d\d?[ T]\d.*"), ("boolean", "(?i)true|false"))


def _typed(df: DataFrame) -> DataFrame:
    """Text columns in the first type that all their values have, found in one pass."""
    tests = [F.bool_and(F.col(f"`{c}`").rlike(f"^(?:{pattern})$") & F.col(f"`{c}`").try_cast(t).isNotNull()).alias(f"{i}_{t}")
             for i, c in enumerate(df.columns) for t, pattern in _TYPES]
    fits = df.agg(*tests).first()
    types = [next((t for t, _ in _TYPES if fits[f"{i}_{t}"]), "string") for i in range(len(df.columns))]
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in zip(df.columns, types)])


_MORE = "__more"


def _even(df: DataFrame, path: str) -> DataFrame:
    """The rows; an error when one of them has more fields than there are columns."""
    told = F.raise_error(F.concat(F.lit(f"a record of {path} has more fields than the header: … "), F.col(_MORE)))
    return df.where(F.when(F.col(_MORE).isNull(), F.lit(True)).otherwise(told.cast("boolean"))).drop(_MORE)


def read_delimited(
    spark: SparkSession, path: str, sep: str = ",", *, encoding: str | None = None, nrows: int | None = None,
    schema: str | None = None,
) -> DataFrame:
    """Header row, inferred types unless ``schema`` is given; an encoding is probed unless given.

    Rows with fewer fields than the header end in NULLs; one with more is an error when it is read. Files with line ends
    inside quotes are cut into records block by block, so they are read by as many tasks as others.
    """
    found, quotes = _probe(spark, path) if encoding is None else (encoding, True)
    charset = charset_option(spark, found)
    names = _header(spark, path, sep, found)
    if names is None:
        return spark.createDataFrame([], schema or T.StructType([]))
    columns = header_names(names)
    stated = T._parse_datatype_string(schema) if schema else None
    lines = records.raw_lines(spark, path)
    owners, over_lines = records.open_blocks(lines, sep) if quotes else ({}, False)
    options = {"sep": sep, "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"}
    if over_lines:
        rows = records.delimited_records(lines, sep, found, owners).where("owner >= 0 and trim(value) <> ''")
        parsed = rows.select(F.from_csv("value", ", ".join(f"`{n}` string" for n in [*range(len(columns)), _MORE]), options).alias("r")).select("r.*")
        df = _even(parsed, path).toDF(*columns)
        df = df.select(*[F.col(f"`{c}`").cast(f.dataType).alias(c) for c, f in zip(columns, stated)]) if stated else _typed(df)
    else:
        reader = spark.read.options(**options).option("header", True).option("encoding", charset)
        kinds = stated or reader.option("inferSchema", True).csv(path).schema
        fields = [T.StructField(str(i), f.dataType) for i, f in enumerate(kinds.fields[:len(columns)])]
        df = _even(reader.option("inferSchema", False).schema(T.StructType([*fields, T.StructField(_MORE, T.StringType())])).csv(path), path).toDF(*columns)
    return df.limit(nrows) if nrows is not None else df


_BAD = "__unreadable"


def read_json(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """JSON lines, or one document per file; a line or a document that cannot be read is an error.

    The elements of a file's top-level array are dealt to tasks, those of several arrays one after the other as of one; any
    other document is read as a whole.
    """
    by_line = spark.read.option("columnNameOfCorruptRecord", _BAD).json(path)
    if _BAD not in by_line.columns:
        return by_line  # lines split over tasks
    if lines:
        raise ValueError(f"{path} has lines that are no JSON values")
    if _head(spark, path).lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"["):
        raw = records.raw_lines(spark, path)
        elements = scratch_path(spark, "json-elements")
        records.json_elements(raw, records.json_states(raw)).write.text(elements)
        out, whole = spark.read.option("columnNameOfCorruptRecord", _BAD).json(elements), True
    else:
        whole = spark.read.text(path, wholetext=True).mapInPandas(_more_than_one, "more boolean").where("more").isEmpty()
        out = spark.read.option("columnNameOfCorruptRecord", _BAD).option("multiLine", True).json(path)
    if _BAD in out.columns or not whole:
        raise ValueError(f"{path} holds neither one JSON value per line nor one per file")
    return out


def _more_than_one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    decoder = json.JSONDecoder()
    for f in frames:
        more = []
        for text in f["value"]:
            body = (text or "").lstrip("\ufeff \t\r\n")
            try:
                more.append(bool(body) and body[decoder.raw_decode(body)[1]:].strip() != "")
            except ValueError:
                more.append(True)
        yield pd.DataFrame({"more": more})


_XML_ENCODING = re.compile(rb"""^\s*<\?xml[^>]*?encoding\s*=\s*["']([\w.-]+)["'][^>]*\?>""")


def _row_tags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The encoding of each file and the local names of the elements below its root, found as the markup streams by."""
    for f in frames:
        for content in f["content"]:
            data = bytes(content).removeprefix(b"\xef\xbb\xbf")
            stated = _XML_ENCODING.match(data)
            encoding = stated[1].decode() if stated else "utf-8"
            parser, depth, tags = ElementTree.XMLPullParser(("start", "end")), 0, set()
            body = io.TextIOWrapper(io.BytesIO(data[stated.end():] if stated else data), encoding=encoding)
            while chunk := body.read(1 << 16):
                parser.feed(chunk)
                for event, element in parser.read_events():
                    if event == "start":
                        if depth == 1:
                            tags.add(element.tag.rpartition("}")[2])
                        depth += 1
                    else:
                        depth -= 1
                        element.clear()
            parser.close()
            yield pd.DataFrame({"tag": sorted(tags), "encoding": encoding}, dtype="string")


def read_xml(spark: SparkSession, path: str, *, row_tag: str | None = None, encoding: str | None = None) -> DataFrame:
    """Elements as rows; without ``row_tag`` those below the root, the columns of different ones united.

    Names are local names: prefixes and namespaces are left out. The encoding is the stated one of the files, which must be
    the same, unless it is given. A tag without any row is an error.
    """
    if row_tag is None or encoding is None:
        files = spark.read.format("binaryFile").load(path).select("content")
        found = files.mapInPandas(_row_tags, "tag string, encoding string").distinct().collect()
        encodings = {r["encoding"].lower() for r in found}
        if encoding is None and len(encodings) > 1:
            raise ValueError(f"files of different encodings in {path}: {', '.join(sorted(encodings))}")
        encoding = encoding or next(iter(encodings), "utf-8")
        tags = sorted({r["tag"] for r in found}) if row_tag is None else [row_tag]
    else:
        tags = [row_tag]
    if not tags:
        raise ValueError(f"no element below the root in {path}")
    reader = spark.read.options(attributePrefix="", ignoreNamespace=True, encoding=charset_option(spark, encoding))
    out = None
    for tag in tags:
        part = reader.option("rowTag", tag).xml(path)
        if not part.columns:
            raise ValueError(f"no row with the tag {tag!r} in {path}")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_html_table(spark: SparkSession, path: str) -> DataFrame:
    """The first table of each page; its first row (of header cells, if any) names the columns.

    The table is as wide as its widest row; columns without a name get their number. A cell stands at every place it spans.
    Several pages are one table if they name their columns alike.
    """
    pages = spark.read.text(path, wholetext=True).select("_metadata.file_path", F.col("value").alias("html"))
    cells = page_tables(pages)
    width = cells.agg(F.max("col_no")).first()[0]
    if width is None:
        raise ValueError(f"no table found in {path}")
    heads = {r["col_no"]: r for r in cells.where("row_no = 0").groupBy("col_no").agg(
        F.min("text").alias("text"), F.max("text").alias("other"), F.max("is_header").alias("is_header")).collect()}
    named = any(r["is_header"] for r in heads.values())
    if named and any(r["text"] != r["other"] for r in heads.values()):
        raise ValueError(f"the pages in {path} name their columns differently")
    names = dedupe_names(heads[i]["text"] if named and i in heads else i for i in range(width + 1))
    body = cells.where("row_no > 0") if named else cells
    wide = body.groupBy("file_path", "row_no").pivot("col_no", list(range(width + 1))).agg(F.first("text"))
    return wide.orderBy("file_path", "row_no").drop("file_path", "row_no").toDF(*names)


def load_table(
    spark: SparkSession, path: str, *, format: str | None = None, nrows: int | None = None, **options
) -> DataFrame:
    """Load by suffix (or a stated format); without a suffix the format is probed.

    ``nrows`` keeps the first rows. NaN becomes NULL.
    """
    path = str(path)
    suffix = resolve_suffix(path)
    kind = format
    if kind is None and suffix in DELIMITED:
        kind, options = "delimited", {"sep": DELIMITED[suffix], **options}
    elif kind is None and suffix in DOCUMENTS:
        kind = DOCUMENTS[suffix]
    elif kind is None and suffix:
        raise ValueError(f"unsupported file type: {suffix}")
    elif kind is None:
        kind = probe_format(spark, path)
    if kind in ("csv", "tsv", "psv"):
        kind, options = "delimited", {"sep": DELIMITED["." + kind], **options}
    if kind == "text":
        kind, options = "delimited", {"sep": sniff_delimiter(spark, path), **options}
    readers = {
        "delimited": read_delimited,
        "json": read_json,
        "jsonl": lambda s, p, **o: read_json(s, p, lines=True, **o),
        "parquet": lambda s, p: s.read.parquet(p),
        "xml": read_xml,
        "html": read_html_table,
    }
    if kind not in readers:
        raise ValueError(f"unsupported format: {kind}")
    df = readers[kind](spark, path, **options)
    if nrows is not None:
        df = df.limit(nrows)
    return nan_to_null(df)
