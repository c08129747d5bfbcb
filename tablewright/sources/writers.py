"""Saving tables as folders of part files."""
from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame

from .readers import charset_option, resolve_suffix

# Save formats by suffix, and the suffix each format is saved under.
SAVE_FORMATS = {
    ".csv": "csv_utf8_sig", ".csv.gz": "csv_utf8_sig", ".tsv": "tsv", ".tsv.gz": "tsv",
    ".parquet": "parquet", ".parquet.gz": "parquet",
    ".json": "json", ".jsonl": "json", ".ndjson": "json", ".json.gz": "json",
}
SAVE_SUFFIXES = {
    "csv_utf8_sig": ".csv", "csv_utf8": ".csv", "csv_cp949": ".csv", "tsv": ".tsv",
    "parquet": ".parquet", "json": ".json",
}


def guess_save_format(path: str) -> str:
    return SAVE_FORMATS.get(resolve_suffix(path), "csv_utf8_sig")


def with_extension(path: str, save_format: str) -> str:
    """The path with the suffix that belongs to the format."""
    wanted = SAVE_SUFFIXES.get(save_format, ".csv")
    p = PurePosixPath(str(path))
    return str(p) if p.suffix.lower() == wanted else str(p.with_suffix(wanted))


def save_table(df: DataFrame, path: str, save_format: str | None = None, *, mode: str = "overwrite") -> str:
    """Write in one of the save formats and return the path used.

    Part files are written in parallel, so no byte-order mark is emitted and JSON is one record per line.
    """
    kind = save_format or guess_save_format(path)
    if kind not in SAVE_SUFFIXES:
        raise ValueError(f"unsupported save format: {kind}")
    target = with_extension(path, kind)
    writer = df.write.mode(mode)
    if kind == "parquet":
        writer.parquet(target)
    elif kind == "json":
        writer.option("ignoreNullFields", False).json(target)
    else:
        sep = "\t" if kind == "tsv" else ","
        charset = charset_option(df.sparkSession, "cp949" if kind == "csv_cp949" else "utf-8")
        writer.option("header", True).option("sep", sep).option("encoding", charset).option("escape", '"').csv(target)
    return target
