"""Helpers the corpus operators share: words, hashes and tables written to the shared folder."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.skew import plan_bytes
from ..session import scratch_path

# The separators of every word definition here: blank, tab, line feed, vertical tab, form feed, return.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas inside use it."""
    return F.transform(F.array(value), body)[0]


def stored_path(df: DataFrame, name: str, by: str | None = None) -> str:
    """Where in the shared folder the table has been written, in a folder for each value of the column ``by``."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    return path


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends here and a lost executor costs nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_path(df, name, by))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    """The Arrow schema of the batches that functions over Arrow data exchange with Spark."""
    return to_arrow_schema(schema)


_UNKNOWN_BYTES = 1 << 56  # tables that no statistics exist for are estimated near the largest number


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """Partitions so that each holds about ``bytes_each`` of the table's stored size, the session's number at least."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return least if size >= _UNKNOWN_BYTES else max(least, -(-size // bytes_each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
