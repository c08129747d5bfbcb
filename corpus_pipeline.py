"""A training corpus from raw documents: filter, drop shared lines, drop near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its result is written as Parquet in
the shared folder and read back before the next one.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import jaccard, lines, mixing, pieces, quality, shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the number of characters that a text has now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    return quality.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go, in all of them; a document may end up empty."""
    return _measured(lines.drop_frequent_lines(docs.select(*COLUMNS)))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target shares of words: rows repeat where a source is taken more than once."""
    return _measured(mixing.mix(docs.select(*COLUMNS)))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every row of the mix."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encode(docs.select(*COLUMNS), model).drop("text").withColumn("n_pieces", F.size("piece_ids"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", sentencepiece),
]

# The pieces of a text are beyond SQL; tests hold the pipeline against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
