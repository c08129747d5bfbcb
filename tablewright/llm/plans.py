"""The registered corpus queries, their DuckDB statements where SQL can express them, and the pipeline."""
from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (jaccard, licenses, lines, mixing, neardup, periods, pieces, pseudonyms, quality, tokens, toxicity, warc,
               whitening)
from .shared import let, table, words

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


_LINES_SQL = r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents),
k AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""


@query("op9_line_dedup", _LINES_SQL)
def op9(spark, d):
    kept = lines.drop_frequent_lines(table(spark, d, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_STOP_SQL = ", ".join(f"'{w}'" for w in [*quality.STOP_WORDS, *[w.capitalize() for w in quality.STOP_WORDS]])
_QUALITY_SQL = rf"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
g AS (
    SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, range(8) AS t(o) GROUP BY doc_id),
m AS (
    SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           len(lines) AS n_lines, len(list_filter(words, lambda x: x IN ({_STOP_SQL}))) AS n_stop
    FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars BETWEEN 2 * n_words AND 15 * n_words
           AND n_symbols <= 0.5 * n_words AND n_stop >= 0.02 * n_words AND n_dup_lines <= 0.5 * n_lines AS kept
FROM m"""


@query("op7_quality_rules", _QUALITY_SQL)
def op7(spark, d):
    judged = quality.assess(table(spark, d, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words
    FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reached r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id"""


@query("op2_ngram_jaccard_join", _JACCARD_SQL)
def op2(spark, d):
    return jaccard.join(table(spark, d, "documents"))


_MIX_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key
    FROM documents),
s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
    FROM d GROUP BY source),
-- The rate rises while sources stop at their limit.
f AS (
    SELECT 0 AS step, CAST((SELECT sum(source_size) FROM s) AS BIGINT) AS rest, CAST((SELECT sum(w) FROM s) AS BIGINT) AS per
    UNION
    SELECT step + 1, CAST((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * source_size) FROM s
               WHERE 3 * source_size * per < w * rest), 0) AS BIGINT),
           CAST((SELECT sum(w) FROM s WHERE 3 * source_size * per >= w * rest) AS BIGINT)
    FROM f WHERE step < 100),
g AS (SELECT rest, per FROM f ORDER BY step DESC LIMIT 1),
t AS (
    SELECT source, source_size, CASE WHEN 3 * source_size * per < w * rest THEN CAST(3 * source_size AS DOUBLE)
                                     ELSE CAST(w * rest AS DOUBLE) / per END AS target
    FROM s, g),
p AS (
    SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS epochs,
           CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest,
           sum(size) OVER (PARTITION BY d.source, key) AS at_key,
           sum(size) OVER (PARTITION BY d.source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - at_key >= rest THEN 0
            ELSE (rest - upto + at_key) * size // at_key END AS BIGINT) AS taken
FROM p"""


@query("op4_mix_sources", _MIX_SQL)
def op4(spark, d):
    return mixing.shares(table(spark, d, "documents"))


@query("op10_sentencepiece")
def op10(spark, d):
    """Encode, then decode what was encoded: pieces, a checksum of their ids, and a digest of the decoded text."""
    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    coded = pieces.encode(table(spark, d, "documents").select("doc_id", "text"), model).drop("text")
    ids = F.concat_ws(",", F.transform("piece_ids", lambda i: i.cast("string")))
    return pieces.decode(coded, model, output="decoded").select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.crc32(ids).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_warc_index")
def op6(spark, d):
    """Write the archives and their index, look up every page's URL, and read the records found."""
    pages = table(spark, d, "pages")
    folder = scratch_path(spark, "warc")
    index = warc.index(warc.archive(pages, folder), folder)
    records = warc.fetch(warc.lookup(pages, index), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_token_files")
def op8(spark, d):
    """Write the token files of all documents and read them back."""
    folder = scratch_path(spark, "tokens")
    parts = tokens.write(table(spark, d, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.checksums(spark, folder, parts)


@query("op3_embedding_near_dedup")
def op3(spark, d):
    return neardup.near_duplicates(table(spark, d, "embeddings"))


@query("op1_toxicity")
def op1(spark, d):
    documents = table(spark, d, "documents")
    model = toxicity.train(documents.select("doc_id", "text"), table(spark, d, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted",
        F.size("passages").alias("n_passages"))


@query("op5_pii_pseudonyms")
def op5(spark, d):
    """All documents with their personal data replaced; a user brings a secret key."""
    return pseudonyms.pseudonymise(table(spark, d, "documents").select("doc_id", "text"), key="example key")


@query("op11_periodic_runs")
def op11(spark, d):
    """Runs of all documents; the end of every tenth is first made periodic."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def periodic(w):
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " ")

    text = F.when(h % 10 == 0, let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, periodic(w)))).otherwise(F.col("text"))
    found = periods.find_runs(table(spark, d, "documents").select("doc_id", text.alias("text")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", periods.greatest("runs"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_license_scan")
def op12(spark, d):
    """License phrases and texts of all documents."""
    found = licenses.scan(table(spark, d, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["template"] < len(licenses.PHRASES))

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first_word").alias("first_word"), F.array_max("base.first_word").alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.filter("spans", lambda s: s["accepted"])).alias("labels"),
        F.coalesce(F.array_max("spans.share"), F.lit(0.0)).alias("score"))


@query("op13_embedding_whitening")
def op13(spark, d):
    """Every usable vector on the first 16 components."""
    found = whitening.whiten(table(spark, d, "embeddings").select("vec_id", "embedding"))
    each = found.select("vec_id", "n", "deviation", "identity_error",
                        F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "part"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "part.whitened", "part.explained",
                       "identity_error")


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
