"""Mixing sources to target weights: random keys, ranges of keys, distributed prefix sums and exact cuts.

Every document gets a random key from its id. Within its source the keys are cut into equal ranges; the words of each
range are summed where they lie, and the running sums over these few rows say in which range a source's budget ends.
Only that range is sorted and summed row by row, which gives one row per source: how many whole epochs are taken and at
which key the last one ends. With it every document knows its share, so texts are never shuffled and a source with
most of the rows is no heavier than the others.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import shared

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
_KEY_BITS = 60
_ROWS_PER_RANGE = 20_000


def random_key(doc_id: Column, seed: int) -> Column:
    """60 bits that depend on the id and the seed alone; rows without an id share one key."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, _KEY_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(shared.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Adds ``target`` to a table of (source, source_size).

    Sources weigh by their rank in code point order, NULL last, and share the sum of all sizes; none gets more than
    ``max_epochs`` times its size, the others share the excess by weight. In the order of size per weight, the sources
    up to some place get their limit and those after it what is left by weight; the place is the first whose rate does
    not reach the limit of the next. The table has one row per source.
    """
    w = F.lit(weights[-1])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    for i, value in enumerate(weights[:-1]):
        w = F.when(F.pmod(F.col("rank"), F.lit(len(weights))) == i, value).otherwise(w)
    ranked = sources.withColumn("rank", rank).withColumn("weight", w.cast("long")).withColumn(
        "limit", max_epochs * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    scanned = ranked.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "shared_by": F.sum("weight").over(behind)})
    # Below its limit at the rate of its place: so are all that follow.
    scanned = scanned.withColumn("free", F.col("limit") * F.col("shared_by") >= F.col("weight") * F.col("left"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scanned = scanned.withColumns({
        "rate_left": F.first(F.when(F.col("free"), F.col("left")), ignorenulls=True).over(whole),
        "rate_by": F.first(F.when(F.col("free"), F.col("shared_by")), ignorenulls=True).over(whole),
        "after": F.max("free").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    by_weight = (F.col("weight") * F.col("rate_left")).cast("double") / F.col("rate_by")
    return scanned.select("source", "source_size", F.when(F.col("after"), by_weight)
                          .otherwise(F.col("limit").cast("double")).alias("target"))


def cuts(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of a table (source, size, key): ``source_size``, ``target``, the whole ``epochs`` taken, and
    of the last epoch the ``cut_key``, with ``cut_words`` of the ``cut_size`` words that lie at that key."""
    bits = max(6, (max(1, sized.count()) // _ROWS_PER_RANGE).bit_length())
    ranged = sized.withColumn("range", F.shiftright("key", _KEY_BITS - bits))
    sums = shared.stored(ranged.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", whole).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    plan = shared.stored(plan, "mix-targets")

    def same_source(a: DataFrame, b: DataFrame) -> Column:
        return a["source"].eqNullSafe(b["source"])

    def ending(df: DataFrame, order: str, words: str) -> DataFrame:
        """The rows at which the running sum of words reaches what is left to take."""
        ordered = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        summed = df.withColumn("upto", F.sum(words).over(ordered))
        return summed.where((F.col("rest") > F.col("upto") - F.col(words)) & (F.col("rest") <= F.col("upto")))

    rest = plan.select("source", "rest")
    at = ending(sums.join(rest, same_source(sums, rest)).drop(rest["source"]), "range", "words")
    at = shared.stored(at.select("source", "range", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")), "mix-ends")
    inside = ranged.join(at, same_source(ranged, at) & (ranged["range"] == at["range"])).select(
        ranged["source"], "key", "size", "rest")
    keys = inside.groupBy("source", "key").agg(F.sum("size").alias("cut_size"), F.first("rest").alias("rest"))
    cut = ending(keys, "key", "cut_size").select(
        "source", F.col("key").alias("cut_key"), "cut_size",
        (F.col("rest") - F.col("upto") + F.col("cut_size")).alias("cut_words"))
    return shared.stored(plan.join(cut, same_source(plan, cut), "left").select(
        plan["source"], "source_size", "target", "epochs", "cut_key", "cut_size", "cut_words"), "mix-cuts")


def _taken() -> Column:
    """Words the mix takes of a row with its ``size``, ``key`` and source's cut; rows at the cut key share it by size."""
    part = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(
        F.col("key") == F.col("cut_key"), F.expr("cut_words * size div cut_size")).otherwise(F.lit(0))
    return (F.col("epochs") * F.col("size") + part).cast("long")


def shares(df: DataFrame, text: str = "text", id_column: str = "doc_id", source: str = "source", seed: int = 42,
           weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``df``.

    ``size`` is the number of words (NULL text: 0), ``taken`` what the mix takes of it, repeats counted. The same ids
    and texts give the same mix. Rows of one source with equal ids get one key and share a cut by size, to whole words.
    A table of empty texts has targets of 0.
    """
    sized = shared.stored(df.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"),
                                    word_count(F.col(text)).alias("size"),
                                    random_key(F.col(id_column), seed).alias("key")), "mix-sizes")
    cut = cuts(sized, weights, max_epochs)
    return sized.join(cut, sized["source"].eqNullSafe(cut["source"])).select(
        "doc_id", "size", "source_size", "target", _taken().alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, with its own white space."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mix(df: DataFrame, text: str = "text", id_column: str = "doc_id", source: str = "source", seed: int = 42,
        weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of ``df``: a row for each time a document is taken.

    A document at the cut comes once more with the text up to the cut. Documents without words are not in the mix.
    """
    columns = df.columns
    rows = df.select(F.struct("*").alias("__row"), F.col(source).alias("__source"), F.col(text).alias("__text"),
                     word_count(F.col(text)).alias("size"), random_key(F.col(id_column), seed).alias("key"))
    cut = cuts(shared.stored(rows.select(F.col("__source").alias("source"), "size", "key"), "mix-sizes"),
               weights, max_epochs)
    taken = rows.join(cut, rows["__source"].eqNullSafe(cut["source"])).withColumn("taken", _taken()).where("taken > 0")
    whole, part = F.expr("taken div size").cast("int"), F.expr("taken % size")
    copies = F.concat(F.array_repeat(F.col("size"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    taken = taken.withColumn("__words", F.explode(copies))
    body = F.when(F.col("__words") < F.col("size"), first_words(F.col("__text"), F.col("__words"))).otherwise(F.col("__text"))
    return taken.select(*[body.alias(c) if c == text else F.col("__row").getField(c).alias(c) for c in columns])
