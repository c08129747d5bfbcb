"""Quality rules: a threshold table compiled into one projection of ratios, without user functions.

Every count is an expression over the document's own row, so the whole operator is one scan without a shuffle.
Repeated windows are found on 64-bit hashes of eight words; two different windows of one text share a hash with a
probability of n * n / 2 ** 64.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import shared

WINDOW = 8

# Frequent short words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "a", "in", "is", "it", "that", "for", "was", "on", "are", "as", "with", "by", "from",
    "at", "be", "this", "or", "an",
    "der", "die", "das", "und", "ist", "zu", "den", "von", "mit", "auf", "für", "ein", "des", "sich", "nicht", "auch",
    "le", "la", "les", "de", "et", "un", "une", "est", "pour", "que", "dans", "qui", "sur", "pas", "avec", "en", "du",
    "el", "los", "las", "y", "con", "por", "para", "se", "no", "su", "lo",
]
_STOP_FORMS = [*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie in [low, high]; a bound of None is open, and so is 0 / 0."""
    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


# The threshold table. Texts of ordinary prose lie well inside every bound.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.5),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
)
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30


def _repeated_positions(hashes: Column) -> Column:
    """Ascending starts of the windows whose hash occurs more than once."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        hits = F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    return shared.let(ordered, twice)


def _covered(starts: Column, width: int) -> Column:
    """Positions covered by windows of ``width`` that begin at the ascending starts."""
    def step(acc: Column, start: Column) -> Column:
        fresh = F.least(F.lit(width), start + F.lit(width) - acc["end"])
        return F.struct((acc["n"] + fresh).alias("n"), (start + F.lit(width)).alias("end"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(starts, zero, step)["n"]


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text, the first one included."""
    def paired(gap: int):
        def body(h: Column) -> Column:
            n = F.greatest(F.size(h) - gap, F.lit(0))
            return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + gap), n), lambda a, b: F.xxhash64(a, b))
        return body

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    gap = 1
    while gap < width:  # windows of 2, 4 and 8 words from those of half the width
        hashes = shared.let(hashes, paired(gap))
        gap *= 2
    if gap != width:
        raise ValueError("the window must be a power of two")
    return shared.let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), _covered(_repeated_positions(h), width)).otherwise(F.lit(0)))


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with the counts that rules refer to; NULL texts count as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda l: l.rlike(shared.WORD))
    df = df.withColumns({"__words": shared.words(body), "__lines": lines})
    # Once the word array is a column of its own, everything else reads it.
    return df.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")).cast("long"),
        "n_stop_words": F.size(F.filter("__words", lambda w: w.isin(_STOP_FORMS))).cast("long"),
    }).drop("__words", "__lines")


def violated(rules=RULES) -> Column:
    """Names of the rules a measured row breaks."""
    def broken(rule: Rule) -> Column:
        top, bottom = F.col(rule.numerator), F.col(rule.denominator)
        tests = []
        if rule.low is not None:
            tests.append(top < rule.low * bottom)
        if rule.high is not None:
            tests.append(top > rule.high * bottom)
        if not tests:
            raise ValueError(f"rule {rule.name} has no bound")
        test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        return F.when(test, F.lit(rule.name))
    return F.array_compact(F.array(*[broken(r) for r in rules]))


def assess(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The table with all counts, ``base_failed``, the names of ``broken_rules`` and ``kept``.

    A text without words fails the base test. Columns of the same names are replaced. Rows keep their number: repeated
    rows, NULL ids and NULL texts are judged like any other.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = measures(df, text).withColumns({"base_failed": base, "broken_rules": violated(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep_good(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    columns = df.columns
    safe = df.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    # A filter would be pushed below the counts and compute each of them again.
    once = F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    judged = assess(safe, "__text", rules).select("__row", F.explode(once))
    return judged.select(*[F.col("__row").getField(c).alias(c) for c in columns])
