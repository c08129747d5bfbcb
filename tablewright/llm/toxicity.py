"""Toxicity by maximum-scoring segments: log-odds of tokens, a linear scan for passages, extreme-value calibration.

Training: of labelled documents the words, and their beginnings of five and three letters, are counted once per document
and class. The share of toxic documents among those with a word has a Dirichlet prior at the share of its beginning,
that one at the share of the shorter beginning, and this at the overall share; a word scores the log-odds of its share
against the overall share, and words without enough evidence score by their beginning. Unlike words of no interest, which
score a constant below 0.

Scan: one pass over a text finds all maximal passages of positive score (each cannot be extended or cut to score more).
In a clean text of n words the number of passages that score S or more is about K n exp(-lambda S); lambda follows from
the scores of clean words, K from the passages of clean training documents. So a passage of any text has an expected
number E in clean texts of that length. Passages with E below ``MAX_E`` are significant, and the logarithms of their E
add up to the evidence of the document. A logistic curve fitted on training documents turns evidence into a score.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import shared

# The model is fitted on at most so many labelled rows, those whose hashed id is smallest. It has a unit for each word and
# beginning that is toxic often enough, so the bound on rows bounds it too.
TRAIN_ROWS = 30_000
# A unit needs so many toxic documents; the weight of a prior in documents; the least log-odds of interest.
LEAST_DOCUMENTS, PRIOR, LEAST_LOG_ODDS = 4, 8.0, 1.0
DRIFT, MAX_E = -0.25, 0.1
_EVIDENCE = (-10.0, 60.0)
_STRIP = b".,;:!?\"'()[]{}#*$%&|<>-_"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation around them."""
    return [w.strip(_STRIP) for w in (text or "").lower().encode().split()]


def units(word: bytes) -> tuple[bytes, bytes, bytes]:
    """A word's units from the special to the general: itself and its beginnings, marked by their length."""
    letters = word.decode()
    return b"w" + word, b"5" + letters[:5].encode(), b"3" + letters[:3].encode()


@dataclass
class Model:
    scores: dict[bytes, float]
    rate: float = 1.0
    factor: float = 1.0
    intercept: float = 0.0
    slope: float = 1.0

    def token(self, word: bytes) -> float:
        for unit in units(word):
            if (score := self.scores.get(unit)) is not None:
                return score
        return DRIFT

    def segments(self, tokens: list[bytes], known: dict[bytes, float]) -> list[tuple[int, int, float]]:
        """(first, one past the last, score) of all maximal segments of positive score.

        Every open segment knows the nearest earlier one that starts lower. A segment that is joined or passed over is not
        looked at again, so the scan is linear.
        """
        firsts, ends, lows, highs, lower = [], [], [], [], []  # lower: the place of the nearest earlier one that starts lower
        total, last = 0.0, 0
        for at, word in enumerate(tokens):
            score = known.get(word)
            if score is None:
                score = known[word] = self.token(word)
            if score <= 0:
                continue
            total += DRIFT * (at - last)  # all words in between score the same
            first, low, high = at, total, total + score
            total, last = high, at + 1
            j = len(lows) - 1
            while True:
                # Join with the nearest earlier segment that starts lower, unless that one reaches as high already.
                while j >= 0 and lows[j] >= low:
                    j = lower[j]
                if j < 0 or highs[j] >= high:
                    break
                first, low = firsts[j], lows[j]
                for held in (firsts, ends, lows, highs, lower):
                    del held[j + 1:]
                j = lower[j]
                for held in (firsts, ends, lows, highs, lower):
                    held.pop()
            for held, value in zip((firsts, ends, lows, highs, lower), (first, at + 1, low, high, j)):
                held.append(value)
        return [(a, b, high - low) for a, b, low, high in zip(firsts, ends, lows, highs)]

    def surprise(self, score: float, n: int) -> float:
        """Minus the logarithm of the expected number of such passages in a clean text of n words."""
        return self.rate * score - math.log(self.factor * max(n, 1))

    def evidence(self, segments, n: int) -> float:
        each = [self.surprise(s, n) for _, _, s in segments]
        strong = [x for x in each if x > -math.log(MAX_E)]
        x = sum(strong) if strong else max(each, default=_EVIDENCE[0])
        return min(max(x, _EVIDENCE[0]), _EVIDENCE[1])

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-(self.intercept + self.slope * evidence)))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: by the CRC-32 of its id as text. Rows without an id are not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def flush() -> pa.RecordBatch:
        names = list(toxic.keys() | clean.keys())
        out = pa.RecordBatch.from_pydict({"unit": pa.array(names, pa.binary()), "toxic": pa.array([toxic[u] for u in names], pa.int64()),
                                          "clean": pa.array([clean[u] for u in names], pa.int64())})
        toxic.clear()
        clean.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (toxic if label else clean).update({u for w in set(words(text)) if w for u in units(w)})
            if len(toxic) + len(clean) > 500_000:
                yield flush()
    yield flush()


def _scanned(model: Model):
    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("scores", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            texts = [words(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("toxic").cast(pa.int32()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[s for *_, s in model.segments(t, known)] for t in texts], pa.list_(pa.float64()))], schema=schema)
            if len(known) > 500_000:
                known.clear()
    return run


def _log_odds(share: float) -> float:
    return math.log(share / (1 - share))


def unit_scores(rows: list[tuple[bytes, int, int]], toxic: int, clean: int) -> dict[bytes, float]:
    """Scores of counted units (unit, toxic documents, clean documents), those of interest only."""
    counts = {u: (t, c) for u, t, c in rows}
    overall = (toxic + 1) / (toxic + clean + 2)

    def share(unit: bytes, prior: float) -> float:
        t, c = counts.get(unit, (0, 0))
        return (t + PRIOR * prior) / (t + c + PRIOR)

    out = {}
    for unit in counts:
        letters = unit[1:].decode()
        value = overall
        for length, mark in ((3, b"3"), (5, b"5"), (None, b"w")):
            value = share(mark + letters[:length].encode(), value)
            if mark == unit[:1]:
                break
        score = _log_odds(value) - _log_odds(overall)
        out[unit] = score if score >= LEAST_LOG_ODDS else DRIFT
    return out


def _rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The lambda > 0 at which the expectation of exp(lambda score) is 1 over clean words."""
    rest = max(0.0, 1.0 - shares.sum())
    low, high = 1e-3, 4.0
    for _ in range(60):
        mid = (low + high) / 2
        if float((shares * np.exp(mid * scores)).sum()) + rest * math.exp(mid * DRIFT) > 1:
            high = mid
        else:
            low = mid
    return low


def _logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, with a weak prior for a finite slope."""
    a, b = 0.0, 0.5
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(weight * (label - p)).sum(), (weight * (label - p) * x).sum() - 0.01 * b])
        v = weight * p * (1 - p)
        h = np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], max(0.01, b + step[1])
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model from documents (doc_id, text) and labels (doc_id, toxic) outside the held-out fifth, ``train_rows`` at most.

    Of several labels of a document the highest counts; labels of NULL are left out. Without labelled documents of both
    classes the model finds nothing, and its score is the share of toxic ones (0.5 without any).
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = (usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    # train_rows rows at most, so it can be sent to every task.
    training = documents.join(F.broadcast(shared.stored(sample, "toxic-sample")), "doc_id").select("text", "toxic")
    counted = training.mapInArrow(_counts, "unit binary, toxic bigint, clean bigint").groupBy("unit").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = counted.where(F.col("toxic") >= LEAST_DOCUMENTS)
    by_class = {r["toxic"] > 0: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sum(n for k, n in by_class.items() if k), sum(n for k, n in by_class.items() if not k)
    if not toxic or not clean:
        return Model({}, intercept=_log_odds((toxic + 1) / (toxic + clean + 2)), slope=0.0)
    rows = [(bytes(r["unit"]), r["toxic"], r["clean"]) for r in kept.collect()]
    model = Model(unit_scores(rows, toxic, clean))
    clean_words = max(1, sum(c for u, _, c in rows if u[:1] == b"w"))
    seen = [(model.scores[u], c) for u, _, c in rows if u[:1] == b"w" and model.scores[u] > 0]
    model.rate = _rate(np.array([s for s, _ in seen]), np.array([c for _, c in seen], float) / clean_words)
    scanned = shared.stored(training.mapInArrow(_scanned(model), "toxic int, n bigint, scores array<double>"), "toxic-scan")
    peaks = scanned.where("toxic = 0").agg(
        F.sum("n").alias("n"), F.sum(F.size(F.filter("scores", lambda s: s >= 1.0))).alias("peaks")).first()
    model.factor = max(1.0, float(peaks["peaks"] or 0)) * math.exp(model.rate) / max(1, peaks["n"] or 0)
    # Rounded to tenths, so that a bounded number of rows comes back.
    found = scanned.mapInArrow(_evidences(model), "toxic int, x double").groupBy("toxic", "x").agg(F.count("*").alias("n")).collect()
    model.intercept, model.slope = _logistic(*(np.array([float(r[c]) for r in found]) for c in ("x", "toxic", "n")))
    return model


def _evidences(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [round(model.evidence([(0, 0, v) for v in s], n), 1) for n, s in zip(b.column("n").to_pylist(), b.column("scores").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([int(t > 0) for t in b.column("toxic").to_pylist()], pa.int32()),
                                              pa.array(x, pa.float64())], ["toxic", "x"])
    return run


_PASSAGES = pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("surprise", pa.float64())])
_SCORED_SQL = ("doc_id bigint, evidence double, score double, predicted int, "
               "passages array<struct<first_word: int, end_word: int, surprise: double>>")


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        for batch in batches:
            evidence, score, passages = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = words(text)
                found = model.segments(tokens, known)
                evidence.append(model.evidence(found, len(tokens)))
                score.append(model.score(evidence[-1]))
                strong = [(a, b, model.surprise(s, len(tokens))) for a, b, s in found]
                passages.append([dict(zip(("first_word", "end_word", "surprise"), p)) for p in strong if p[2] > -math.log(MAX_E)])
                if len(known) > 500_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(evidence, pa.float64()), pa.array(score, pa.float64()),
                pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(passages, pa.list_(_PASSAGES))],
                ["doc_id", "evidence", "score", "predicted", "passages"])
    return run


def score(documents: DataFrame, model: Model, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(doc_id, evidence, score, predicted, passages), one row per document, from its text alone.

    ``passages`` are the significant ones, by word numbers. An empty or NULL text has none, and the lowest evidence.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_scored(model), _SCORED_SQL)
