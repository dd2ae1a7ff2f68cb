"""A Bradley-Terry quality classifier: scores learnt from pairs of which one text is preferred.

A text is a vector of style features (shares of character classes and of their successions,
word and line statistics). Each preference pair holds a text of label 1 and one of label 0;
the logistic loss on the difference of their features is minimised without an intercept, so
that the model is a score to rank by. The cut is the quantile of the training scores below
which the label-0 share of the sample lies; the score returned is the logistic function of
the distance from the cut.

Training takes every labelled row, each as often as it stands in the table; a caller may bound
their number (rows with the smallest hashes). Rows get their places, pairs their rows and the
cut its scores by ranges and shuffles, so that no task holds all of a label's. Scoring covers
every whole text.

Defined results: null and empty texts have the zero vector and a score like any other. If
the sample lacks one of the two labels there is nothing to prefer and each score is 0.5.
A repeated row is scored each time; several labels of one document are several examples.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import positions
from .common import WordIds, column, raw, small_batches, stage
from .fertility import dup_lines, repeated

#: Labels of so many rows are broadcast to the texts; more meet the texts' features by a shuffle.
LABELS = 500_000
#: Preference pairs per row of the more frequent label.
PAIRS = 3
SEED = 7

LOWER, UPPER, DIGIT, SPACE, LINE, STOP, SIGN, HIGH = range(8)
_CLASS = np.array([HIGH if c >= 128 else LINE if c == 10 else SPACE if c <= 32 else DIGIT if chr(c).isdigit() else UPPER if chr(c).isupper() else LOWER if chr(c).islower() else STOP if chr(c) in ".,;:'\"()-?" else SIGN for c in range(256)], np.uint8)
WORD_FEATURES = 8
FEATURES = 8 + 64 + WORD_FEATURES


def features(text: bytes, words: WordIds) -> np.ndarray:
    out = np.zeros(FEATURES)
    if not text:
        return out
    c = _CLASS[np.frombuffer(text, np.uint8)]
    out[:8] = np.bincount(c, minlength=8) / len(c)
    if len(c) > 1:
        out[8:72] = np.bincount(c[:-1] * np.uint8(8) + c[1:], minlength=64) / (len(c) - 1)
    idx = words.of(text.split())
    n = len(idx)
    if n:
        counts = np.unique(idx, return_counts=True)[1]
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[72:] = (
            np.log1p(n) / 10, min(len(text) / n, 40) / 40, len(counts) / n, counts.max() / n, repeated(idx) / n,
            dup_lines(text) / len(lines), np.log1p(n / len(lines)) / 10, len(counts) / n * (n > 200),
        )
    return out


def featurize(docs: DataFrame, *keep: str) -> DataFrame:
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        for b in small_batches(batches, 512):
            words.trim()
            x = np.array([features(t, words) for t in raw(b)])
            col = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(column(b, k) for k in keep), col], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keep), "x array<double>"]))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    cut: float


def sample(labelled: DataFrame, bound: int | None = None) -> DataFrame:
    """doc_id and label of the labelled rows, at most bound of them: those with the smallest hashes."""
    rows = labelled.where("label is not null").select("doc_id", "label")
    return rows if bound is None else rows.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "label").limit(bound)


def fit(docs: DataFrame, labelled: DataFrame, bound: int | None = None) -> Model:
    """Learn from labelled (doc_id, label 0 or 1). Only labelled texts are looked at, if the labels can be broadcast."""
    chosen = stage(sample(labelled, bound).withColumnRenamed("doc_id", "labelled_id"))
    same = F.col("doc_id") == F.col("labelled_id")
    if chosen.count() <= LABELS:
        rows = featurize(docs.select("doc_id", "text").join(F.broadcast(chosen), same), "doc_id", "label")
    else:
        rows = featurize(docs, "doc_id").join(chosen, same).select("doc_id", "label", "x")
    if bound is not None:  # a labelled doc_id may stand on any number of rows: of their features as many are kept as of labels
        rows = rows.orderBy(F.xxhash64("doc_id", "x", F.lit(SEED)), "doc_id", "label").limit(bound)
    rows = stage(rows)
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = n.get(1, 0), n.get(0, 0)
    if not good or not bad:
        return Model(np.zeros(FEATURES), 0.0)
    placed = positions(rows.select(F.col("label").alias("source"), F.xxhash64("doc_id").alias("ts"), "doc_id", F.xxhash64("x").alias("value"), "x"), tie="doc_id")
    placed = stage(placed.select(F.col("source").alias("label"), F.col("window_idx").alias("r"), "x"))
    i = F.col("id")
    pairs = docs.sparkSession.range(0, PAIRS * max(good, bad)).select((i % 2).cast("double").alias("first"), (i % good).alias("g"), ((i * 7919 + F.floor(i / good)) % bad).alias("b"))
    x = placed.where("label = 1").select(F.col("r").alias("g"), F.col("x").alias("xg"))
    y = placed.where("label = 0").select(F.col("r").alias("b"), F.col("x").alias("xb"))
    sign = 2 * F.col("first") - 1
    diff = pairs.join(x, "g").join(y, "b").select(F.col("first").alias("label"), array_to_vector(F.zip_with("xg", "xb", lambda a, b: sign * (a - b))).alias("features"))
    lr = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=60, tol=1e-5).fit(diff)
    weights = np.round(lr.coefficients.toArray(), 6)  # tasks end in any order, so the last digits of their sums vary
    raw_score = F.aggregate(F.zip_with("x", F.lit(weights.tolist()), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return Model(weights, round(quantile(placed.select(raw_score.alias("score")), bad / (good + bad), good + bad), 6))


def quantile(scores: DataFrame, share: float, n: int) -> float:
    """The share's quantile of n scores, with the two around it interpolated, by their places among all."""
    at = share * (n - 1)
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    placed = positions(scores.select(F.lit(0).alias("source"), F.col("score").alias("ts"), F.lit(0).alias("value")))
    found = {r["window_idx"]: r["ts"] for r in placed.where(F.col("window_idx").isin(lo, hi)).select("window_idx", "ts").collect()}
    return float(found[lo] if lo == hi else (hi - at) * found[lo] + (at - lo) * found[hi])


def scores(texts: list[bytes], model: Model, words: WordIds) -> np.ndarray:
    words.trim()
    x = np.array([features(t, words) for t in texts]).reshape(-1, FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ model.weights - model.cut, -500, 500)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        for b in small_batches(batches, 512):
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(scores(raw(b), model, words))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is at least that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        for b in small_batches(batches, 512):
            yield b.filter(pa.array(scores(raw(b), model, words) >= least))

    return docs.mapInArrow(run, docs.schema)
