"""Quality by Bradley-Terry pairwise ranking.

From a bounded sample of labelled documents (``SAMPLE`` of each label) preference pairs are drawn: a document labelled 1
over one labelled 0. The weights of a linear score minimise the logistic loss of the pairs' feature differences. The
threshold is the quantile, at the share of label 0, of the scores of all labelled rows that may be learnt from; above it
the reported score is over ``THRESHOLD``, and rows that tie with it stay below.

Features are computed from the whole text alone. Null and empty texts have the features of a text without words. With
labels of one kind only every text scores 1 or 0, without labels 0. Repeated rows are scored one by one. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.llm.batches import extended, map_batches, texts, with_columns
from sheetwise.llm.labelled import chosen, remainder
from sheetwise.llm.quality_rules import STOP_WORDS
from sheetwise.runtime import materialize

SAMPLE = 3000
PAIRS = 60_000
ROUNDS = 300
RATE = 0.5
PENALTY = 1e-3
SEED = 11
THRESHOLD = 0.7
_STOP = frozenset(STOP_WORDS)
_UPPER, _LOWER = np.arange(ord("A"), ord("Z") + 1), np.arange(ord("a"), ord("z") + 1)
_DIGITS, _MARKS = np.arange(ord("0"), ord("9") + 1), np.frombuffer(b"#*$%&<>", "u1")
FEATURES = (
    "log_words", "word_length", "upper", "digits", "marks", "bars", "shouts", "other_ascii", "stop_words", "distinct_words",
    "same_as_before", "distinct_windows", "dup_lines", "log_line", "one_letter", "long_words",
)


def features(text: str) -> list[float]:
    """The values of ``FEATURES``."""
    data = text.encode()
    words = text.split()
    n, size = max(len(words), 1), max(len(data), 1)
    at = np.bincount(np.frombuffer(data, "u1"), minlength=256)
    letters = max(int(at[_UPPER].sum() + at[_LOWER].sum()), 1)
    marks, bars, shouts = int(at[_MARKS].sum()), int(at[ord("|")]), int(at[ord("!")])
    lines = [x for x in text.split("\n") if x.strip()]
    plain = at[_UPPER].sum() + at[_LOWER].sum() + at[_DIGITS].sum() + at[128:].sum() + at[[9, 10, 13, 32, 33, 44, 46, 124]].sum() + marks
    windows = max(len(words) - 2, 1)
    lengths = list(map(len, words))
    return [
        np.log1p(len(words)),
        min(sum(lengths) / n, 30.0),
        at[_UPPER].sum() / letters,
        at[_DIGITS].sum() / size,
        min(marks / n, 3.0),
        min(bars / n, 1.0),
        min(shouts / n, 2.0),
        (size - plain) / size if data else 0.0,
        sum(map(_STOP.__contains__, words)) / n,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:]))) / windows if len(words) > 2 else 1.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        np.log1p(len(data) / max(len(lines), 1)),
        sum(x == 1 for x in lengths) / n,
        sum(x > 15 for x in lengths) / n,
    ]


class Ranking:
    """A standardised linear score, and the cut and scale that make it a probability-like score."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, weights: np.ndarray, cut: float, scale: float):
        self.mean, self.deviation, self.weights, self.cut, self.scale = mean, deviation, weights, cut, scale

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.clip((self.raw(x) - self.cut) * self.scale, -30, 30) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-odds))


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Ranking | float:
    """The ranking of feature rows, its cut still 0; a constant score without labels of both kinds."""
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.0
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    model = Ranking(mean, deviation, np.zeros(x.shape[1]), 0.0, 1.0)
    z = np.clip((x - mean) / deviation, -8, 8)
    rng = np.random.default_rng(seed)
    better, worse = (rng.choice(np.flatnonzero(y == k), PAIRS) for k in (1, 0))
    difference = z[better] - z[worse]
    for _ in range(ROUNDS):
        lost = 1 / (1 + np.exp(np.clip(difference @ model.weights, -30, 30)))
        model.weights += RATE * (lost @ difference / PAIRS - PENALTY * model.weights)
    raw = model.raw(x)
    model.scale = 8.0 / max(float(np.median(raw[y == 1]) - np.median(raw[y == 0])), 1e-6)
    return model


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the array features of ``FEATURES``, of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_columns(batch, {"features": pa.array([features(t) for t in texts(batch, text)], pa.list_(pa.float64()))})

    return map_batches(docs, run, extended(docs, T.StructField("features", T.ArrayType(T.DoubleType()))))


def train(docs: DataFrame, labels: DataFrame, allowed) -> Ranking | float:
    """The ranking learnt from ``labels`` where ``allowed``, without its cut. Only features reach the driver."""
    found = with_features(chosen(docs, labels, "quality", allowed, SAMPLE)).select("k", "doc_id", "label", "features").toArrow().to_pylist()
    found.sort(key=lambda r: (r["k"], r["doc_id"], r["features"]))
    return fit(np.array([r["features"] for r in found], "f8").reshape(-1, len(FEATURES)), np.array([r["label"] for r in found], "i8"))


def with_raw(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """``docs`` with raw, the linear score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(batch, text)
            yield with_columns(batch, {"raw": pa.array(model.raw(np.array([features(t) for t in found], "f8")) if found else np.zeros(0))})

    return map_batches(docs, run, extended(docs, T.StructField("raw", T.DoubleType())))


def quantile_cut(scored: DataFrame, labels: DataFrame, allowed) -> float:
    """The least cut above the quantile of raw at the share of label 0, over all labelled rows of ``scored`` (doc_id, raw)."""
    known = labels.filter(allowed & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = scored.select("doc_id", "raw").join(known, "doc_id")
    share = float(rows.agg(F.avg(1 - F.col("quality")).alias("low")).first().low or 0.0)
    found = rows.agg(F.percentile_approx("raw", min(max(share, 0.0), 1.0), 100_000).alias("cut")).first().cut
    return float(found or 0.0) + 1e-6


def scored(rows: DataFrame, model: Ranking | float) -> DataFrame:
    """``rows`` (with raw) with score (0 to 1) and predicted (1 from ``THRESHOLD``)."""
    if isinstance(model, float):
        score = F.lit(model)
    else:
        odds = (F.col("raw") - model.cut) * model.scale
        score = 1 / (1 + F.exp(-(F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0)) + float(np.log(THRESHOLD / (1 - THRESHOLD))))))
    return rows.withColumn("score", score).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, allowed, text: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row of ``docs``, learnt from ``labels`` where ``allowed``."""
    model = train(docs.select("doc_id", F.col(text).alias("text")), labels, allowed)
    if isinstance(model, float):
        return scored(docs.select("doc_id"), model)
    rows = materialize(with_raw(docs.select("doc_id", text), model, text).select("doc_id", "raw"), "quality")
    model.cut = quantile_cut(rows, labels, allowed)
    return scored(rows, model).drop("raw")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 4) != 2)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
