"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is cut into words and runs of punctuation. A word that equals the one or two before it becomes a repeat mark, so
that repetition is seen whatever the word. Words and pairs of neighbours are hashed into ``2 ** BITS`` features, valued
log(1 + count) and scaled to length one. Nothing but the text is an input of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, free_name, mixed, schema_with, windows

BITS = 18
MOST_LABELS = 10_000
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")
REPEAT, BIAS = np.uint64(0x5DEECE66D), 0


@dataclass(frozen=True)
class Ftrl:
    """Learning rate, its smoothing, and the weights of the absolute and squared penalties."""

    alpha: float = 1.5
    beta: float = 1.0
    l1: float = 0.001
    l2: float = 0.001
    epochs: int = 6


class Features:
    """text -> (indices, values). Index 0 is the constant feature."""

    def __init__(self):
        self.hashes = WordHashes()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        h = self.hashes.of(TOKEN.findall(text))
        if not len(h):
            return np.array([BIAS], np.int32), np.ones(1, np.float32)
        same = np.zeros(len(h), bool)
        same[1:] |= h[1:] == h[:-1]
        same[2:] |= h[2:] == h[:-2]
        h = np.where(same, REPEAT, h)
        grams = np.concatenate([mixed(h), windows(h, 2)]) if len(h) > 1 else mixed(h)
        index, count = np.unique((grams % np.uint64(2**BITS - 1)).astype(np.int32) + 1, return_counts=True)
        value = np.log1p(count)
        value /= np.sqrt((value * value).sum())
        return np.append(index, np.int32(BIAS)), np.append(value, 1.0).astype(np.float32)


def probability(dot: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(dot, -35, 35))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], how: Ftrl) -> np.ndarray:
    """Weights after ``how.epochs`` passes over (label, indices, values), in the order given."""
    z, n = np.zeros(2**BITS), np.zeros(2**BITS)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= how.l1, 0.0, (np.sign(zi) * how.l1 - zi) / ((how.beta + np.sqrt(ni)) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for label, i, x in rows:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (probability(float(w @ x)) - label) * x
            more = ni + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / how.alpha * w
            n[i] = more
    return weights(z, n).astype(np.float32)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out. A null id is in no fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS, how: Ftrl = Ftrl()) -> np.ndarray:
    """Weights from the labelled documents outside fold 0, or from ``most`` of them, chosen by a hash of the id, if they are more.

    That bound is what lets one task train them in a fixed order. Features are made where the documents are; only the
    chosen rows' features travel. Null labels are left out; of several labels of one document the lowest counts, and of several
    rows of one document the one whose text sorts first (null as empty), so that the bound holds for rows too. Without
    labels the weights are 0, and every score 0.5.
    """
    chosen = labels.where(F.col("quality").isNotNull() & (fold() != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen.select("doc_id", F.col("quality").cast("int"), "at")), "doc_id")
    texts = texts.groupBy("at", "doc_id", "quality").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features()
        for batch in batches:
            both = [made(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([i.tobytes() for i, _ in both], pa.binary()), pa.array([v.tobytes() for _, v in both], pa.binary())], ["at", "doc_id", "quality", "i", "x"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for b in batches for y, i, x in zip(*(b.column(n).to_pylist() for n in ("quality", "i", "x")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([train(rows, how).tobytes()], pa.binary())], ["w"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    model = texts.mapInArrow(features, f"at long, doc_id {kind}, quality int, i binary, x binary").repartition(1).sortWithinPartitions("at", "doc_id", "i", "x").mapInArrow(trained, "w binary").collect()
    return np.frombuffer(model[0].w, np.float32) if model else np.zeros(2**BITS, np.float32)


def score(docs: DataFrame, weights: np.ndarray, column: str = "score") -> DataFrame:
    """``docs`` with ``column``: the probability of label 1. Narrow: one pass, no shuffle.

    The broadcast weights have a fixed size, 4 * 2 ** BITS bytes. A null text counts as empty; an empty one is scored by
    the constant feature. All columns and rows stay; a column of that name is replaced. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, w = Features(), shared.value
        for batch in batches:
            scores = [probability(float(w[i] @ x)) for t in batch.column("text").to_pylist() for i, x in [made(t or "")]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return kept.mapInArrow(run, schema_with(kept, **{column: "double"}))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns, whatever their names; see ``fit`` and ``score``."""
    at = free_name(docs, "quality_score")
    return score(docs, fit(docs, labels), at).where(F.col(at) >= threshold).drop(at)
