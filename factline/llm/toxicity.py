"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, of pairs of neighbours and of pairs one and two words apart, hashed to
2**HASH_BITS coordinates.  Each coordinate has its own learning rate, and the L1 term keeps most weights at exactly zero:
the model is the list of those that are not, a few thousand numbers at most (its size is bounded by the training sample),
and travels inside the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 20
#: Labelled documents of each class that the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 9000
EPOCHS = 4
ALPHA, BETA, L2 = 0.3, 1.0, 0.0
#: The L1 weight is the number of training rows over this, at least 1: what a coordinate must move before it counts.
L1_ROWS = 400
THRESHOLD = 0.7

#: ASCII but for letters and digits parts words; bytes of other characters are letters.
PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted coordinates of a text; none for null and for a text without letters or digits."""
    words = text.lower().encode("utf-8", "replace").translate(PARTS).split() if text else []
    if not words:
        return np.zeros(0, np.int32)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    found = [h]
    for gap in (1, 2, 3):
        found.append((h[:-gap] * np.uint64(0x9E3779B97F4A7C15) ^ h[gap:] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(2 * gap + 1))
    return np.unique((np.concatenate(found) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - HASH_BITS)).astype(np.int32))


@dataclass(frozen=True)
class Model:
    bias: float
    at: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << HASH_BITS, np.float32)
        out[self.at] = self.weight
        return out


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Rows in the order given, several times over; the bias is a coordinate without L1."""
    size = 1 << HASH_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, max(1.0, len(rows) / L1_ROWS))
    l1[size] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1[at], 0.0, -(zi - np.sign(zi) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(rows, labels, strict=True):
            at = np.append(at, size)
            w = weights(at)
            g = 1 / (1 + math.exp(-min(35.0, max(-35.0, float(w.sum()))))) - y
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    w = weights(np.arange(size + 1))
    at = np.flatnonzero(w[:size])
    return Model(float(w[size]), at.astype(np.int32), w[at].astype(np.float32))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, rows, labels = WordHashes(), [], []
    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1), strict=True):
            rows.append(features(text.as_py(), hashes))
            labels.append(y.as_py())
    model = train(rows, np.array(labels, np.float64))
    at = np.append(model.at, -1)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.append(model.weight, model.bias).astype(np.float64))], ["at", "w"])


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of each class for which ``may_learn`` (of doc_id) holds.

    Labels other than 0 and 1 and ids that are null or not in ``docs`` count for nothing.  The sample is chosen by a hash
    of the id, so reruns agree; it is small by its bound, joins as a broadcast and is fitted by one task.  The bias is then
    shifted from the sample's odds of the classes to odds half-way (in logarithms) between those of all labels that may be
    learned and even ones, so that rare toxic texts are not scored by their rarity alone.
    """
    known = labels.where(may_learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).distinct()
    place = F.xxhash64(F.lit("toxicity"), "_id")
    chosen = [known.where(F.col("_y") == y).orderBy(place, "_id").limit(sample) for y in (0, 1)]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), F.col("doc_id") == F.col("_id"))
    ordered = rows.select("text", "_y", place.alias("_place"), "_id").repartition(1).sortWithinPartitions("_place", "_id", "_y", "text")
    got = ordered.select("text", "_y").mapInArrow(_trained, "at int, w double").collect()
    at = np.array([r["at"] for r in got if r["at"] >= 0], np.int32)
    weight = np.array([r["w"] for r in got if r["at"] >= 0], np.float32)
    seen = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    shift = 0.0
    if len(seen) == 2:
        shift = math.log(seen[1] / seen[0]) / 2 - math.log(min(seen[1], sample) / min(seen[0], sample))
    return Model(next((r["w"] for r in got if r["at"] < 0), 0.0) + shift, at, weight)


def with_score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text; null and empty texts get that of no features."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, hashes = model.dense(), WordHashes()
        for series in texts:
            out = np.empty(len(series))
            for i, text in enumerate(series):
                w = model.bias + float(weights[features(text, hashes)].sum(dtype=np.float64))
                out[i] = 1 / (1 + math.exp(-min(35.0, max(-35.0, w))))
            yield pd.Series(out)

    return docs.withColumn(column, score(F.col("text").cast("string")))
