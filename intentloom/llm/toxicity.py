"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document is the set of its character n-grams (3 to 5 bytes of the lower-cased text, what is neither
letter nor digit as a blank), hashed to 2^18 features. Each feature is scaled by
log((toxic documents with it / all toxic) / (clean ones with it / all clean)), smoothed, and a logistic
regression is fitted over the scaled features.

Training takes a bounded sample of the labelled rows: at most ``TRAIN_ROWS`` of either label, those with the
least hash of doc_id; a fifth of them is held out, on which the threshold of the best F1 at
the labels' true proportion is chosen. One task trains; the model (1 MB, whatever the input) is broadcast and every
document's whole text is scored.

Result: (doc_id, score), a row for each document at or above the threshold; score: probability on the sample.

Defined results: null and empty texts have no n-gram and are never toxic; documents without doc_id are left
out; rows that share a doc_id count as several and the best score is reported; a document with
several labels is toxic if one of them says so, null labels say nothing; other columns are
ignored; without labelled documents of both kinds there is no model and no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .minimisers import ids_and_text

BITS, SIZES = 18, (3, 4, 5)
TRAIN_ROWS, ROUNDS, L2, SMOOTHING = 2500, 80, 1e-4, 1.0
_LOWER = np.where(T._VALUE == 0, 32, T._VALUE).astype(np.uint32)


class Features:
    """Distinct hashed n-grams of each text of a batch."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, bool)

    def of(self, col: pa.Array) -> Iterator[np.ndarray]:
        raw, offsets = T.string_bytes(col)
        value = _LOWER[raw]
        value[np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1] += 32
        grams, h = {}, value
        for k in range(1, max(SIZES)):
            h = h[:-1] * np.uint32(0x01000193) + value[k:] if len(h) else h
            if k + 1 in SIZES:
                mixed = h * np.uint32(0x9E3779B1)
                grams[k + 1] = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            for n in SIZES:
                if b - a >= n:
                    self.seen[grams[n][a : b - n + 1]] = True
            found = np.flatnonzero(self.seen)
            self.seen[found] = False
            yield found


def _featurise(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in T.batches(rows):
        found = [f.astype(np.uint32).tobytes() for f in features.of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "features"])


class Model:
    """fit() takes the feature sets and labels; scores are log-odds."""

    def fit(self, found: list[np.ndarray], y: np.ndarray) -> "Model":
        ptr = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        col = np.concatenate(found).astype(np.int64) if len(found) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(found)), np.diff(ptr))
        toxic = y[row] == 1
        p, q = (SMOOTHING + np.bincount(col[m], minlength=1 << BITS) for m in (toxic, ~toxic))
        self.ratio = np.log((p / (2 * SMOOTHING + (y == 1).sum())) / (q / (2 * SMOOTHING + (y == 0).sum()))).astype(np.float32)
        x = self.ratio[col]
        w, b = np.full(1 << BITS, 0.01, np.float32), 0.0
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        for step in range(1, ROUNDS + 1):
            z = np.bincount(row, x * w[col], len(found)) + b
            error = (balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(np.float32)
            g = (np.bincount(col, x * error[row], 1 << BITS) + L2 * w).astype(np.float32)
            gb = float(error.sum())
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            rate = 0.02 * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            w, b = w - rate * m / (np.sqrt(v) + 1e-8), b - rate * mb / (np.sqrt(vb) + 1e-8)
        self.weight, self.bias = (w * self.ratio).astype(np.float32), float(b)
        return self

    def score(self, found: np.ndarray) -> float:
        return float(self.weight[found].sum()) + self.bias


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Midway between the scores of the best F1 cut."""
    order = np.argsort(-score, kind="stable")
    s, hit, miss = score[order], np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
    f1 = 2 * hit / np.maximum(hit + miss + (weight * y).sum(), 1e-9)
    f1[:-1][s[:-1] == s[1:]] = -1
    i = int(f1.argmax())
    return float((s[i] + s[i + 1]) / 2 if i + 1 < len(s) else s[i])


def _train(share: float):
    """share: toxic rows among all labelled ones."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sorted((i, t, f) for batch in rows for i, t, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "features"))))
        found = [np.frombuffer(f, np.uint32) for *_, f in data]
        y = np.array([t for _, t, _ in data], np.float32)
        if len(set(y.tolist())) < 2:
            return
        held = np.arange(len(y)) % 5 == 4
        if len(set(y[~held].tolist())) < 2 or not held.any():
            held[:] = False
        model = Model().fit([f for f, h in zip(found, held) if not h], y[~held])
        test = held if held.any() else ~held
        score = np.array([model.score(f) for f, t in zip(found, test) if t])
        yt = y[test]
        weight = np.where(yt == 1, share / max(1, (yt == 1).sum()), (1 - share) / max(1, (yt == 0).sum()))
        cut = best_threshold(score, yt, weight)
        caught = score >= cut
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([cut]), pa.array([float(caught[yt == 1].mean()) if (yt == 1).any() else None], pa.float64()), pa.array([float(caught[yt == 0].mean()) if (yt == 0).any() else None], pa.float64())],
            ["weight", "bias", "threshold", "recall", "false_alarms"],
        )

    return run


def train(documents: DataFrame, labels: DataFrame):
    """The model's row (weight, bias, threshold, and recall and false alarms on the held-out part), or None."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    taken = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS) for t in (0, 1)]
    sample = ids_and_text(documents).join(F.broadcast(taken[0].unionByName(taken[1])), "doc_id").select("doc_id", "text", "toxic")
    features = sample.mapInArrow(_featurise, "doc_id bigint, toxic int, features binary")
    return features.repartition(1).mapInArrow(_train(n[1] / (n[0] + n[1])), "weight binary, bias double, threshold double, recall double, false_alarms double").first()


def _score(weights, bias: float, cut: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, features = np.frombuffer(weights.value, np.float32), Features()
        for batch in T.batches(rows):
            score = np.array([float(weight[f].sum()) + bias if len(f) else -np.inf for f in features.of(batch.column("text"))])
            hit = np.flatnonzero(score >= cut)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(hit)), pa.array(1 / (1 + np.exp(-np.clip(score[hit], -30, 30))))], ["doc_id", "score"])

    return run


def toxic_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(documents, labels)
    if model is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, score double")
    weights = documents.sparkSession.sparkContext.broadcast(bytes(model["weight"]))
    found = ids_and_text(documents).mapInArrow(_score(weights, model["bias"], model["threshold"]), "doc_id bigint, score double")
    return found.groupBy("doc_id").agg(F.round(F.max("score"), 4).alias("score"))
