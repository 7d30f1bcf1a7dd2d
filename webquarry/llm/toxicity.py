"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning takes a bounded sample of labelled rows (`train_rows`, about as many are kept, by a hash of
their id) in one task; per-coordinate rates and L1 leave few weights, which are broadcast. Scoring is one
map over the whole texts without a shuffle.

Defined cases: a null text counts as empty; an empty text gets the score of the bias alone. Without any
labelled row, or with one class only, the model has the bias only. Repeated labels of a document: the
largest counts. Repeated documents are scored one by one; of those that share a labelled id, the first text in
byte order teaches. Columns of the input other than the id and the
text are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, pieces, table, text_or_empty, word_lists, WordHashes

BITS = 24
TRAIN_ROWS = 8_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.05
#: Words of each n-gram or skip-gram relative to its first, with the multipliers that mix their hashes.
SHAPES = {"bigram": (0, 1), "trigram": (0, 1, 2), "skip1": (0, 2), "skip2": (0, 3)}
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
STEM = 5
THRESHOLD = 0.7


class Features:
    """Hashed features of texts: words, their first five letters, bigrams, trigrams, and pairs over a gap of one or two words."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self.words, self.stems = WordHashes(), WordHashes(stem=STEM)

    def __call__(self, texts: list) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(feature numbers, row of each) by kind, not yet distinct; words of each text."""
        words, counts = word_lists(texts)
        n = len(words)
        rows = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, n)
        s = np.fromiter(map(self.stems.__getitem__, words), np.uint64, n)
        out = [(h >> self.shift, rows), (s >> self.shift, rows)]
        for kind, shape in enumerate(SHAPES.values()):
            span = shape[-1]
            if n <= span:
                continue
            mixed = np.full(n - span, MIX[3] * (kind + 1) & (2**64 - 1), np.uint64)
            for k, at in enumerate(shape):
                mixed = (mixed ^ h[at : n - span + at]) * np.uint64(MIX[k])
                mixed ^= mixed >> np.uint64(29)
            same = rows[: n - span] == rows[span:]
            out.append(((mixed * np.uint64(MIX[0]))[same] >> self.shift, rows[: n - span][same]))
        return out, counts


class Ftrl:
    """FTRL-proximal (McMahan et al. 2013) with a rate for each coordinate; features are present or not."""

    def __init__(self, bits: int = BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros(2**bits, np.float32), np.zeros(2**bits, np.float32)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids: np.ndarray) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / rate, 0).astype(np.float32)

    def bias(self) -> float:
        return -self.bias_z * self.alpha / (self.beta + math.sqrt(self.bias_n))

    def learn(self, ids: np.ndarray, label: int) -> None:
        w = self.weights(ids)
        p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum()) + self.bias()))))
        g = p - label
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + g * g
        b = self.bias()
        self.bias_z += g - (math.sqrt(self.bias_n + g * g) - math.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += g * g


def learned(rows: list, epochs: int, bits: int) -> Ftrl:
    model = Ftrl(bits)
    for _ in range(epochs):
        for found, label in rows:
            model.learn(found, label)
    return model


def margins(model: Ftrl, rows: list) -> np.ndarray:
    return np.array([float(model.weights(found).sum()) + model.bias() for found, _ in rows])


def best_margin(scores: np.ndarray, y: np.ndarray) -> float:
    """The margin above which F0.5 (precision counts more) is largest; between two neighbours."""
    order = np.argsort(-scores, kind="stable")
    hits, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    k = int((1.25 * hits / (n + 0.25 * max(1, y.sum()))).argmax())
    return float(scores[order[k]] + scores[order[min(k + 1, len(y) - 1)]]) / 2


def fit(ids: list[int], texts: list, labels: list[int], epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and weights of the features that L1 left, and the bias.

    Features of one row only are left out. Rows go by a hash of their id, so any order of arrival gives the
    same weights. The bias is moved so that the threshold falls on the best margin of two held-in halves;
    it is never moved against a document.
    """
    order = sorted(range(len(ids)), key=lambda k: (ids[k] * 0x9E3779B97F4A7C15 & (2**64 - 1), ids[k], texts[k] or "", labels[k]))
    features, rows, often = Features(bits), [], np.zeros(2**bits, np.uint16)
    for k in order:
        found, _ = features([texts[k]])
        found = np.unique(np.concatenate([x for x, _ in found])).astype(np.uint32)
        often[found] += often[found] < 9
        rows.append((found, labels[k]))
    rows = [(x[often[x] > 1], label) for x, label in rows]
    y = np.array([label for _, label in rows])
    model = learned(rows, epochs, bits)
    shift = 0.0
    if min(y[::2].sum(), y[1::2].sum()) > 1:
        held = np.zeros(len(rows))
        for k in (0, 1):
            held[k::2] = margins(learned(rows[1 - k :: 2], epochs, bits), rows[k::2])
        shift = max(0.0, math.log(THRESHOLD / (1 - THRESHOLD)) - best_margin(held, y))
    seen = np.flatnonzero(np.abs(model.z) > model.l1)
    w = model.weights(seen)
    keep = w != 0
    return seen[keep].astype(np.int64), w[keep].astype(np.float64), model.bias() + shift


class Scorer:
    def __init__(self, ids: np.ndarray, weights: np.ndarray, bias: float, bits: int = BITS):
        self.dense = np.zeros(2**bits, np.float32)
        self.dense[ids] = weights
        self.bias, self.features = bias, Features(bits)

    def __call__(self, texts: list) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        found, _ = self.features(texts)
        hits, at = [], []
        for x, rows in found:
            keep = self.dense[x] != 0
            hits.append(x[keep])
            at.append(rows[keep])
        if hits and sum(map(len, hits)):
            both = np.unique(np.concatenate(at).astype(np.uint64) << np.uint64(32) | np.concatenate(hits))
            np.add.at(total, (both >> np.uint64(32)).astype(np.int64), self.dense[both & np.uint64(2**32 - 1)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def bucket(doc_id):
    """crc32 of the id as text, mod 3: 1 is held out."""
    return F.crc32(doc_id.cast("string")) % 3


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS):
    """Weights from about train_rows labelled rows outside the held-out third; returns (ids, weights, bias)."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    known = known.filter(place < F.lit(math.ceil((1 << 30) * min(1.0, train_rows / max(n, 1)))))

    def learn(batches):
        ids, texts, y = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            texts += b.column(1).to_pylist()
            y += b.column(2).to_pylist()
        if len(set(y)) > 1:
            found, weights, bias = fit(ids, texts, y, epochs)
        else:
            found, weights, bias = np.zeros(0, np.int64), np.zeros(0), -4.0 if not y or y[0] == 0 else 4.0
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(weights, bias))], ["id", "weight"])

    sample = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = mapped(sample.select("doc_id", "text", "label").repartition(1), learn, "id long, weight double").collect()
    bias = next((r["weight"] for r in rows if r["id"] == -1), -4.0)  # no rows at all for an empty table
    kept = [r for r in rows if r["id"] >= 0]
    return np.array([r["id"] for r in kept], np.int64), np.array([r["weight"] for r in kept]), bias


def score(docs: DataFrame, model) -> DataFrame:
    """docs with a column `score`, 0 to 1; every text whole. An own column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    names = docs.columns
    schema = docs.withColumn("score", F.lit(0.0)).schema
    text = names.index("text")

    def run(batches):
        scorer = Scorer(*shared.value)
        for b in batches:
            scores = np.concatenate([scorer(t) for _, t in pieces(b.column(text))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*names, "score"])

    return mapped(docs, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, train_rows)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (bucket(F.col("doc_id")) == 1).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold, with the columns they came with."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).filter(F.col("score") < THRESHOLD).select(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
