"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

A document's features are the hashed 1- to ``order``-grams of its words, each present or not, scaled to unit length, and a few for
its length (which of the first powers of two its words stay below: a bias of its own for short texts).  A score is one sparse dot
product through the logistic function.  Training reads a bounded sample of the labelled rows (``per_class`` of each
class, chosen by hash) in one task and keeps one weight table; scoring reads every whole text and needs no shuffle.
Labels, language, source and id are never inputs.

A text without words has one feature of its own; every pass of the training ends with one such text of label 0, as it holds nothing to keep.

Defined results
* null, empty or blank text: a score below 0.5 (0.5 if nothing was trained);
* null or other quality labels are skipped; labels of one document that disagree count as 1;
* with one class the model is what its updates make of the sample; without labelled rows every score is 0.5;
* repeated rows score alike; extra columns of any name are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import blocks, find_words, fresh, gram_hashes, quoted, wider, word_hashes

BUCKETS, ORDER = 1 << 18, 2
#: Features of length, after the buckets: the text has fewer than 2 ** k words (the first: none).  The bias is the last.
LENGTHS, LENGTH_INPUT = 13, 0.3
EXTRA = LENGTHS + 1


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 3, is 1 (a null id is in no fold: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(h: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """Distinct buckets of one document's n-grams."""
    return np.unique(np.concatenate([gram_hashes(h, k) % np.uint64(buckets) for k in range(1, order + 1)]).astype(np.int64))


def _each(text: pa.Array, order: int, buckets: int) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets and number of words of each text."""
    for _, _, data, off in blocks(text):
        starts, ends, counts = find_words(data, off)
        h = word_hashes(data, starts, ends)
        at = 0
        for n in counts.tolist():
            yield _features(h[at : at + n], order, buckets), n
            at += n


def inputs(idx: np.ndarray, n_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of a text with these buckets."""
    if not n_words:
        return np.array([buckets]), np.ones(1)
    short = [buckets + k for k in range(1, LENGTHS) if n_words < 1 << k]
    x = np.concatenate((np.full(len(idx), 1.0 / np.sqrt(max(1, len(idx)))), np.full(len(short), LENGTH_INPUT), [_bias_input(len(idx))]))
    return np.concatenate((idx, short, [buckets + LENGTHS])).astype(np.int64), x


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, x))))


def _bias_input(n: int) -> float:
    """The bias counts less in texts with few features, whose sums are small: what is missing there speaks for no class."""
    return n / (n + 100.0)


class Ftrl:
    """Per-coordinate FTRL-proximal (McMahan et al., 2013) over ``size`` coordinates."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, idx: np.ndarray, x: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(idx)
        g = (_sigmoid(float(w @ x)) - label) * weight * x
        sigma = (np.sqrt(self.n[idx] + g * g) - np.sqrt(self.n[idx])) / self.alpha
        self.z[idx] += g - sigma * w
        self.n[idx] += g * g


def train(docs: DataFrame, labels: DataFrame, per_class: int = 6000, epochs: int = 6, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """The weight table (float32, ``buckets + EXTRA``), from at most ``per_class`` labelled documents of each class outside the held-out fold.

    The chosen ids (a bounded table) are broadcast, so the documents are scanned once and not shuffled.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label")).withColumn("draw", F.xxhash64("doc_id", F.lit(11)))
    chosen = known.where("label = 0").orderBy("draw", "doc_id").limit(per_class).unionByName(known.where("label = 1").orderBy("draw", "doc_id").limit(per_class))
    # another hash gives the order of training: by draw the classes would not be mixed, as one is drawn from deeper than the other
    chosen = chosen.select(F.col("doc_id").alias("id"), "label", F.xxhash64("doc_id", F.lit(12)).alias("draw"))
    texts = docs.select("doc_id", "text")
    sample = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["id"]).select("draw", "label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_each(b.column(2), order, buckets))
            idx = pa.array([x.astype(np.int32) for x, _ in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array([n for _, n in rows], pa.int64()), idx], names=["draw", "label", "n", "idx"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            idx = b.column(3)
            rows += [(label, n, idx[k].values.to_numpy()) for k, (label, n) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))]
        model = Ftrl(buckets + EXTRA)
        ones = sum(label for label, _, _ in rows)
        weight = [len(rows) / 2 / max(1, n) for n in (len(rows) - ones, ones)]  # both classes count alike
        for _ in range(epochs):
            for label, n, idx in rows:
                model.learn(*inputs(idx, n, buckets), label, weight[label])
            model.learn(*inputs(idx[:0], 0, buckets), 0)
        w = model.weights(np.arange(buckets + EXTRA)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    made = sample.mapInArrow(features, "draw long, label int, n long, idx array<int>").repartition(1).sortWithinPartitions("draw", "label", F.hash("idx"))
    row = made.mapInArrow(fit, "w binary").first()  # an empty sample has no task that fits
    return np.frombuffer(row["w"], np.float32) if row else np.zeros(buckets + EXTRA, np.float32)


def score(docs: DataFrame, weights: np.ndarray, column: str = "score", order: int = ORDER) -> DataFrame:
    """``docs`` with a score from 0 to 1 of every whole text as last column (instead of a column of that name)."""
    names = [c for c in docs.columns if c != column]
    buckets = len(weights) - EXTRA
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # buckets + EXTRA floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            x = np.array([w[at] @ x for at, x in (inputs(idx, n, buckets) for idx, n in _each(b.column(b.schema.names.index("text")), order, buckets))])
            s = 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(s, pa.float64())], names=[*names, column])

    picked = docs.select(*map(quoted, names))
    return picked.mapInArrow(run, wider(picked.schema, **{column: T.DoubleType()}))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **parameters) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    (column,) = fresh(docs, "quality_score")
    scored = score(docs, train(docs, labels, **parameters), column)
    return scored.where(F.col(column) >= least).select(*map(quoted, docs.columns))
