"""The classifier's training against plain updates."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanweave.llm import classifier

from .conftest import prose


def test_a_small_sample_is_passed_as_often_as_a_large_one(spark):
    r = random.Random(4)
    rows = [(i, prose(r, 30) + " junk" * (i % 2), 1 - i % 2) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = classifier.train(docs.drop("quality"), docs.drop("text"), epochs=3)
    taken = docs.where(~classifier.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id", F.lit(12))).collect()
    ones = sum(x["quality"] for x in taken)
    weight = [len(taken) / 2 / (len(taken) - ones), len(taken) / 2 / ones]
    rows = list(classifier._each(pa.array([x["text"] for x in taken]), classifier.ORDER, classifier.BUCKETS))
    plain = PlainFtrl()
    for _ in range(3):
        for x, (idx, n) in zip(taken, rows, strict=True):
            plain.learn(plain_inputs(idx.tolist(), n), x["quality"], weight[x["quality"]])
        plain.learn({classifier.BUCKETS: 1.0}, 0, 1.0)
    want = np.zeros(classifier.BUCKETS + classifier.EXTRA, np.float32)
    for k in plain.z:
        want[k] = plain.weight(k)
    assert np.allclose(got, want, rtol=1e-5, atol=1e-7) and (got != 0).sum() > 50
    # scores by the same plain sums
    texts = docs.unionByName(spark.createDataFrame([(100, None, 1), (101, " \n", 0)], docs.schema)).drop("quality")
    scores = {x["doc_id"]: x["score"] for x in classifier.score(texts, got).collect()}
    for x in texts.collect():
        ((idx, n),) = classifier._each(pa.array([x["text"]], pa.string()), classifier.ORDER, classifier.BUCKETS)
        total = sum(float(got[k]) * v for k, v in plain_inputs(idx.tolist(), n).items())
        assert math.isclose(scores[x["doc_id"]], 1 / (1 + math.exp(-total)), rel_tol=1e-5)
    assert scores[100] == scores[101] < 0.5


def plain_inputs(idx: list[int], n_words: int) -> dict[int, float]:
    if not n_words:
        return {classifier.BUCKETS: 1.0}
    out = {i: len(idx) ** -0.5 for i in idx}
    out |= {classifier.BUCKETS + k: 0.3 for k in range(1, 13) if n_words < 2**k}
    return out | {classifier.BUCKETS + 13: len(idx) / (len(idx) + 100)}


class PlainFtrl:
    """FTRL-proximal one coordinate at a time."""

    def __init__(self):
        self.z, self.n = defaultdict(float), defaultdict(float)

    def weight(self, k: int) -> float:
        if abs(self.z[k]) <= 0.02:
            return 0.0
        return -(self.z[k] - math.copysign(0.02, self.z[k])) / ((1 + math.sqrt(self.n[k])) / 0.5 + 0.5)

    def learn(self, x: dict[int, float], label: int, weight: float) -> None:
        w = {k: self.weight(k) for k in x}
        p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
        for k, v in x.items():
            g = (p - label) * weight * v
            self.z[k] += g - (math.sqrt(self.n[k] + g * g) - math.sqrt(self.n[k])) / 0.5 * w[k]
            self.n[k] += g * g
