"""Substring dedup with ids beyond 32 bits."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spanweave.llm import substring
from spanweave.llm.shared import find_words, gram_hashes, word_hashes

from .conftest import prose


@pytest.mark.parametrize("ids", [(2**33 + 5, 2**33 + 9, 2**34 + 1), (3_000_000_000, 3_000_000_001, 2**33), (2**31 - 1, 2**31, 2**32), (-(2**40), 1, 2**40)])
def test_first_document_keeps_its_passage(spark, ids):
    r = random.Random(3)
    passage = prose(r, 40)
    docs = spark.createDataFrame([(i, f"{prose(r, 5)} {passage}") for i in ids], "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in substring.digest(docs).collect()}
    assert got[ids[0]] == 0 and all(got[i] >= 40 for i in ids[1:])


def anchor_of(words: list[str]) -> int:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = find_words(data, np.array([0, len(data)]))
    return int(gram_hashes(word_hashes(data, starts, ends), len(words))[0])


def test_a_heavy_anchor_and_many_copies(spark, monkeypatch):
    """One five-word run that is the anchor of very many different windows, and a group of equal texts."""
    monkeypatch.setattr(substring, "SHARD_WORDS", 200)
    common = " ".join(min(([f"c{k}{j}" for j in range(5)] for k in range(3000)), key=anchor_of))  # its hash is least in nearly every window
    r = random.Random(3)
    texts = [" ".join([*(f"x{r.randrange(40)}" for _ in range(12)), common, *(f"y{r.randrange(40)}" for _ in range(12))]) for _ in range(60)]
    texts += texts[:10] + [texts[k] + " and more words behind it all" for k in range(20)] + [texts[5]] * 400
    words = [t.split() for t in texts]
    first: dict[tuple, int] = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {i: len({x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}) for i, w in enumerate(words)}
    docs = spark.createDataFrame([(2**40 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] - 2**40: r["n_removed"] for r in substring.digest(docs).collect()} == want
