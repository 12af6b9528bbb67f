"""Near-dedup against brute force."""

from __future__ import annotations

import itertools
import random
from collections import defaultdict

import corpus_pipeline

from spanweave.llm import jaccard

from .conftest import prose


def shingles(text: str | None) -> frozenset:
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups_of(texts: list[str | None], alike) -> list[list[int]]:
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if alike(texts[i], texts[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for i in range(len(texts)):
        out[root(i)].append(i)
    return list(out.values())


def near(a: str | None, b: str | None) -> bool:
    a, b = shingles(a), shingles(b)
    return a == b or 100 * len(a & b) >= 80 * len(a | b)


def near_copies() -> list[str | None]:
    """Copies with up to 14 changed words, chains of them, a large group, and a passage that many texts share."""
    r = random.Random(12)
    base = [prose(r, n) for n in (3, 30, 60, 120, 120, 250, 400)]
    texts: list[str | None] = [None, "", " \n", *base]
    for k in range(90):
        words = r.choice(base[1:] if k % 3 else texts[9:]).split(" ")
        for _ in range(r.randint(0, 7)):
            words[r.randrange(len(words))] = f"new{k}"
        texts.append(" ".join(words))
    passage = prose(r, 50)
    texts += [prose(r, 40) + " " + passage for _ in range(20)]
    return texts + [base[3].upper(), "  ".join(base[4].split())]


def test_stage_keeps_one_of_each_group_by_jaccard(spark, tmp_path):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, str(tmp_path)).collect())
    groups = groups_of(texts, near)
    assert got == sorted(g[0] for g in groups) and 20 < len(got) < len(texts) - 30


def test_stage_keeps_each_group_without_an_id(spark, tmp_path):
    r = random.Random(13)
    base = [prose(r, 80) for _ in range(6)]
    rows = [(None, t) for t in base] + [(None, base[0] + " more"), (None, base[1]), (7, base[2] + " more"), (8, base[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in got if x["doc_id"] is not None) == [7, 8]
    kept = [x["text"] for x in got if x["doc_id"] is None]
    assert len(kept) == 4 and all(sum(near(t, k) for k in kept) == 1 for t in (base[0], base[1], base[4], base[5]))


def alike() -> list[str]:
    """Versions of one long text that are just too different from each other, and some that are not."""
    r = random.Random(14)
    base = [f"b{k}" for k in range(1000)]
    texts = []
    for k in range(60):
        words = list(base)
        for at in r.sample(range(199), 14):
            words[5 * at + 2] = f"new{k}_{at}"
        texts.append(" ".join(words))
    return texts + [f"{t} and an end" for t in texts[::9]]


def test_texts_that_are_only_alike_are_not_listed_in_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 9_000, raising=False)
    stage, rows = jaccard.stage, []

    def counted(df, name):
        out = stage(df, name)
        if out.columns == ["u", "v"]:
            rows.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stage", counted)
    texts = alike()
    sets = [shingles(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect())
    assert got == sorted(g[0] for g in groups_of(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))) and 50 < len(got) <= 60
    assert rows[-1] < len(texts) and rows[4] < 4 * len(texts), rows  # before: each pair of them


def test_tiles_link_the_parts_that_a_family_holds(spark, tmp_path, monkeypatch):
    """Without the two rounds before, all links come from families."""
    monkeypatch.setattr(jaccard, "TILE", 2_000)
    monkeypatch.setattr(jaccard, "_confirmed", lambda pairs, sets, least: pairs.where("false"))
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = sorted(r["doc_id"] for r in jaccard.keep_one(docs).collect())
    assert got == sorted(g[0] for g in groups_of(texts, near))
