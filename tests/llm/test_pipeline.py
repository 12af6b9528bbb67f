"""The pipeline's stages, each on its own input, against brute force; clashing extra columns; empty tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from spanweave.llm import classifier
from spanweave.llm.queries import TOKENIZERS
from spanweave.llm.shared import stage, table

from .test_near_copies import groups_of, shingles
from .test_queries import WORD

EXTRA = ("size", "target", "source_size", "score", "count", "spans", "component_id", "label", "quality", "draw", "u", "v", "fp", "rep", "copies", "first", "th", "anchor", "node", "taken", "w", "n")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark, small):
    docs = table(spark, small, "documents")
    for name in EXTRA:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], small), name))
    return out


def test_columns_are_kept(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns[: len(stages[0].columns)] == stages[0].columns
    for df in stages[1:]:
        for r in rows_of(df):
            assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for c in EXTRA)


def test_classifier_stage(spark, small, stages):
    weights = classifier.train(stages[0], table(spark, small, "labels"))
    want = Counter((r["doc_id"], r["text"]) for r in rows_of(classifier.score(stages[0].select("doc_id", "text"), weights)) if r["score"] >= 0.5)
    assert Counter((r["doc_id"], r["text"]) for r in rows_of(stages[1])) == want
    junk = [r for r in rows_of(stages[0]) if any(c in (r["text"] or "") for c in "#$&")]
    assert sum(want[r["doc_id"], r["text"]] for r in junk) < len(junk) / 4


def test_near_dedup_stage(stages):
    """The stage takes five words and a similarity of 0.8: groups by brute force over whole sets."""
    before, after = rows_of(stages[1]), rows_of(stages[2])
    sets = [shingles(r["text"]) for r in before]

    def alike(i, j):
        return sets[i] == sets[j] or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])

    ids = [[before[i]["doc_id"] for i in g] for g in groups_of(list(range(len(before))), alike)]
    want = {min((x for x in g if x is not None), default=None) for g in ids}
    assert Counter(r["doc_id"] for r in after) == Counter(want)


def test_substring_stage(stages):
    before, after = rows_of(stages[2]), {r["doc_id"]: r for r in rows_of(stages[3])}
    first: dict[tuple, int] = {}
    words = {r["doc_id"]: WORD.findall(r["text"] or "") for r in before}
    for i, w in words.items():
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, 10**18), 10**18 if i is None else i)
    cut_any = 0
    for r in before:
        i, w = r["doc_id"], words[r["doc_id"]]
        cut = {x for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        cut_any += bool(cut)
        got = after[i]["text"]
        assert WORD.findall(got or "") == [x for k, x in enumerate(w) if k not in cut]
        if not cut:
            assert got == r["text"] and after[i]["n_chars"] == r["n_chars"]
        else:
            assert after[i]["n_chars"] == len(got)
    assert cut_any >= 3 and len(after) == len(before)


def test_mixing_stage(stages):
    before, after = rows_of(stages[3]), Counter(r["doc_id"] for r in rows_of(stages[4]))
    sizes = defaultdict(int)
    for r in before:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert set(after) <= {r["doc_id"] for r in before} and max(after.values()) <= 2
    taken = sum(len(WORD.findall(r["text"] or "")) * after[r["doc_id"]] for r in before)
    assert 0.5 * sum(sizes.values()) < taken <= 2 * sum(sizes.values())


def test_piece_stage(stages):
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    rows = rows_of(stages[5])
    assert len(rows) == stages[4].count()
    for r in rows:
        if r["text"] is not None and "▁" not in r["text"]:
            assert r["ids"] == sp.encode(r["text"]) and r["n_tokens"] == len(r["ids"])


def test_run_and_empty(spark, small, empty, stages):
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.run(spark, small).count() == stages[5].count()
