"""Rows without an id as links between others."""

from __future__ import annotations

from spanweave.llm import simhash


def test_a_fingerprint_without_an_id_still_links(spark, monkeypatch):
    prints = {"a": 0b0011, "between": 0b1111, "b": 0b111111, "far": 1 << 40 | 1 << 50 | 1 << 60, "alone": 0x0FF00FF000000000}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **_: spark.createDataFrame([(5, prints["a"]), (None, prints["between"]), (None, prints["between"]), (9, prints["b"]), (None, prints["far"]), (None, prints["alone"]), (3, prints["alone"])], "doc_id long, fp long"))
    got = sorted((r["doc_id"] or 0, r["fp"], r["component_id"] or 0) for r in simhash.near_duplicates(spark.range(1)).collect())
    assert got == sorted([(5, 3, 5), (0, 15, 5), (0, 15, 5), (9, 63, 5), (0, prints["far"], 0), (0, prints["alone"], 3), (3, prints["alone"], 3)])
