"""What of a shard goes through its automaton."""

from __future__ import annotations

import random

from spanweave.llm import substring

from .conftest import prose


class Rows:
    """Stands for the rows of all shards, of which it keeps how they are read."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_whole_phrases_of_earlier_documents_need_no_automaton(spark, monkeypatch):
    r = random.Random(8)
    passage = prose(r, 300, 5000)
    docs = spark.createDataFrame([(i, f"{prose(r, 20, 5000)} {passage} {prose(r, 20, 5000)}") for i in range(12)], "doc_id long, text string")
    located, made, compiled = substring._locate, [], substring._compile

    def spied(rows, width):
        made.append(rows.toArrow())
        return located(rows, width)

    def counted(windows, width):
        made.append(sum(lo < hi for lo, hi in windows.values()))
        return compiled(windows, width)

    monkeypatch.setattr(substring, "_locate", spied)
    got = {x["doc_id"]: x["n_removed"] for x in substring.digest(docs).collect()}
    assert got[0] == 0 and all(300 <= got[i] < 310 for i in range(1, 12))
    monkeypatch.setattr(substring, "_compile", counted)
    reader = Rows()
    located(reader, substring.WIDTH)
    assert sum(b.num_rows for b in reader.run(iter(made[0].combine_chunks().to_batches()))) > 11
    assert sum(made[1:]) < 60, made[1:]  # of some 288 windows of the passage only those beside its ends
