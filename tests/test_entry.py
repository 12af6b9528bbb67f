"""The entry gives the analytic queries whatever library of the training-data package is missing."""

from __future__ import annotations

import sys

import __spark_entry__
from spanweave.plans import catalogue


def test_a_missing_library_costs_only_the_queries_that_need_it(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("spanweave.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for blocked in ("ahocorasick", "spanweave.llm"):
        with monkeypatch.context() as m:
            m.setitem(sys.modules, blocked, None)
            assert set(__spark_entry__.queries()) == set(catalogue.QUERIES) and set(__spark_entry__.oracle_sql()) == set(catalogue.ORACLE)
