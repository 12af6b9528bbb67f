"""The span store: versions, empty and failed analyses, jobs that are under way, writers that meet."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanweave.operators.store import Conflict, SpanStore
from spanweave.plans import analyse
from spanweave.sources import carriers

SPANS = "stream_id long, start double, end double"


def rows(df):
    return sorted(tuple(r[c] for c in ("stream_id", "start", "end")) for r in df.collect())


def ids(spark, *streams):
    return spark.createDataFrame([(i,) for i in streams], "stream_id long")


def spans(spark, *r):
    return spark.createDataFrame(list(r), SPANS)


def test_an_analysis_that_finds_nothing_clears_what_was_there(spark, tmp_path):
    s = SpanStore(spark, str(tmp_path))
    assert s.read() is None
    s.replace(spans(spark, (1, 0.0, 1.0), (2, 0.0, 1.0), (3, 5.0, 6.0)))
    s.replace(spans(spark, (2, 7.0, 8.0)), ids(spark, 1, 2))
    assert rows(s.read()) == [(2, 7.0, 8.0), (3, 5.0, 6.0)]
    s.replace(spans(spark), ids(spark, 2, 3))
    assert rows(s.read()) == []
    s.replace(spans(spark, (9, 1.0, 2.0), (4, 1.0, 2.0)), ids(spark, 4))  # rows of other streams are not taken
    assert rows(s.read()) == [(4, 1.0, 2.0)]


def test_a_reader_holds_one_version(spark, tmp_path):
    s = SpanStore(spark, str(tmp_path))
    s.replace(spans(spark, *((i, 0.0, 1.0) for i in range(100))))
    held, version = s.read(), s.manifest()["version"]
    for _ in range(2):
        s.replace(spans(spark, *((i, 2.0, 3.0) for i in range(100))))
    assert {r[1] for r in rows(held)} == {0.0} and {r[1] for r in rows(s.read(version))} == {0.0} and {r[1] for r in rows(s.read())} == {2.0}
    s.vacuum(keep=1)
    assert s.versions() == [3] and {r[1] for r in rows(s.read())} == {2.0}


def test_a_writer_that_is_overtaken_starts_anew(spark, tmp_path):
    s, other = SpanStore(spark, str(tmp_path)), SpanStore(spark, str(tmp_path))
    s.replace(spans(spark, (1, 0.0, 1.0)))
    met = []

    def change(m):
        if not met:
            met.append(m["version"])
            other.replace(spans(spark, (2, 0.0, 1.0)))
        return s._replaced(m, spans(spark, (3, 0.0, 1.0)), ids(spark, 3))

    s.commit(change)
    assert [r[0] for r in rows(s.read())] == [1, 2, 3]

    def always(m):
        other.replace(spans(spark, (2, 0.0, 1.0)))
        return m

    with pytest.raises(Conflict):
        s.commit(always)


def test_jobs(spark, tmp_path):
    s = SpanStore(spark, str(tmp_path))
    s.register(ids(spark, 1, 2, 3))
    status = lambda: {r["stream_id"]: r["status"] for r in s.jobs().collect()}
    assert status() == dict.fromkeys((1, 2, 3), "uploaded")
    assert sorted(r[0] for r in s.start(ids(spark, 1, 2)).collect()) == [1, 2]
    version = s.manifest()["version"]
    assert s.start(ids(spark, 1, 2)).collect() == [] and s.manifest()["version"] == version  # under way: nothing is done
    assert [r[0] for r in s.start(ids(spark, 2, 3)).collect()] == [3]
    s.finish(ids(spark, 1, 2), spans(spark, (1, 0.0, 1.0)))
    s.finish(ids(spark, 3), spans(spark, (3, 0.0, 1.0)))
    assert status() == dict.fromkeys((1, 2, 3), "completed") and rows(s.read()) == [(1, 0.0, 1.0), (3, 0.0, 1.0)]
    s.start(ids(spark, 1))
    s.fail(ids(spark, 1), "no signal")
    assert status() == {1: "failed", 2: "completed", 3: "completed"} and rows(s.read()) == [(3, 0.0, 1.0)]
    s.register(ids(spark, 1, 4))
    assert status()[1] == "failed" and status()[4] == "uploaded"


def test_an_analysis_that_breaks_clears_and_marks_its_streams(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    few = carriers.pulses(spark, sf).select("stream_id").distinct().where("stream_id < 20")
    plain = analyse.Stages(refine=None)
    done = analyse.analyse_and_store(spark, sf, str(tmp_path), plain, few)
    s = SpanStore(spark, str(tmp_path))
    assert done.count() == few.count() and s.read().count() > 10 and {r["status"] for r in s.jobs().collect()} == {"completed"}

    def broken(*_):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        analyse.analyse_and_store(spark, sf, str(tmp_path), analyse.Stages(refine=broken), few)
    assert s.read().count() == 0 and {tuple(r) for r in s.jobs().select("status", "note").collect()} == {("failed", "no model")}
    cut = few.withColumn("duration", F.lit(10**15))  # all spans begin later
    analyse.analyse_and_store(spark, sf, str(tmp_path), plain, few, cut)
    assert s.read().count() == 0 and {r["status"] for r in s.jobs().collect()} == {"completed"}
