"""The analysis with its stages replaced and switched off, stored twice."""

from __future__ import annotations

from spanweave.operators.store import read_streams
from spanweave.plans import analyse, scorer
from spanweave.sources import carriers

SF = "/root/testdata/sf0.001"


def test_stages_can_be_switched_off_and_replaced(spark, tmp_path):
    p, e, t = (f(spark, SF) for f in (carriers.pulses, carriers.energy, carriers.track))
    bare = analyse.analyse(p, e, t, analyse.Stages(refine=None, least_gap=None, merge_gap=-1))
    assert bare.agg({"n": "sum"}).first()[0] == scorer.rallies(p).count()
    none = analyse.analyse(p, e, t, analyse.Stages(refine=None, keep=lambda r, pulses: r.where("false")))
    assert none.count() == 0
    path = str(tmp_path / "store")
    for _ in range(2):
        analyse.analyse_and_store(spark, SF, path)
    want = sorted(map(tuple, analyse.analyse(p, e, t).collect()))
    assert sorted(map(tuple, read_streams(spark, path).select("stream_id", "number", "start", "end", "n").collect())) == want and len(want) > 50
