"""Golden vectors of grouping, bridges and groups off the court (seconds as units of the carrier)."""

from __future__ import annotations

import pytest

from spanweave.functions.units import us
from spanweave.plans import refine


def frames(spark, pulses, energy, base=0.002, until=20.0):
    """``pulses`` in seconds; ``energy`` as (level, from, to) over a base on a grid of a tenth."""
    p = spark.createDataFrame([(1, 1, us(t), 1.0, i) for i, t in enumerate(pulses)], "stream_id long, court_id long, ts long, height double, event_id long")
    rows = []
    lo = min(pulses) - 1.0
    for k in range(int((max(until, max(pulses) + 2) - lo) * 10)):
        t = round(lo + k / 10, 3)
        level = next((x for x, a, b in energy if a <= t <= b), base)
        rows.append((1, us(t), level, round(level * 100_000)))
    return p, spark.createDataFrame(rows, "court_id long, ts long, energy double, e5 long")


def grouped(spark, pulses, energy):
    p, e = frames(spark, pulses, energy)
    g = refine.groups(refine.classify(p, e), e).orderBy("f").collect()
    return [(round(r["f"] / us(1.0), 3), round(r["l"] / us(1.0), 3)) for r in g]


@pytest.mark.parametrize("pulses,energy,want", [
    ([1, 1.5, 2, 10, 10.5, 11], [(0.035, 0.7, 2.3)], [(1.0, 2.0)]),  # only the court's pulses make a group
    ([1, 1.8, 2.5, 6.7, 7.4, 8.1], [(0.04, 0.6, 8.6)], [(1.0, 8.1)]),  # a hole full of motion
    ([1, 1.8, 2.4, 12, 12.8, 13.5], [(0.04, 0.6, 3.0), (0.04, 11.5, 14.0)], [(1.0, 2.4), (12.0, 13.5)]),  # dead time
    ([1, 1.6, 2.2, 2.9, 3.5], [(0.04, 0.8, 4.0)], [(1.0, 3.5)]),
])
def test_groups(spark, pulses, energy, want):
    assert grouped(spark, pulses, energy) == want


def test_far_exchange_is_peeled_and_blob_is_dropped(spark):
    peel = [465.00, 473.88, 476.25, 478.096, 478.65, 480.35, 484.19]
    blob = [461.88, 467.73, 468.26, 469.51, 470.95, 471.68, 472.90, 473.88, 476.25]
    for pulses, verdict, first in ((peel, "peel", 478.096), (blob, "drop", None)):
        p, e = frames(spark, pulses, [], base=0.003)
        c = refine.classify(p, e).withColumn("in_court", refine.F.lit(False))
        rows = {round(r["f"] / us(1.0), 3): r for r in refine.zero_court(c).collect() if r["n"] >= 3}
        (row,) = rows.values()
        assert row["verdict"] == verdict
        if first:
            group = [t for t in pulses if row["f"] <= us(t) <= row["l"]]
            assert group[row["tail_from"]] == first
