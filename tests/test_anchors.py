"""Quiet serves against the plain filter's."""

from __future__ import annotations

import numpy as np

from spanweave.functions.units import UNIT, us
from spanweave.operators.highlight import HighlightFilter, Hits, Motion
from spanweave.plans import anchors
from spanweave.plans.highlights import motion_index, motion_levels


def scene(r):
    """Spans with one pulse, two or none before them, at all distances; motion in stretches, mostly little."""
    hits, firsts, t = [], [], 8.0
    while t < 120:
        for _ in range(r.integers(0, 3)):
            hits.append(t - r.uniform(1.9, 6.2))
        firsts.append(t)
        for _ in range(r.integers(1, 7)):
            hits.append(t)
            t += r.uniform(0.3, 1.2)
        t += r.uniform(4, 9)
    at = np.sort(r.uniform(0, 140, 1000))
    e = np.repeat(r.choice([0.003, 0.012, 0.02, 0.16], 200, p=[0.6, 0.2, 0.1, 0.1]), 5)
    return sorted(hits), firsts, at, e


def test_quiet_serves(spark):
    r = np.random.default_rng(8)
    scenes = {k: scene(r) for k in range(200)}
    p = spark.createDataFrame([(k, us(t)) for k, (hits, *_) in scenes.items() for t in hits], "stream_id long, ts long")
    rows = spark.createDataFrame([(k, k, 1000 * k + i, us(f), 0) for k, (_, firsts, *_) in scenes.items() for i, f in enumerate(firsts)], "stream_id long, court_id long, event_id long, f long, t0 long")
    e = spark.createDataFrame([(k, us(t), float(v), round(v * 100_000)) for k, (*_, at, es) in scenes.items() for t, v in zip(at, es, strict=True)], "court_id long, ts long, energy double, e5 long")
    levels = motion_levels(e).cache()
    index = motion_index(e, levels)
    want = {}
    for k, (hits, firsts, at, es) in scenes.items():
        flt = HighlightFilter(Hits(hits), Motion(at, es))
        for i, f in enumerate(firsts):
            found = flt._quiet_serve(f, 2.50, 5.75)
            found = flt._quiet_serve(f, 2.16, 2.50) if found is None else found
            if found is not None:
                want[1000 * k + i] = round(found, 4)
    got = {x["event_id"]: round(x["serve_at"] / UNIT, 4) for x in anchors.quiet_serves(rows, p, levels, index).collect()}
    assert len(want) > 40 and got == want
    assert anchors.quiet_serves(rows.limit(0), p, levels, index).count() == 0
