"""Peels against the plain filter's, span by span."""

from __future__ import annotations

import numpy as np
import pytest

from spanweave.functions.units import UNIT, us
from spanweave.operators.highlight import HighlightFilter, Hits, Motion, Span
from spanweave.plans import peels
from spanweave.plans.highlights import motion_index, motion_levels

LEVELS = np.array([0.003, 0.012, 0.02, 0.05, 0.16])
WIDE = 90


def scene(r):
    """Dense blobs with rests of all lengths, some with a slow last step; motion in short stretches, here and there no samples at all."""
    hits, lively, t = [], [], r.uniform(0.6, 3)
    while t < WIDE:
        n = r.integers(5, 22)
        pace = r.choice([0.25, 0.5])
        for _ in range(n):
            hits.append(t)
            t += r.uniform(1.0, 1.5) if r.random() < 0.08 else pace * r.uniform(0.6, 1.5)
        if r.random() < 0.5:
            hits[-1] = hits[-2] + r.uniform(1.02, 1.43)
            t = hits[-1]
        if r.random() < 0.3:
            lively.append((hits[-n + r.integers(1, 3)] - 0.1, hits[-1] - r.uniform(0, 2)))
        t += r.choice([r.uniform(1.9, 3.1), r.uniform(3.3, 5), r.uniform(5.2, 9)])
    at = np.sort(r.uniform(0, WIDE + 10, 8 * WIDE))
    step = r.choice([2, 4, 9])
    e = np.repeat(r.choice(LEVELS, len(at) // step + 1, p=[0.5, 0.1, 0.1, 0.15, 0.15]), step)[: len(at)]
    e = np.where(r.random(len(e)) < 0.15, 0.003, e)
    for a, b in lively:  # blobs whose first one or two pulses are from outside
        e = np.where((at > a) & (at < b), 0.05, np.where((at > a - 1.5) & (at <= a), 0.003, e))
    there = np.ones(len(at), bool)
    for a in r.uniform(0, WIDE, 3):
        there &= ~((at > a) & (at < a + 2.5))
    return hits, at[there], e[there]


@pytest.fixture(scope="module")
def scenes():
    r = np.random.default_rng(5)
    return {k: scene(r) for k in range(250)}


@pytest.fixture(scope="module")
def frames(spark, scenes):
    p = spark.createDataFrame([(k, k, us(t), 1000 * k + i, 0) for k, (hits, *_) in scenes.items() for i, t in enumerate(hits)], "stream_id long, court_id long, ts long, event_id long, t0 long")
    e = spark.createDataFrame([(k, us(t), float(v), round(v * 100_000)) for k, (_, at, es) in scenes.items() for t, v in zip(at, es, strict=True)], "court_id long, ts long, energy double, e5 long")
    levels = motion_levels(e).cache()
    return p, e, levels, motion_index(e, levels)


def plain(scenes, peel):
    out = set()
    for k, (hits, at, e) in scenes.items():
        flt = HighlightFilter(Hits(hits), Motion(at, e))
        for g in np.split(np.array(hits), np.flatnonzero(np.diff(hits) > 1.85) + 1):
            x = getattr(flt, peel)(Span(g[0] - 1.05, g[-1] + 0.6, float(g[0]), float(g[-1])))
            if x is not None:
                out.add((k, *(round(float(v), 4) for v in (g[0], x.start, x.end, x.first, x.last))))
    return out


def found(rows):
    return {(r["stream_id"], *(round(r[c] / UNIT, 4) for c in ("span_first", "start_at", "end_at", "first_at", "last_at"))) for r in rows}


@pytest.mark.parametrize("how", ["court", "core"])
def test_court_peels(frames, scenes, how):
    p, _, _, index = frames
    rows = peels.court_peels(p, index).where(f"how = '{how}'").collect()
    want = plain(scenes, f"peel_{how}")
    assert len(want) > 30 and found(rows) == want


def test_last_serve(frames, scenes):
    want = plain(scenes, "peel_serve")
    ends = {round(x[3] - x[5], 2) for x in want}
    assert len(want) > 60 and len(ends) > 20 and found(peels.serve_peels(*frames).collect()) == want


def test_empty_tables(spark, frames):
    p, e, levels, index = frames
    none = p.limit(0)
    assert peels.court_peels(none, index).count() == 0 and peels.serve_peels(none, e, levels, index).count() == 0
    bare = motion_index(e.limit(0), levels.limit(0))
    assert peels.serve_peels(p, e.limit(0), levels.limit(0), bare).count() == 0
