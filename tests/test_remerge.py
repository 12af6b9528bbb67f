"""The re-merge fold against the plain filter's, with every branch of both."""

from __future__ import annotations

import numpy as np
import pytest

from spanweave.functions.units import UNIT, us
from spanweave.operators.highlight import HighlightFilter, Hits, Motion, Span
from spanweave.plans import remerge

LEVELS = np.array([0.004, 0.012, 0.02, 0.05, 0.16])


def scene(r, wide):
    """Pulses in bursts with holes of all lengths, motion in stretches, and spans cut at random holes."""
    hits, t = [], r.uniform(0.3, 3)
    while t < wide:
        for _ in range(r.integers(1, 8)):
            hits.append(t)
            t += r.choice([r.uniform(0.09, 0.25), r.uniform(0.3, 0.8), r.uniform(0.7, 1.3)], p=[0.35, 0.45, 0.2])
        t += r.choice([r.uniform(0.01, 0.2), r.uniform(0.8, 2.3), r.uniform(1.8, 3.6), r.uniform(3.0, 5.7), r.uniform(5, 9)], p=[0.2, 0.25, 0.2, 0.25, 0.1])
    at = np.sort(r.uniform(0, wide + 5, int(8 * wide)))
    step = r.choice([8, 40])
    e = np.concatenate([np.full(step, r.choice(LEVELS, p=[0.35, 0.2, 0.2, 0.1, 0.15])) for _ in range(len(at) // step + 1)])[: len(at)]
    quiet = r.random(len(e)) < 0.3
    e = np.where(quiet, 0.003, e)
    cuts = [0, *(k for k in range(1, len(hits)) if hits[k] - hits[k - 1] > 0.8 or r.random() < 0.12), len(hits)]
    lead, trail = r.choice([1.05, 0.2]), r.choice([0.6, 0.1])
    spans = [Span(hits[a] - lead, hits[b - 1] + trail, hits[a], hits[b - 1], 0.5 + 0.01 * a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return hits, at, e, spans


@pytest.fixture(scope="module")
def merged(spark):
    r = np.random.default_rng(11)
    scenes = {k: scene(r, 60) for k in range(450)}
    p = spark.createDataFrame([(k, k, us(t), i) for k, (hits, *_) in scenes.items() for i, t in enumerate(hits)], "stream_id long, court_id long, ts long, event_id long")
    e = spark.createDataFrame([(k, us(t), float(v), round(v * 100_000)) for k, (_, at, es, _) in scenes.items() for t, v in zip(at, es, strict=True)], "court_id long, ts long, energy double, e5 long")
    s = spark.createDataFrame([(k, k, us(x.start), us(x.end), us(x.first), us(x.last), x.confidence) for k, (*_, spans) in scenes.items() for x in spans], "stream_id long, court_id long, s long, e long, f long, l long, conf double")
    got: dict = {k: [] for k in scenes}
    for x in remerge.remerge(remerge.items(s, p, e).selectExpr("*", "0L AS t0")).collect():
        got[x["stream_id"]].append((x["s"] / UNIT, x["e"] / UNIT, x["f"] / UNIT, x["l"] / UNIT, x["conf"], x["how"]))
    return scenes, got


def test_the_fold_gives_what_the_plain_filter_gives(merged):
    scenes, got = merged
    wrong = 0
    for k, (hits, at, e, spans) in scenes.items():
        want = [(x.start, x.end, x.first, x.last, x.confidence) for x in HighlightFilter(Hits(hits), Motion(at, e)).remerge(spans)]
        mine = [x[:5] for x in sorted(got[k])]
        wrong += len(want) != len(mine) or not np.allclose(sorted(want), mine, atol=1e-6)
    assert wrong == 0


@pytest.mark.parametrize("branch", ["M0", "M1", "M2", "M3", "M4", "M5", "M6", "M7", "M8", "M9", "rest", "apart"])
def test_every_branch_is_taken(merged, branch):
    assert any(branch in x[5].split(",") for spans in merged[1].values() for x in spans)
