"""The highlight filter on the golden vectors of the blueprint."""

from __future__ import annotations

import numpy as np
import pytest

from spanweave.operators.highlight import HighlightFilter, Hits, Motion, Span, filter_streams


def make(hits, base, raised=(), until=None):
    until = until or max(hits) + 10
    t = np.arange(0, until, 0.1)
    e = np.full(len(t), base)
    for level, a, b in raised:
        e[(t >= a - 1e-9) & (t <= b + 1e-9)] = level
    return HighlightFilter(Hits(hits), Motion(t, e))


CASES = [
    ("R30", [77.043, 80.002, 80.556, 81.154, 81.467, 81.935, 83.822], (78.58, 82.53, 80.002, 81.935), 0.020, [(0.16, 80, 82.1)]),
    ("R31", [103.552, 107.672, 108.368, 109.176, 109.667, 110.295, 110.657, 112.62], (105.94, 111.11, 107.672, 110.657), 0.004, [(0.16, 107.4, 108.6)]),
    ("R32", [133.407, 136.419, 138.744, 139.334, 142.455], (134.63, 139.78, 136.419, 139.334), 0.020, [(0.16, 134.2, 139.5)]),
    ("R33", [161.06, 165.324, 165.589, 166.167, 168.436], (164.27, 166.77, 165.324, 166.167), 0.020, [(0.16, 163, 166.4)]),
    (None, [83.30, 85.66, 86.46, 86.76, 90.97], (84.66, 87.41, 85.66, 86.76), 0.08, [(0.16, 84.4, 87.2)]),
    (None, [1.79, 2.48, 2.85, 4.03, 4.43, 11.63], (0.74, 5.04, 1.79, 4.43), 0.020, [(0.16, 1.5, 4.6)]),
    (None, [2.0, 4.80, 5.14, 5.52, 5.89, 7.60, 8.89, 12.14], (3.75, 9.34, 4.80, 8.89), 0.020, [(0.16, 4.5, 9)]),
]


@pytest.mark.parametrize("want,hits,span,base,raised", CASES)
def test_golden_verdicts(want, hits, span, base, raised):
    got = make(hits, base, raised).reject_rule(Span(*span))
    assert got == want


def test_long_span_is_split_and_lone_pulse_dropped():
    hits = [*np.arange(1, 10.1, 0.7), *np.arange(40, 50.1, 0.7), 55.0]
    out = HighlightFilter(Hits(hits), Motion([], [])).apply([Span(0, 60, 1, 55)])
    assert len(out) >= 2 and all(s.duration < 25 for s in out) and not any(s.first <= 55 <= s.last for s in out)


def test_streams(spark):
    hits = CASES[5][1]
    t = np.arange(0, 25, 0.1)
    e = np.where((t >= 1.5 - 1e-9) & (t <= 4.6 + 1e-9), 0.16, 0.02)
    sp = spark.createDataFrame([(1, 0.74, 5.04, 1.79, 4.43, 0.9), (2, 0.74, 5.04, 1.79, 4.43, 0.9)], "stream_id long, start double, end double, first double, last double, confidence double")
    pu = spark.createDataFrame([(1, float(h)) for h in hits], "stream_id long, ts double")
    en = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, e, strict=True)], "stream_id long, ts double, energy double")
    got = filter_streams(sp, pu, en).collect()
    assert [(r["stream_id"], round(r["first"], 2), round(r["last"], 2)) for r in got] == [(1, 1.79, 4.43)]


def test_dedupe_keeps_the_longer_pulse_span():
    a, b, c = Span(0, 5, 1, 4), Span(5.1, 11, 6, 10), Span(12, 14, 12.5, 13)
    assert HighlightFilter.dedupe([c, a, b]) == [b, c]
