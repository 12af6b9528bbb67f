"""Operators against literal vectors and slow versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanweave.functions import dsp
from spanweave.operators import folds, intervals, rules, store
from spanweave.operators.islands import with_island
from spanweave.operators.lookup import asof, band
from spanweave.plans import catalogue, records
from spanweave.plans.segments import percentile_floor_index


def spans(spark, rows, more="") -> object:
    return spark.createDataFrame([(1, *map(float, r)) for r in rows], f"stream_id long, start double, end double{more}")


def pairs(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


@pytest.mark.parametrize(
    "rows,before,after,duration,want",
    [
        ([(3, 6), (10, 14)], 1.0, 1.5, 20, [(2, 7.5), (9, 15.5)]),
        ([(0.5, 4), (4.5, 8), (18, 20)], 1, 1.5, 20, [(0, 9.5), (17, 20)]),
        ([(2, 4), (6.5, 8)], 1, 1.5, None, [(1, 9.5)]),
        ([(27.5, 35), (10, 20), (19, 28)], 2, 2, 50, [(8, 37)]),
        ([(5, 10), (12, 15)], 1, 1, None, [(4, 16)]),
        ([(5, 40), (10, 20), (15, 25)], 2, 2, None, [(3, 42)]),
        ([(0.5, 5), (45, 52)], 2, 2, 50, [(0, 7), (43, 50)]),
    ],
)
def test_pad_clamp_merge(spark, rows, before, after, duration, want):
    padded = intervals.pad(spans(spark, rows), before, after, None if duration is None else F.lit(duration))
    assert pairs(intervals.merge(padded, 0)) == [tuple(map(float, x)) for x in want]


@pytest.mark.parametrize("rows,gap,want", [([(45, 60), (10, 25)], 0.5, [(10, 25), (45, 60)]), ([(10, 20), (20.3, 30), (40, 50)], 0.5, [(10, 30), (40, 50)])])
def test_merge_with_gap(spark, rows, gap, want):
    assert pairs(intervals.merge(spans(spark, rows), gap)) == [tuple(map(float, x)) for x in want]


def test_merge_confidence(spark):
    s = spans(spark, [(10, 20, 0.9), (12, 18, 0.95), (19.5, 25, 0.85), (30, 40, 0.99)], ", confidence double")
    assert sorted((r["start"], r["end"], r["confidence"]) for r in intervals.merge(s, 0.5, "confidence").collect()) == [(10, 25, 0.85), (30, 40, 0.99)]
    s = spans(spark, [(1, 5, 0.8), (4, 8, 0.95)], ", confidence double")
    assert intervals.merge(s, 0.05, "confidence", keep="max").first()["confidence"] == 0.95


def test_clamp_and_adjacent(spark):
    assert pairs(intervals.clamp_keep(spans(spark, [(-1, 99)]), F.lit(10.0), 0.2)) == [(0, 10)]
    (s, e), = pairs(intervals.clamp_keep(spans(spark, [(9.8, 10.3)]), F.lit(10.0), 0.2))
    assert e == 10 and e - s >= 0.2 - 1e-9
    assert pairs(intervals.clamp_keep(spans(spark, [(1, 2)]), F.lit(0.0), 0.2)) == [(0, 0)]
    assert pairs(intervals.clamp_adjacent(spans(spark, [(2, 10.2), (10, 15)]), 0.45)) == [(2, 9.55), (10, 15)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), min_size=1, max_size=20), st.integers(0, 4))
def test_merge_against_a_loop(spark, raw, gap):
    rows = [(float(a), float(a + n)) for a, n in raw]
    want = []
    for s, e in sorted(rows):
        if want and s - want[-1][1] <= gap:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    got = intervals.merge(spans(spark, rows), gap)
    assert pairs(got) == [tuple(x) for x in want]
    assert pairs(intervals.merge(got.drop("n"), gap)) == [tuple(x) for x in want]


@pytest.mark.parametrize("forward,strict", [(f, s) for f in (False, True) for s in (False, True)])
def test_asof_against_a_loop(spark, forward, strict):
    r = random.Random(forward * 2 + strict)
    left = [(r.randrange(3), r.randrange(200), i) for i in range(80)]
    right = sorted({(r.randrange(3), r.randrange(200)) for _ in range(40)})
    got = asof(spark.createDataFrame(left, "k long, t long, i long"), spark.createDataFrame([(k, t, t * 10) for k, t in right], "k long, t long, v long"), "k", "t", ["v"], 17, forward=forward, strict=strict)
    for x in got.collect():
        times = [t for k, t in right if k == x["k"] and ((t > x["t"] or t == x["t"] and not strict) if forward else (t < x["t"] or t == x["t"] and not strict))]
        want = (min(times) if forward else max(times)) if times else None
        assert x["r_t"] == want and x["r_v"] == (None if want is None else want * 10)


def test_band_against_a_loop(spark):
    r = random.Random(1)
    left = [(r.randrange(3), r.randrange(100), r.randrange(30), i) for i in range(40)]
    right = [(r.randrange(3), r.randrange(120)) for _ in range(60)]
    got = band(spark.createDataFrame(left, "k long, a long, n long, i long"), spark.createDataFrame(right, "k long, t long"), "k", F.col("a"), F.col("a") + F.col("n"), "t", 11)
    want = sorted((i, t) for k, a, n, i in left for k2, t in right if k == k2 and a <= t <= a + n)
    assert sorted((x["i"], x["r_t"]) for x in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_peaks_against_a_loop(spark):
    r = random.Random(2)
    rows = [(1, t, float(r.randrange(50))) for t in sorted(r.sample(range(300), 60))]
    df = with_island(spark.createDataFrame(rows, "stream_id long, ts long, height double"), ["stream_id"], "ts", 10)
    kept = []
    for t, _ in sorted(((t, h) for _, t, h in rows), key=lambda x: (-x[1], -x[0])):
        if all(abs(t - k) >= 10 for k in kept):
            kept.append(t)
    assert sorted(x["ts"] for x in folds.tallest_first(df, ["stream_id", "island"], "ts", "height", 10).collect()) == sorted(kept)
    left, last = [], -99
    for _, t, _ in rows:
        if t - last >= 10:
            left.append(t)
            last = t
    assert sorted(x["ts"] for x in folds.refractory(df, ["stream_id", "island"], "ts", 10).collect()) == left


def test_status_of_merged_spans(spark):
    cases = [("normal", "approved", "approved"), ("approved", "rejected", "approved"), ("flagged", "rejected", "flagged"), ("rejected", "rejected", "rejected"), ("rejected", "normal", "normal"), ("normal", "rejected", "normal")]
    df = spark.createDataFrame(cases, "a string, b string, want string").withColumn("got", records.merged_status(F.col("a"), F.col("b")))
    assert all(r["got"] == r["want"] for r in df.collect())


FEATURES = "n int, d double, rho double, iso double, nx double, fi double, li double, lo_isi double, hi_isi double, ac double, pre double, burst boolean, nin int, mean_e double, p85 double, motion boolean, first_at double, last_at double, start_at double, tail_span double, mid_isi boolean, peeled boolean"
KEPT = dict(n=4, d=6.0, rho=1.0, iso=4.0, nx=4.0, fi=1.0, li=1.0, lo_isi=0.6, hi_isi=1.9, ac=0.5, pre=0.1, burst=True, nin=4, mean_e=0.02, p85=0.05, motion=True, first_at=20.0, last_at=24.0, start_at=19.0, tail_span=2.0, mid_isi=False, peeled=False)
REJECTED = {
    "R1": dict(d=1.0), "R2": dict(d=17.0), "R3": dict(start_at=0.1, first_at=0.5, last_at=5.0), "R4": dict(n=1, burst=False), "R5": dict(n=3, rho=0.2, d=6.0), "R6": dict(d=12.5, rho=0.1), "R7": dict(n=12, rho=1.9, d=6.5),
    "R8": dict(n=3, burst=False, iso=1.0), "R9": dict(n=2, burst=False, fi=1.7), "R10": dict(burst=False), "R11": dict(n=2, burst=False, ac=0.1, d=3.0), "R12": dict(n=2, burst=False, nx=3.0, nin=0, d=2.0), "R13": dict(n=7, iso=2.0),
    "R14": dict(d=9.0, iso=1.5), "R15": dict(n=11, d=10.5, iso=2.1), "R16": dict(ac=0.1), "R17": dict(ac=0.15, rho=0.24), "R19": dict(d=13.0, n=15, mean_e=0.05), "R20": dict(d=9.6, n=8, fi=2.5, mean_e=0.05), "R21": dict(d=9.6, n=8, pre=0.6),
    "R22": dict(d=9.6, n=6, pre=0.6, iso=2.2), "R23": dict(n=5, pre=0.6, iso=1.9), "R24": dict(pre=0.75), "R25": dict(n=2, d=4.0, pre=0.5, iso=3.0), "R26": dict(n=2, d=2.2, pre=0.65, iso=2.0, fi=0.4), "R27": dict(d=5.0, lo_isi=1.0, hi_isi=1.5),
    "R28": dict(n=5, d=5.0, fi=1.6, tail_span=1.4, ac=0.25), "R29": dict(d=4.0, li=0.3, mid_isi=True), "R30": dict(n=5, d=4.0, rho=2.3, hi_isi=0.6, nx=2.0, ac=0.9), "R31": dict(n=6, d=5.0, rho=1.9, hi_isi=0.8, nin=3),
    "R32": dict(n=3, d=5.0, fi=2.4, li=0.6, pre=0.6, ac=0.7), "R33": dict(n=3, d=2.5, fi=0.3, li=0.6, nx=2.0, pre=0.9),
}


def test_every_rule_fires(spark):
    names = [c.split(" ")[0] for c in FEATURES.split(", ")]
    rows = [tuple((KEPT | more)[c] for c in names) for more in [{}, *REJECTED.values()]]
    got = [r["v"] for r in spark.createDataFrame(rows, FEATURES).select(F.expr(rules.reject_rule()).alias("v")).collect()]
    assert got == [None, *REJECTED]


def test_store_replaces_only_its_streams(spark, tmp_path):
    path = str(tmp_path / "spans")
    first = spark.createDataFrame([(i, float(i), i + 1.0) for i in range(200)], "stream_id long, start double, end double")
    store.replace_streams(first, path)
    new = spark.createDataFrame([(5, 50.0, 51.0), (5, 52.0, 53.0), (900, 1.0, 2.0)], first.schema)
    for _ in range(2):
        store.replace_streams(new, path)
    rows = sorted(tuple(r) for r in store.read_streams(spark, path).select("stream_id", "start", "end").collect())
    assert rows == sorted([*((i, float(i), i + 1.0) for i in range(200) if i != 5), (5, 50.0, 51.0), (5, 52.0, 53.0), (900, 1.0, 2.0)])
    with pytest.raises(ValueError):
        store.append_checked(new, first, "stream_id", "stream_id", str(tmp_path / "x"))


def test_signal():
    hits = [0.5, 1.3, 2.1, 2.9]
    t, h = dsp.pulses(dsp.synthetic(4.0, hits))
    assert len(t) == 4 and np.allclose(t, hits, atol=0.02) and (h > 0).all()
    assert len(dsp.pulses(dsp.synthetic(4.0, []))[0]) == 0 and len(dsp.pulses(np.zeros(100))[0]) == 0
    low = np.sin(2 * np.pi * 200 * np.arange(16_000) / 16_000)
    assert np.abs(dsp.band_pass(low, 16_000, 2000, 6000)).max() < 0.01
    x = np.random.default_rng(0).normal(size=300)
    assert np.allclose(dsp.moving_average(x, 80), np.convolve(x, np.ones(80) / 80, "same"))


def test_scans_are_pruned(spark):
    plan = catalogue.QUERIES["pulse_gap_islands"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.partition("ReadSchema")[2] and "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))]" in plan
    assert percentile_floor_index.__name__ in catalogue.QUERIES
