"""Signals are dealt over tasks by their number, and the filter in blocks is the filter of the whole signal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spanweave.functions import dsp
from spanweave.plans import catalogue


def test_streams_of_one_small_file_are_dealt_over_tasks(spark, tmp_path):
    pq.write_table(pa.table({"c_custkey": pa.array(range(700), pa.int64())}), tmp_path / "customer.parquet")
    found = catalogue.QUERIES["pcm_pulses"](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("stream_id").alias("n")).collect()
    assert sum(r["n"] for r in found) == 700 and len(found) >= 3 and max(r["n"] for r in found) <= 260


def test_no_stream_gives_no_row(spark, tmp_path):
    pq.write_table(pa.table({"c_custkey": pa.array([], pa.int64())}), tmp_path / "customer.parquet")
    assert catalogue.QUERIES["pcm_pulses"](spark, str(tmp_path)).collect() == []


def whole_band_pass(x, rate, low, high, order=4):
    half = rate / 2
    lo = min(0.95, max(0.01, low / half))
    hi = min(0.99, max(lo + 0.01, high / half))
    n = min(len(x) - 1, 3 * rate // 100)
    ext = np.concatenate((2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1])) if n > 0 else x
    w, w1, w2 = (np.tan(np.pi * np.clip(v, 1e-9, 1 - 1e-9) / 2) for v in (np.fft.rfftfreq(len(ext), 1 / rate) / half, lo, hi))
    return np.fft.irfft(np.fft.rfft(ext) / (1 + ((w * w - w1 * w2) / (w * (w2 - w1))) ** (2 * order)), len(ext))[n : n + len(x)]


def whole_envelope(x):
    n = len(x)
    return np.abs(np.fft.ifft(np.fft.fft(x) * [1 if 2 * k in (0, n) else 2 if 2 * k < n else 0 for k in range(n)]))


@pytest.mark.parametrize("n", [1, 2, 3, 170, 1601, 2047, 2048, 2049, 5001, 64_000])
@pytest.mark.parametrize("rate,low,high", [(16_000, 2000.0, 6000.0), (16_000, 2000.0, 2050.0), (44_100, 4000.0, 9000.0), (8000, 100.0, 9000.0)])
def test_blocks_against_the_whole(n, rate, low, high):
    x = np.random.default_rng(n).normal(size=n) + 0.5
    y = dsp.band_pass(x, rate, low, high)
    assert len(y) == n and np.abs(y - whole_band_pass(x, rate, low, high)).max() < 1e-13
    assert np.abs(dsp.envelope(x) - whole_envelope(x)).max() < 1e-12 and dsp.median(x) == np.median(x)
    assert np.abs(dsp.moving_average(x, 80) - [x[max(0, i - 40) : i + 40].sum() / 80 for i in range(n)]).max() < 1e-10
