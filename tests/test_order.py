"""Keyed states give the batch result for any order of arrival inside the watermark."""

from __future__ import annotations

import random
import time

import pytest

from spanweave.streaming import sessions

SECOND = 1_000_000
SCHEMA = "stream_id long, ts long, supported boolean"
SILENCE, PAD, LEAST = 20 * SECOND, 3 * SECOND, 5 * SECOND
#: A pulse of a stream of its own, so late that the watermark passes all others.
LAST = (99, 10**6 * SECOND, False)


def feed(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, stream, folder, name):
    sessions.run_once(stream, str(folder / name), str(folder / f"{name}-state"))
    return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(folder / name)).collect())


def arrivals(rows, r, lateness, batches):
    """The rows in batches, each up to ``lateness`` seconds later than its time."""
    keyed = sorted((t + r.random() * lateness * SECOND, (s, t, ok)) for s, t, ok in rows)
    cut = sorted(r.sample(range(1, len(keyed)), batches - 1))
    return [[x for _, x in keyed[a:b]] for a, b in zip([0, *cut], [*cut, len(keyed)], strict=True)] + [[LAST], [(99, LAST[1] + SECOND, False)]]


def batch_spans(rows):
    out = []
    for s in {s for s, _, _ in rows}:
        group = []
        for t, ok in [*sorted((t, ok) for q, t, ok in rows if q == s), (10**15, False)]:
            if group and t - group[-1][0] > SILENCE:
                first = next((i for i, g in enumerate(group) if g[1]), None)
                if first is not None and len(group) - first >= 2 and group[-1][0] + PAD - group[first][0] >= LEAST:
                    out.append((s, group[first][0], group[-1][0] + PAD, len(group) - first))
                group = []
            group.append((t, ok))
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_any_order_inside_the_watermark_gives_the_batch_result(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(s, r.randrange(900) * SECOND, r.random() < 0.4) for s in range(4) for _ in range(60)]
    stream = feed(spark, tmp_path / "in", arrivals(rows, r, 90, 5))
    assert run(spark, sessions.state_machine(stream, SILENCE, PAD, LEAST, 2, "100 seconds"), tmp_path, "spans") == batch_spans(rows)
    kept = []
    for s in range(4):
        last = None
        for t in sorted(t for q, t, _ in rows if q == s):
            if last is None or t - last >= 12 * SECOND:
                kept.append((s, t))
                last = t
    assert [x for x in run(spark, sessions.debounce(stream, 12 * SECOND, "100 seconds"), tmp_path, "kept") if x[0] != 99] == sorted(kept)


def test_a_pulse_behind_others_does_not_break_a_span_and_one_behind_the_watermark_is_counted(spark, tmp_path):
    t = lambda x: x * SECOND
    batches = [[(1, t(100), True), (1, t(105), True), (1, t(110), True)], [(1, t(101), False)], [(1, t(113), False)], [(2, t(500), False)], [(2, t(501), False)], [(1, t(102), True)], [LAST], [(99, LAST[1] + SECOND, False)]]
    seen = sessions.Progress()
    spark.streams.addListener(seen)
    try:
        got = run(spark, sessions.state_machine(feed(spark, tmp_path / "in", batches), t(10), 0, 1, 2, "60 seconds"), tmp_path, "out")
        time.sleep(2)
    finally:
        spark.streams.removeListener(seen)
    assert got == [(1, t(100), t(113), 5)]
    assert sum(seen.rows.values()) == 10 and sum(seen.dropped.values()) == 1 and set(seen.ended.values()) == {"done"} and sessions.stop_others(spark, "mine") == []
