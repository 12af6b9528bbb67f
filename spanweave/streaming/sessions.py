"""Streaming forms: session spans, debounce, the span state machine, atomic replacement of batches.

Thresholds that need a whole series (median, percentile) cannot be had exactly from a stream; they come from a static table that
a batch job makes (``supported_pulses``).  A pulse later than the watermark is dropped.  Keyed states take rows in order of time and are timed by the watermark
(``in_order``): when a stream has been silent for long enough its open span is given out and its state goes, so states are those of the streams that are active.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import replace_streams

SPAN = "stream_id long, first_us long, last_us long, n_pulses long"


def session_spans(pulses: DataFrame, gap: str, late: str) -> DataFrame:
    """Spans of ``stream_id, at`` (timestamp) with inactivity ``gap``, each given out when the watermark has passed its end."""
    s = pulses.withWatermark("at", late).groupBy("stream_id", F.session_window("at", gap)).agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count(F.lit(1)).alias("n_pulses"))
    return s.select("stream_id", F.unix_micros("a").alias("first_us"), F.unix_micros("b").alias("last_us"), "n_pulses")


#: A keyed state of rows that wait for the watermark, and what a fold carries from row to row.
_WAITING = "waiting array<long>, marks array<boolean>"
#: Carried longs, rows (time, mark) in order of time, the watermark -> carried longs or None, results.
Fold = Callable[[tuple, tuple | None, list[tuple[int, bool]], int], tuple[tuple | None, list[tuple]]]


def in_order(rows: DataFrame, fold: Fold, carried: str, out: str, alive_us: int, late: str) -> DataFrame:
    """Rows ``stream_id, ts, mark``, folded by stream in order of time whatever the order of arrival.

    Rows wait, sorted, in the stream's state until the watermark has passed them (then none can come before them any more); event-time timers wake a stream when its next row is due, and when
    its carried state, whose first field is a time, is ``alive_us`` behind.  Rows that come later than the watermark are dropped by the engine, which counts them (``Progress.dropped``).
    """
    names = [x.split()[0] for x in out.split(", ")]
    fields = len(carried.split(", "))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto = state.getCurrentWatermarkMs() * 1000
        carry, waiting = None, []
        if state.exists:
            *values, times, marks = state.get
            carry = None if values[0] is None else tuple(values)
            waiting = list(zip(times, marks, strict=True))
        if not state.hasTimedOut:
            waiting += [(int(t), bool(m)) for f in frames for t, m in zip(f["ts"], f["mark"], strict=True)]
        waiting.sort()
        ready = sum(t <= upto for t, _ in waiting)
        carry, found = fold(key, carry, waiting[:ready], upto)
        waiting = waiting[ready:]
        if carry is None and not waiting:
            if state.exists:
                state.remove()
        else:
            state.update((*(carry or (None,) * fields), [t for t, _ in waiting], [m for _, m in waiting]))
            due = min([*(t for t, _ in waiting[:1]), *([carry[0] + alive_us] if carry else [])])
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(found, columns=names)

    timed = rows.select("stream_id", "ts", "mark", F.timestamp_micros("ts").alias("at")).withWatermark("at", late)
    return timed.groupBy("stream_id").applyInPandasWithState(step, out, f"{carried}, {_WAITING}", "append", GroupStateTimeout.EventTimeTimeout)


def debounce(pulses: DataFrame, rest_us: int, late: str = "10 minutes") -> DataFrame:
    """Pulses at least ``rest_us`` after the last one kept; a stream's state goes when the watermark is that far behind it."""

    def fold(key: tuple, carry: tuple | None, rows: list, upto: int) -> tuple:
        last = carry[0] if carry else None
        kept = []
        for t, _ in rows:
            if last is None or t - last >= rest_us:
                kept.append((key[0], t))
                last = t
        return (None if last is None or upto - last >= rest_us else (last,)), kept

    return in_order(pulses.withColumn("mark", F.lit(True)), fold, "last long", "stream_id long, ts long", rest_us, late)


def state_machine(pulses: DataFrame, silence_us: int, pad_us: int, least_us: int, least_pulses: int, late: str = "10 minutes") -> DataFrame:
    """Rows ``stream_id, ts, supported`` -> spans: opened by a supported pulse, closed by a silence, which the next pulse or the watermark shows.

    What is carried is (last, begin, pulses).
    """

    def fold(key: tuple, carry: tuple | None, rows: list, upto: int) -> tuple:
        last, begin, n = carry or (None, -1, 0)
        found: list[tuple] = []

        def close() -> None:
            if begin >= 0 and n >= least_pulses and last + pad_us - begin >= least_us:
                found.append((key[0], begin, last + pad_us, n))

        for t, supported in rows:
            if last is not None and t - last > silence_us:
                close()
                begin, n = -1, 0
            if begin < 0 and supported:
                begin = t
            n += begin >= 0
            last = t
        if last is not None and upto - last > silence_us:
            close()
            return None, found
        return (None if last is None else (last, begin, n)), found

    rows = pulses.select("stream_id", "ts", F.col("supported").alias("mark"))
    return in_order(rows, fold, "last long, begin long, n long", "stream_id long, start_us long, end_us long, n_pulses long", silence_us, late)


def supported_pulses(pulses: DataFrame, levels: DataFrame, by: str) -> DataFrame:
    """A stream of ``stream_id, ts, energy`` and the key ``by``, joined to the static levels (rows ``by, level``) that a batch job has calibrated."""
    return pulses.join(levels, by).select("stream_id", "ts", (F.col("energy") >= F.col("level")).alias("supported"))


class Progress(StreamingQueryListener):
    """What the streaming queries of a session have done: rows, batches and rows dropped as too late by query name, and how each ended.

    A session's queries have names that begin with its token; ``stop_others`` cancels those of earlier sessions.
    """

    def __init__(self) -> None:
        self.rows: Counter[str] = Counter()
        self.batches: Counter[str] = Counter()
        self.dropped: Counter[str] = Counter()
        self.ended: dict[str, str] = {}
        self._names: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        name = event.progress.name or str(event.progress.id)
        self._names[str(event.progress.id)] = name
        self.rows[name] += event.progress.numInputRows
        self.batches[name] += 1
        self.dropped[name] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        name = self._names.get(str(event.id), str(event.id))
        self.ended[name] = "failed" if event.exception else "done"


def stop_others(spark: SparkSession, token: str) -> list[str]:
    """Cancels the streaming queries that do not belong to the session of ``token`` (by their names); returns the names."""
    gone = [q for q in spark.streams.active if not (q.name or "").startswith(token)]
    for q in gone:
        q.stop()
    return [q.name or str(q.id) for q in gone]


def run_once(stream: DataFrame, out: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Reads all there is, writes Parquet (or calls ``each``), and stops."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (w.foreachBatch(each) if each else w.format("parquet").option("path", out)).start().awaitTermination()


def replace_batches(spans: DataFrame, table: str, checkpoint: str) -> None:
    """Every batch replaces the spans of the streams it holds, whole, in one version of the table; running a batch twice gives the same rows."""
    run_once(spans, "", checkpoint, lambda batch, _: replace_streams(batch, table))


def read_table(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A table's file, or the files of its folder, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
