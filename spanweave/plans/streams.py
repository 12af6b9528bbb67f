"""Streaming and signal queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dsp
from ..functions.units import micros, us
from ..operators.staging import shared_folder, staged
from ..sources.carriers import COURTS, SQL, energy, table
from ..streaming import sessions
from .registry import query
from .segments import _STATS, _sql_islands, court_stats

GAP, LATE = "39960 seconds", "10 minutes"  # 1.85 units
#: Streams whose signals a task makes and searches.
STREAMS = 256
#: Numbers (under 32 MB) of an array that is freed.
KEPT = 3_900_000


@query(
    f"""WITH {SQL['pulses']}, {_sql_islands('pulses', 'stream_id', us(1.85), extra=', event_id')}, top AS (SELECT max(ts) AS t FROM pulses)
    SELECT stream_id, min(ts) AS first_us, max(ts) AS last_us, count(*) AS n_pulses FROM isl, top GROUP BY stream_id, island, t HAVING max(ts) + {us(1.85)} <= (t // 1000) * 1000 - 600000000"""
)
def stream_session_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a stream to its end: sessions that the watermark has closed."""
    source = table(spark, sf_dir, "events")
    e = sessions.read_table(spark, sf_dir, "events", source.schema).where("event_type <> 'error'")
    s = sessions.session_spans(e.select(F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("at")), GAP, LATE)
    out = shared_folder(spark, "sessions")
    sessions.run_once(s, f"{out}/data", f"{out}/state")
    return spark.read.schema(sessions.SPAN).parquet(f"{out}/data")


_LEVEL = f"""{_STATS}, lv AS (SELECT court_id, greatest(0.006, m + 0.10 * greatest(0.0, a - m)) AS level FROM stats)"""


@query(
    f"""WITH {SQL['pulses']}, {SQL['energy']}, {_LEVEL}, own AS (SELECT p.*, p.height / 1000.0 >= level AS supported FROM pulses p JOIN lv USING (court_id)), {_sql_islands('own', 'stream_id', us(2.5), extra=', event_id')},
    op AS (SELECT *, min(CASE WHEN supported THEN ts END) OVER (PARTITION BY stream_id, island) AS begin FROM isl), top AS (SELECT max(ts) AS t FROM pulses)
    SELECT stream_id, begin AS start_us, max(ts) + {us(0.5)} AS end_us, count(*) AS n_pulses FROM op, top WHERE ts >= begin GROUP BY stream_id, island, begin, t
    HAVING count(*) >= 2 AND max(ts) + {us(0.5)} - begin >= {us(2.0)} AND max(ts) + {us(2.5)} < (t // 1000) * 1000 - 600000000"""
)
def stream_state_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine over the event table read as a stream, with levels of support that a batch job calibrates: spans that the watermark has closed."""
    level = F.greatest(F.lit(0.006), F.col("m") + 0.10 * F.greatest(F.lit(0.0), F.col("a") - F.col("m")))
    levels = staged(court_stats(energy(spark, sf_dir)).select("court_id", level.alias("level")), "court-levels")
    e = sessions.read_table(spark, sf_dir, "events", table(spark, sf_dir, "events").schema).where("event_type <> 'error'")
    p = e.select(F.col("user_id").alias("stream_id"), (F.col("user_id") % COURTS).alias("court_id"), micros("ts").alias("ts"), (F.col("value") / 1000.0).alias("energy"))
    out = shared_folder(spark, "spans")
    spans = sessions.state_machine(sessions.supported_pulses(p, levels, "court_id"), us(2.5), us(0.5), us(2.0), 2, LATE)
    sessions.run_once(spans, f"{out}/data", f"{out}/state")
    return spark.read.schema(spans.schema).parquet(f"{out}/data")


@query()
def pcm_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits found in synthetic signals, one for each customer, with hits every 0.8 seconds.

    A stream of a few bytes is seconds of signal, so rows are dealt by their number and not by the size of the table's file.
    """
    streams = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stream_id"))
    streams = streams.repartition(-(-streams.count() // STREAMS) or 1)
    hits = list(np.arange(0.2, 3.8, 0.8))

    def detect(frames):
        np.empty(KEPT)  # once so much was freed, the C library keeps the arrays' memory instead of giving it back for each stream
        for f in frames:
            rows = []
            for s in f["stream_id"]:
                t, h = dsp.pulses(dsp.synthetic(4.0, hits, seed=int(s)))
                rows += [(s, round(float(a), 3), round(float(b), 6)) for a, b in zip(t, h, strict=True)]
            yield pd.DataFrame(rows, columns=["stream_id", "t", "height"])

    return streams.mapInPandas(detect, "stream_id long, t double, height double")
