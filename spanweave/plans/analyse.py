"""A whole analysis: strategy by the signals at hand, refinement, clamps, the final merge, and storing the result by stream.

The passes are stages that a caller may replace or switch off (``Stages``); each takes and gives span rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import us
from ..operators import intervals
from ..operators.store import SpanStore
from ..sources import carriers
from ..sources.carriers import ctes
from . import scorer
from .registry import query
from .scorer import _ALL, _FIT

#: Spans, pulses, energy and track to spans.
Refine = Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]
Filter = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Stages:
    """What runs between grouping and the final merge.  ``None`` switches a stage off; ``merge_gap`` is the hook of the final merge."""

    refine: Refine | None = scorer.refine
    keep: Filter | None = None
    least_gap: int | None = us(0.35)
    merge_gap: int = us(0.12)


_HAS = "has AS (SELECT stream_id, count(CASE WHEN stream_id % 7 <> 0 THEN 1 END) AS n_sound, count(CASE WHEN stream_id % 5 <> 0 THEN 1 END) AS n_picture FROM pulses GROUP BY 1)"


@query(
    f"""{ctes('pulses')}, {_HAS} SELECT stream_id, CASE WHEN n_sound > 0 AND n_picture > 0 THEN 'both' WHEN n_sound > 0 THEN 'sound' WHEN n_picture > 0 THEN 'picture' ELSE 'error' END AS strategy,
    CASE WHEN n_sound = 0 AND n_picture = 0 THEN 'No valid audio or visual stream found' END AS problem FROM has"""
)
def strategy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which detection a stream gets, by the signals that it has (each carrier signal is taken from some streams)."""
    p = carriers.pulses(spark, sf_dir).groupBy("stream_id").agg(F.count(F.when(F.col("stream_id") % 7 != 0, 1)).alias("n_sound"), F.count(F.when(F.col("stream_id") % 5 != 0, 1)).alias("n_picture"))
    sound, picture = F.col("n_sound") > 0, F.col("n_picture") > 0
    strategy = F.when(sound & picture, "both").when(sound, "sound").when(picture, "picture").otherwise("error")
    return p.select("stream_id", strategy.alias("strategy"), F.when(~sound & ~picture, "No valid audio or visual stream found").alias("problem"))


def analyse(p: DataFrame, e: DataFrame, t: DataFrame, stages: Stages = Stages()) -> DataFrame:
    """``stream_id, number, start, end, n`` of every stream: grouped, refined, kept apart, validated, merged and numbered."""
    r = scorer.rallies(p)
    if stages.refine is not None:
        r = stages.refine(r, p, e, t)
    if stages.keep is not None:
        r = stages.keep(r, p)
    x = r.select("stream_id", F.col("s").alias("start"), F.col("e").alias("end"), F.col("l").alias("last"))
    if stages.least_gap is not None:
        x = intervals.clamp_adjacent(x, stages.least_gap, "last")
    m = intervals.merge(x.where("start >= 0 and end > start").drop("last"), stages.merge_gap)
    number = F.row_number().over(Window.partitionBy("stream_id").orderBy("start")).cast("long")
    return m.select("stream_id", number.alias("number"), "start", "end", "n")


def clamp(x: DataFrame, durations: DataFrame) -> DataFrame:
    """Spans within [0, duration] of their stream (rows ``stream_id, duration``; 0, null or none: no end); those without length go."""
    d = durations.select("stream_id", F.when(F.col("duration") > 0, F.col("duration")).alias("__d"))
    x = x.join(d, "stream_id", "left").withColumn("start", F.greatest(F.lit(0), "start")).withColumn("end", F.least("end", "__d")).drop("__d")
    return x.where("end > start")


def analyse_and_store(spark: SparkSession, sf_dir: str, path: str, stages: Stages = Stages(), streams: DataFrame | None = None, durations: DataFrame | None = None) -> DataFrame:
    """Analyses ``streams`` (all, if not given) but for those under way, and replaces their spans in the store, also by none; returns the streams taken.

    If the analysis fails, its streams are left without spans, their job as failed with the error as its note, and the error goes on.
    """
    store, p = SpanStore(spark, path), carriers.pulses(spark, sf_dir)
    taken = store.start(p if streams is None else streams)
    mine = lambda df: df.join(taken, "stream_id", "left_semi")
    try:
        found = analyse(mine(p), carriers.energy(spark, sf_dir), mine(carriers.track(spark, sf_dir)), stages)
        store.finish(taken, found if durations is None else clamp(found, durations))
    except Exception as e:
        store.fail(taken, str(e).splitlines()[0] if str(e) else type(e).__name__)
        raise
    return taken


@query(
    f"""{_ALL}, {_FIT},
    lm AS (SELECT *, lead(s) OVER (PARTITION BY stream_id ORDER BY s, e) - {us(0.35)} AS lim FROM fi), ck AS (SELECT stream_id, s, CASE WHEN e > lim AND lim > s THEN greatest(l, lim) ELSE e END AS e FROM lm),
    rc AS (SELECT *, max(e) OVER (PARTITION BY stream_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ck WHERE s >= 0 AND e > s),
    gr AS (SELECT *, sum(CASE WHEN s - reach > {us(0.12)} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM rc)
    SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY min(s)) AS number, min(s) AS start_at, max(e) AS end_at, count(*) AS n FROM gr GROUP BY stream_id, grp"""
)
def analysed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path from pulses, motion and track to numbered spans."""
    x = analyse(carriers.pulses(spark, sf_dir), carriers.energy(spark, sf_dir), carriers.track(spark, sf_dir))
    return x.select("stream_id", "number", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "n")
