"""Cuts and trims of the highlight filter with the motion in each hole: what is play stays together.

The share of active samples in a hole is a difference of running totals, looked up for the holes that any rule asks about.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import us
from ..operators.islands import with_island
from ..operators.lookup import small_side
from ..operators.motion_index import between
from ..sources import carriers
from ..sources.carriers import ctes
from .highlights import _LEVELS, _WIDE_P, LAND_PAD, SERVE_PAD, _sql_applause, _sql_share, _wide, activity, motion_levels, trim_applause
from .registry import query
from .segments import BUCKET, level_index

SILENCE, BRIDGE = us(1.85), us(4.2)
#: Holes below this length are judged by no rule.
LEAST = us(1.32)

_HOLES = f"""{_WIDE_P}, {_LEVELS}, wc AS (SELECT w.*, p.court_id FROM wp w JOIN pulses p USING (event_id)), hh AS (SELECT * FROM wc WHERE isi >= {LEAST}),
  hs AS (SELECT h.event_id, {_sql_share('true')} AS act FROM (SELECT h.event_id, e.energy, e.e5, lv.flat, lv.base, lv.active_at FROM hh h JOIN lv ON lv.court_id = h.court_id JOIN energy e ON e.court_id = h.court_id AND e.ts BETWEEN h.ts - h.isi AND h.ts) h GROUP BY 1),
  wl AS (SELECT wc.*, coalesce(round(act, 9), 0.0) AS act, isi <= {SILENCE} OR (isi <= {BRIDGE} AND coalesce(round(act, 9), 0.0) >= CASE WHEN isi <= {us(2.8)} THEN 0.55 ELSE 0.50 END) AS live FROM wc LEFT JOIN hs USING (event_id))"""


def with_life(p: DataFrame, e: DataFrame) -> DataFrame:
    """Adds ``act`` (activity in the hole before a pulse) and ``live`` (whether that hole is play; null before the first pulse)."""
    holes = p.where(F.col("isi") >= LEAST).select("event_id", "court_id", (F.col("ts") - F.col("isi")).alias("lo"), F.col("ts").alias("hi"))
    lv = small_side(motion_levels(e), "court-levels")  # a row for each court
    index = level_index(e, lv.select("court_id", "active_at"), {"active": "active_at"})
    seen = between(holes, index, "court_id", "ts", ["court_id", "event_id"], {"hole": (F.col("lo"), F.col("hi"))}, BUCKET).join(lv, "court_id")
    act = seen.select("event_id", F.round(activity("hole"), 9).alias("act"))
    out = p.join(act, "event_id", "left").fillna(0.0, ["act"])
    enough = F.col("act") >= F.when(F.col("isi") <= us(2.8), 0.55).otherwise(0.50)
    return out.withColumn("live", (F.col("isi") <= SILENCE) | ((F.col("isi") <= BRIDGE) & enough))


@query(
    f"""{ctes('pulses', 'energy')}, {_HOLES}, c AS (SELECT *, sum(CASE WHEN n >= 2 AND NOT live THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM wl),
    d AS (SELECT *, count(*) OVER g AS m, max(ts) OVER g - min(ts) OVER g AS wide, row_number() OVER (PARTITION BY stream_id, island, part ORDER BY ts, event_id) AS i FROM c WINDOW g AS (PARTITION BY stream_id, island, part)),
    r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, island, part ORDER BY isi DESC, k DESC) AS rank FROM d WHERE i > 1 AND m >= 5 AND wide > {us(10)}),
    b AS (SELECT stream_id, island, part, arg_min(k, rank) AS cut FROM r WHERE rank <= 5 AND isi >= {us(1.40)} AND act >= 0.48 GROUP BY 1, 2, 3),
    z AS (SELECT d.*, CASE WHEN b.cut IS NOT NULL AND k >= b.cut THEN 1 ELSE 0 END AS half FROM d LEFT JOIN b USING (stream_id, island, part))
    SELECT stream_id, min(ts) - {us(SERVE_PAD)} AS start_at, max(ts) + {us(LAND_PAD)} AS end_at, count(*) AS n_pulses, half FROM z GROUP BY stream_id, island, part, half"""
)
def live_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut at holes that no motion keeps live; a long blob is then cut once more, at one of its five largest holes that is lively enough to be two exchanges.

    (Within a part every hole is live, so of the rules for a second cut only that for blobs can apply.)
    """
    p = with_life(_wide(spark, sf_dir), carriers.energy(spark, sf_dir))
    p = with_island(p, ["stream_id", "island"], "ts", breaks=(F.col("n") >= 2) & ~F.col("live"), tie="event_id", name="part")
    keys = ["stream_id", "island", "part"]
    g = Window.partitionBy(*keys)
    d = p.withColumn("m", F.count(F.lit(1)).over(g)).withColumn("wide", F.max("ts").over(g) - F.min("ts").over(g)).withColumn("i", F.row_number().over(g.orderBy("ts", "event_id")))
    blob = (F.col("i") > 1) & (F.col("m") >= 5) & (F.col("wide") > us(10))
    rank = F.row_number().over(g.orderBy(F.when(blob, F.col("isi")).desc_nulls_last(), F.col("k").desc()))
    d = d.withColumn("rank", rank)
    fits = blob & (F.col("rank") <= 5) & (F.col("isi") >= us(1.40)) & (F.col("act") >= 0.48)
    d = d.withColumn("cut", F.min(F.when(fits, F.struct("rank", "k"))).over(g)["k"])
    z = d.withColumn("half", F.when(F.col("cut").isNotNull() & (F.col("k") >= F.col("cut")), 1).otherwise(0))
    out = z.groupBy(*keys, "half").agg((F.min("ts") - us(SERVE_PAD)).alias("start_at"), (F.max("ts") + us(LAND_PAD)).alias("end_at"), F.count(F.lit(1)).alias("n_pulses"))
    return out.drop("island", "part")


@query(
    f"""{ctes('pulses', 'energy')}, {_HOLES}, s AS (SELECT *, max(CASE WHEN k = n THEN isi END) OVER (PARTITION BY stream_id, island) AS li, lead(live) OVER (PARTITION BY stream_id, island ORDER BY ts, event_id) AS on_live FROM wl),
    c AS (SELECT stream_id, island, min(CASE WHEN n >= 7 AND k - 1 >= greatest(3, (n * 2) // 5) AND k <= n - 3 AND nxt >= {us(1.32)} AND NOT (nxt > {SILENCE} AND on_live) AND NOT (nxt < {us(1.55)} AND li <= {us(0.55)}) THEN k END) AS cut FROM s GROUP BY 1, 2)
    SELECT stream_id, min(ts) AS first_ts, max(CASE WHEN k <= coalesce(cut, n) THEN ts END) AS last_ts, CAST(max(coalesce(cut, n)) AS BIGINT) AS n_kept FROM wl JOIN c USING (stream_id, island) GROUP BY stream_id, island"""
)
def landing_trim_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a long hole late in a span goes, unless motion says that the hole is play or a compact pair ends it."""
    p = with_life(_wide(spark, sf_dir), carriers.energy(spark, sf_dir))
    g = Window.partitionBy("stream_id", "island")
    p = p.withColumn("li", F.max(F.when(F.col("k") == F.col("n"), F.col("isi"))).over(g)).withColumn("on_live", F.coalesce(F.lead("live").over(g.orderBy("ts", "event_id")), F.lit(False)))
    late = (F.col("n") >= 7) & (F.col("k") - 1 >= F.greatest(F.lit(3), F.expr("(n * 2) div 5"))) & (F.col("k") <= F.col("n") - 3)
    hole = (F.col("nxt") >= us(1.32)) & ~((F.col("nxt") > SILENCE) & F.col("on_live")) & ~((F.col("nxt") < us(1.55)) & (F.col("li") <= us(0.55)))
    p = p.withColumn("cut", F.coalesce(F.min(F.when(late & hole, F.col("k"))).over(g), F.col("n")))
    return p.groupBy("stream_id", "island").agg(F.min("ts").alias("first_ts"), F.max(F.when(F.col("k") <= F.col("cut"), F.col("ts"))).alias("last_ts"), F.max("cut").cast("long").alias("n_kept")).drop("island")


@query(_sql_applause(us(0.36), us(0.60)))
def applause_trim_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trim at the filter's own limits, 0.36 and 0.60."""
    return trim_applause(_wide(spark, sf_dir), us(0.36), us(0.60))
