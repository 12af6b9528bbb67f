"""Which groups of pulses become spans (strict profile): lone pulses that are strong or alone in the right way, long enough ones, none that is all off the court or too thin.

Bounds are those of the group itself: its start walked back along motion, its end behind the last pulse.  A long group without a pulse in court keeps a compact exchange at its end, if it has one; what is left is walked anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import us
from ..operators.islands import with_island
from ..operators.staging import staged
from ..sources import carriers
from ..sources.carriers import ctes
from .highlights import walked_starts
from .refine import LANDING, classes
from .registry import query
from .segments import _LOCAL, _sql_islands, _sql_thresholds, court_stats, thresholds

LEAST, NEAR = us(1.5), us(0.12)
_FAR = us(99.0)


def height_thresholds(p: DataFrame) -> DataFrame:
    """``stream_id, high``: the pulse threshold of a stream, its median and 4.5 scaled median deviations."""
    med = p.groupBy("stream_id").agg(F.median("height").alias("m"))
    spread = F.median(F.abs(F.col("height") - F.col("m"))) * 1.4826
    return p.select("stream_id", "height").join(med, "stream_id").groupBy("stream_id").agg((F.first("m") + 4.5 * spread).alias("high"))


_STRONG = "(n = 1 AND (n_court >= 1 OR norm >= 0.55 OR height >= 1.55 * high))"
_SERVE = f"(n = 1 AND iso >= {us(3.30)} AND iso < {us(5.0)} AND nx >= {us(3.60)} AND high > 0 AND height >= 1.48 * high)"
_LONG = f"(n = 1 AND iso >= {us(9.0)} AND nx BETWEEN {us(1.80)} AND {us(3.50)})"
#: Of both engines; the tests stand in their order.
_VERDICT = f"""CASE WHEN n < 2 AND NOT {_STRONG} AND NOT {_SERVE} AND NOT {_LONG} THEN 'few'
  WHEN l + {LANDING} - start_at < {LEAST} AND NOT (({_STRONG} AND iso < {us(3.2)}) OR {_SERVE} OR {_LONG}) THEN 'short'
  WHEN n_court = 0 AND n >= 3 AND l + {LANDING} - start_at > {us(3.2)} THEN CASE WHEN cut IS NULL THEN 'drop' ELSE 'peel' END
  WHEN n >= 4 AND n * {us(1.0)}.0 / greatest({us(0.25)}, l - f) < 0.22 THEN 'sparse' ELSE 'keep' END"""


def admitted(c: DataFrame, e: DataFrame, high: DataFrame) -> DataFrame:
    """``stream_id, first_ts, n, verdict, start_at, end_at, n_left`` of the groups of written classes ``c``; what is dropped has no bounds."""
    x = with_island(c, ["stream_id"], "ts", us(1.85), tie="event_id")
    g = Window.partitionBy("stream_id", "island")
    o, s = g.orderBy("ts", "event_id"), Window.partitionBy("stream_id").orderBy("ts")
    near = s.rangeBetween(Window.unboundedPreceding, -NEAR - 1)
    back = Window.partitionBy("stream_id").orderBy(F.desc("ts")).rangeBetween(Window.unboundedPreceding, -NEAR - 1)
    x = x.withColumn("n", F.count(F.lit(1)).over(g)).withColumn("l", F.max("ts").over(g)).withColumn("i", F.row_number().over(o) - 1).withColumn("next", F.lead("ts").over(o))
    x = x.withColumn("iso", F.coalesce(F.col("ts") - F.max("ts").over(near), F.lit(_FAR))).withColumn("nx", F.coalesce(F.min("ts").over(back) - F.col("ts"), F.lit(_FAR)))
    behind = F.col("n") - 1 - F.col("i")
    fits = F.col("n").between(4, 6) & (F.col("next") - F.col("ts")).between(us(1.55), us(2.15)) & behind.between(2, 3) & (F.col("l") - F.col("next")).between(us(1.40), us(2.60))
    k = x.groupBy("stream_id", "island").agg(
        F.first("court_id").alias("court_id"), F.min("ts").alias("f"), F.max("ts").alias("l"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("in_court"), 1)).alias("n_court"),
        (F.sum(F.round(F.col("motion") * 100000).cast("long")) / (F.count(F.lit(1)) * 100000.0)).alias("mean_motion"), F.max(F.when(F.col("i") == 0, F.col("height"))).alias("height"), F.max(F.when(F.col("i") == 0, F.col("iso"))).alias("iso"),
        F.max(F.when(F.col("i") == 0, F.col("nx"))).alias("nx"), F.min(F.when(fits, F.struct("i", F.col("next").alias("from")))).alias("cut"),
    )
    level = thresholds(court_stats(e)).select("court_id", "support", F.greatest(F.lit(0.001), F.col("a") - F.col("support")).alias("range"))
    k = k.join(level, "court_id").join(high, "stream_id").withColumn("norm", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("mean_motion") - F.col("support")) / F.col("range"))))
    k = staged(k.withColumn("first", F.col("f")), "groups")
    k = staged(walked_starts(k, e).withColumn("verdict", F.expr(_VERDICT)), "groups")
    tail = walked_starts(k.where("verdict = 'peel'").select("stream_id", "island", "court_id", F.col("cut.from").alias("first")), e).select("stream_id", "island", F.col("start_at").alias("tail_at"))
    k = k.join(tail, ["stream_id", "island"], "left")
    stays = F.col("verdict").isin("keep", "peel")
    left = F.when(F.col("verdict") == "peel", F.col("n") - 1 - F.col("cut.i")).otherwise(F.col("n"))
    return k.select("stream_id", F.col("f").alias("first_ts"), "n", "verdict", F.when(stays, F.coalesce("tail_at", "start_at")).alias("start_at"), F.when(stays, F.col("l") + LANDING).alias("end_at"), F.when(stays, left).otherwise(0).cast("long").alias("n_left"))


def _sql_walk(source: str, out: str) -> str:
    """Starts walked back from the pulses ``t`` of rows ``k, court_id``."""
    return f"""{out}_n AS (SELECT p.k, p.t, e.ts, row_number() OVER (PARTITION BY p.k ORDER BY e.ts) AS i, e.energy >= o.onset AS act, max(CASE WHEN e.ts <= p.t AND e.energy >= o.onset THEN e.ts END) OVER (PARTITION BY p.k) AS anchor
      FROM {source} p JOIN onset o USING (court_id) JOIN energy e ON e.court_id = p.court_id AND e.ts BETWEEN p.t - {us(2.0)} AND p.t + {us(0.15)}),
    {out}_a AS (SELECT *, i - lag(i) OVER (PARTITION BY k ORDER BY i) AS step FROM {out}_n WHERE act AND ts <= anchor), {out}_g AS (SELECT *, sum(CASE WHEN step > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM {out}_a),
    {out}_s AS (SELECT k, min(ts) AS at FROM (SELECT *, max(grp) OVER (PARTITION BY k) AS g FROM {out}_g) WHERE grp = g GROUP BY 1),
    {out} AS (SELECT p.k, CASE WHEN s.at IS NULL THEN p.t - {us(0.35)} ELSE greatest(p.t - {us(2.0)}, s.at - {us(0.35)}) END AS start_at FROM {source} p LEFT JOIN {out}_s s USING (k))"""


@query(
    f"""{ctes('pulses', 'energy')}, {_sql_thresholds()}, {_LOCAL}, onset AS (SELECT court_id, greatest(0.008, m + 0.08 * greatest(0.0, a - m)) AS onset FROM stats),
    cls AS (SELECT l.*, near_max AS motion, near_max >= support AS in_court, support, greatest(0.001, a - support) AS range FROM local l JOIN thr USING (court_id)), {_sql_islands('cls', 'stream_id', us(1.85), extra=', event_id')},
    z AS (SELECT *, count(*) OVER g AS n, max(ts) OVER g AS l, row_number() OVER o - 1 AS i, lead(ts) OVER o AS next FROM isl WINDOW g AS (PARTITION BY stream_id, island), o AS (PARTITION BY stream_id, island ORDER BY ts, event_id)),
    med AS (SELECT stream_id, median(height) AS m FROM pulses GROUP BY 1), hi AS (SELECT stream_id, any_value(m) + 4.5 * (median(abs(height - m)) * 1.4826) AS high FROM pulses JOIN med USING (stream_id) GROUP BY 1),
    gr AS (SELECT stream_id, island, any_value(court_id) AS court_id, min(ts) AS f, max(ts) AS l, count(*) AS n, count(CASE WHEN in_court THEN 1 END) AS n_court, CAST(sum(CAST(round(motion * 100000) AS BIGINT)) AS BIGINT) / (count(*) * 100000.0) AS mean_motion, any_value(support) AS support, any_value(range) AS range, max(CASE WHEN i = 0 THEN height END) AS height,
      min(CASE WHEN n BETWEEN 4 AND 6 AND next - ts BETWEEN {us(1.55)} AND {us(2.15)} AND n - 1 - i BETWEEN 2 AND 3 AND l - next BETWEEN {us(1.40)} AND {us(2.60)} THEN i END) AS cut FROM z GROUP BY 1, 2),
    gq AS (SELECT gr.*, row_number() OVER () AS k, f AS t, least(1.0, greatest(0.0, (mean_motion - support) / range)) AS norm, high, coalesce(f - (SELECT max(q.ts) FROM pulses q WHERE q.stream_id = gr.stream_id AND q.ts < gr.f - {NEAR}), {_FAR}) AS iso, coalesce((SELECT min(q.ts) FROM pulses q WHERE q.stream_id = gr.stream_id AND q.ts > gr.f + {NEAR}) - f, {_FAR}) AS nx FROM gr JOIN hi USING (stream_id)),
    {_sql_walk('gq', 'w1')}, vd AS (SELECT *, {_VERDICT} AS verdict FROM gq JOIN w1 USING (k)), pl AS (SELECT vd.k, vd.court_id, z.ts AS t FROM vd JOIN z ON z.stream_id = vd.stream_id AND z.island = vd.island AND z.i = vd.cut + 1 WHERE verdict = 'peel'), {_sql_walk('pl', 'w2')}
    SELECT stream_id, f AS first_ts, n, verdict, CASE WHEN verdict IN ('keep', 'peel') THEN coalesce(w2.start_at, vd.start_at) END AS start_at, CASE WHEN verdict IN ('keep', 'peel') THEN l + {LANDING} END AS end_at, CAST(CASE verdict WHEN 'keep' THEN n WHEN 'peel' THEN n - 1 - cut ELSE 0 END AS BIGINT) AS n_left FROM vd LEFT JOIN w2 USING (k)"""
)
def group_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with its verdict, and the bounds of those that stay."""
    c = staged(classes(spark, sf_dir).select("event_id", "stream_id", "court_id", "ts", "height", "motion", "in_court"), "pulse-classes")
    return admitted(c, carriers.energy(spark, sf_dir), height_thresholds(carriers.pulses(spark, sf_dir)))
