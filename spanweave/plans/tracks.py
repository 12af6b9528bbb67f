"""Track points: clusters, flights and boundary search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import clip01, us
from ..operators import intervals
from ..operators.islands import with_island
from ..operators.lookup import asof, band
from ..operators.staging import staged
from ..sources import carriers
from ..sources.carriers import ctes
from .highlights import _PULSE_SPANS, BUCKET, pulse_spans
from .registry import query

#: Coordinates in micro-units, so that sums of steps are sums of rounded integers and do not depend on order.
MICRO = 1_000_000


def clusters(points: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Points with their cluster, and the step from the point before in it (in micro-units)."""
    p = with_island(points, keys, "ts", us(gap), name="cluster")
    w = Window.partitionBy(*keys, "cluster").orderBy("ts")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2.0)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2.0)))
    return p.withColumn("step", F.coalesce(F.round(step * MICRO).cast("long"), F.lit(0)))


def cluster_rows(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each cluster: bounds, points, path, net displacement, and whether it moves."""
    first, last = F.min_by(F.struct("x", "y"), "ts"), F.max_by(F.struct("x", "y"), "ts")
    c = points.groupBy(*keys, "cluster").agg(F.min("ts").alias("c0"), F.max("ts").alias("c1"), F.count(F.lit(1)).alias("n"), F.sum("step").alias("path"), first.alias("a"), last.alias("b"))
    disp = F.round(F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), F.lit(2.0)) + F.pow(F.col("b.y") - F.col("a.y"), F.lit(2.0))) * MICRO).cast("long")
    c = c.withColumn("disp", disp).drop("a", "b")
    moving = (F.col("n") >= 3) & (F.col("path") >= 0.025 * MICRO) & ((F.col("disp") >= 0.012 * MICRO) | (F.col("path") >= 0.06 * MICRO))
    return c.withColumn("moving", moving)


def _sql_clusters(source: str, keys: str, gap: float, out: str) -> str:
    return f"""{out}_a AS (SELECT *, ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts) AS tgap FROM {source}),
    {out}_b AS (SELECT *, sum(CASE WHEN tgap > {us(gap)} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS cluster FROM {out}_a),
    {out}_c AS (SELECT *, coalesce(CAST(round(sqrt(pow(x - lag(x) OVER w, 2.0) + pow(y - lag(y) OVER w, 2.0)) * {MICRO}) AS BIGINT), 0) AS step FROM {out}_b WINDOW w AS (PARTITION BY {keys}, cluster ORDER BY ts)),
    {out}_d AS (SELECT {keys}, cluster, min(ts) AS c0, max(ts) AS c1, count(*) AS n, CAST(sum(step) AS BIGINT) AS path, CAST(round(sqrt(pow(arg_max(x, ts) - arg_min(x, ts), 2.0) + pow(arg_max(y, ts) - arg_min(y, ts), 2.0)) * {MICRO}) AS BIGINT) AS disp FROM {out}_c GROUP BY {keys}, cluster),
    {out} AS (SELECT *, n >= 3 AND path >= {0.025 * MICRO} AND (disp >= {0.012 * MICRO} OR path >= {0.06 * MICRO}) AS moving FROM {out}_d)"""


@query(f"{ctes('track')}, {_sql_clusters('track', 'stream_id', 0.25, 'cl')} SELECT stream_id, c0, c1, n FROM cl")
def track_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = carriers.track(spark, sf_dir)
    return cluster_rows(clusters(t, ["stream_id"], 0.25), ["stream_id"]).select("stream_id", "c0", "c1", "n")


@query(f"{ctes('track')}, {_sql_clusters('track', 'stream_id', 1.0, 'cl')} SELECT stream_id, c0, n, path, disp, moving FROM cl")
def track_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = carriers.track(spark, sf_dir)
    return cluster_rows(clusters(t, ["stream_id"], 1.0), ["stream_id"]).select("stream_id", "c0", "n", "path", "disp", "moving")


def _clipped(spans: DataFrame, points: DataFrame, lo: Column, hi: Column, gap: float) -> DataFrame:
    """Clusters of the points in [lo, hi] of each span: formed after the points are cut to the window."""
    cut = band(spans.select("stream_id", "island", "first", "last"), points, "stream_id", lo, hi, "ts", BUCKET)
    cut = cut.select("stream_id", "island", "first", "last", F.col("r_ts").alias("ts"), F.col("r_x").alias("x"), F.col("r_y").alias("y"))
    keys = ["stream_id", "island"]
    return cluster_rows(clusters(cut, keys, gap), keys)


_SPANS_P = _PULSE_SPANS
_CUT = "cut AS (SELECT p.stream_id, p.island, t.ts, t.x, t.y FROM ps p JOIN track t ON t.stream_id = p.stream_id AND t.ts BETWEEN {lo} AND {hi})"
_GAP = 1.0


@query(
    f"""{ctes('pulses', 'track')}, {_SPANS_P}, {_CUT.format(lo='p.s', hi='p.e')}, {_sql_clusters('cut', 'stream_id, island', _GAP, 'cl')},
    fl AS (SELECT stream_id, island, sum(c1 - c0) AS flying, bool_or(moving) AS has_flight FROM cl WHERE moving GROUP BY 1, 2), pt AS (SELECT stream_id, island, count(*) AS points FROM cut GROUP BY 1, 2)
    SELECT stream_id, p.f AS first_ts, coalesce(points, 0) AS points, coalesce(has_flight, false) AS has_flight, round(least(1.0, greatest(0.0, coalesce(flying, 0) / CAST(p.e - p.s AS DOUBLE))), 9) AS flight_fraction
    FROM ps p LEFT JOIN fl USING (stream_id, island) LEFT JOIN pt USING (stream_id, island)"""
)
def flight_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a span the track is in flight."""
    s = pulse_spans(spark, sf_dir)
    keys = ["stream_id", "island"]
    c = _clipped(s, carriers.track(spark, sf_dir), F.col("first") - us(1.05), F.col("last") + us(0.60), _GAP)
    f = c.groupBy(*keys).agg(F.sum(F.when(F.col("moving"), F.col("c1") - F.col("c0"))).alias("flying"), F.max("moving").alias("has"), F.sum("n").alias("points"))
    out = s.join(f, keys, "left")
    share = clip01(F.coalesce("flying", F.lit(0)) / (F.col("end") - F.col("start")).cast("double"))
    return out.select("stream_id", F.col("first").alias("first_ts"), F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("has", F.lit(False)).alias("has_flight"), F.round(share, 9).alias("flight_fraction"))


@query(
    f"""{ctes('pulses', 'track')}, {_SPANS_P}, {_CUT.format(lo=f'p.f - {us(2.4)}', hi=f'p.f + {us(0.40)}')}, {_sql_clusters('cut', 'stream_id, island', _GAP, 'ca')},
    {_CUT.replace('cut AS', 'cut2 AS').format(lo=f'p.l - {us(0.45)}', hi=f'p.l + {us(2.4)}')}, {_sql_clusters('cut2', 'stream_id, island', _GAP, 'cb')},
    e AS (SELECT stream_id, island, min(c0) AS t FROM ca JOIN ps USING (stream_id, island) WHERE moving AND c1 >= f - {us(0.40)} GROUP BY 1, 2), z AS (SELECT stream_id, island, max(c1) AS t FROM cb JOIN ps USING (stream_id, island) WHERE moving AND c0 <= l + {us(0.45)} GROUP BY 1, 2)
    SELECT stream_id, p.f AS first_ts, e.t - {us(0.25)} AS flight_start, z.t + {us(0.25)} AS flight_end FROM ps p LEFT JOIN e USING (stream_id, island) LEFT JOIN z USING (stream_id, island)"""
)
def flight_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest start and latest end of a flight that joins a span."""
    s, t = pulse_spans(spark, sf_dir), carriers.track(spark, sf_dir)
    keys = ["stream_id", "island"]
    ends = s.select(*keys, "first", "last")
    a = _clipped(s, t, F.col("first") - us(2.4), F.col("first") + us(0.40), _GAP).join(ends, keys).where(F.col("moving") & (F.col("c1") >= F.col("first") - us(0.40))).groupBy(*keys).agg(F.min("c0").alias("a"))
    b = _clipped(s, t, F.col("last") - us(0.45), F.col("last") + us(2.4), _GAP).join(ends, keys).where(F.col("moving") & (F.col("c0") <= F.col("last") + us(0.45))).groupBy(*keys).agg(F.max("c1").alias("b"))
    out = ends.join(a, keys, "left").join(b, keys, "left")
    return out.select("stream_id", F.col("first").alias("first_ts"), (F.col("a") - us(0.25)).alias("flight_start"), (F.col("b") + us(0.25)).alias("flight_end"))


@query(
    f"""{ctes('pulses', 'track')}, {_SPANS_P}, {_sql_clusters('track', 'stream_id', _GAP, 'cl')}, mv AS (SELECT * FROM cl WHERE moving),
    b AS (SELECT p.stream_id, p.island, arg_max(m.c0, m.c1) AS t FROM ps p JOIN mv m ON m.stream_id = p.stream_id AND m.c1 >= p.f - {us(0.35)} AND m.c0 <= p.f GROUP BY 1, 2),
    a AS (SELECT p.stream_id, p.island, arg_min(m.c1, m.c0) AS t FROM ps p JOIN mv m ON m.stream_id = p.stream_id AND m.c0 <= p.l + {us(0.4)} AND m.c1 >= p.l GROUP BY 1, 2)
    SELECT stream_id, p.f AS first_ts, least(p.s, coalesce(b.t - {us(0.3)}, p.s)) AS start_at, greatest(p.e, coalesce(least(p.l + {us(3.4)}, a.t + {us(0.25)}), p.e)) AS end_at FROM ps p LEFT JOIN b USING (stream_id, island) LEFT JOIN a USING (stream_id, island)"""
)
def boundary_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that only widen, to the moving clusters at both ends.

    Clusters of a stream do not overlap, so the one that ends last of those begun by the first pulse is the last begun, and the one that begins first of those not ended by the last pulse is
    the next to end: one lookup each.
    """
    s = staged(pulse_spans(spark, sf_dir).select("stream_id", "first", "last", "start", "end"), "pulse-spans")
    mv = staged(cluster_rows(clusters(carriers.track(spark, sf_dir), ["stream_id"], _GAP), ["stream_id"]).where("moving").select("stream_id", "c0", "c1"), "moving-clusters")
    out = staged(asof(s.withColumn("at", F.col("first")), mv.withColumn("at", F.col("c0")), "stream_id", "at", ["c0", "c1"], BUCKET, prefix="b_"), "pulse-spans")
    out = asof(out.withColumn("at", F.col("last")), mv.withColumn("at", F.col("c1")), "stream_id", "at", ["c0", "c1"], BUCKET, forward=True, prefix="a_")
    out = out.withColumn("b", F.when(F.col("b_c1") >= F.col("first") - us(0.35), F.col("b_c0"))).withColumn("a", F.when(F.col("a_c0") <= F.col("last") + us(0.4), F.col("a_c1")))
    start = F.least("start", F.coalesce(F.col("b") - us(0.3), F.col("start")))
    end = F.greatest("end", F.coalesce(F.least(F.col("last") + us(3.4), F.col("a") + us(0.25)), F.col("end")))
    return out.select("stream_id", F.col("first").alias("first_ts"), start.alias("start_at"), end.alias("end_at"))


@query(
    f"""{ctes('pulses')}, {_SPANS_P}, w AS (SELECT stream_id, f - {us(3.2)} AS a, f + {us(0.45)} AS b FROM ps UNION ALL SELECT stream_id, l - {us(0.15)}, l + {us(3.4)} FROM ps),
    r AS (SELECT *, max(b) OVER (PARTITION BY stream_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w), g AS (SELECT *, sum(CASE WHEN a - reach > {us(0.1)} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM r)
    SELECT stream_id, min(a) AS start_at, max(b) AS end_at, count(*) AS n FROM g GROUP BY stream_id, grp"""
)
def candidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around both ends of each span, merged: what a scan of frames has to read."""
    s = pulse_spans(spark, sf_dir)
    two = F.array(F.struct((F.col("first") - us(3.2)).alias("s"), (F.col("first") + us(0.45)).alias("e")), F.struct((F.col("last") - us(0.15)).alias("s"), (F.col("last") + us(3.4)).alias("e")))
    w = s.select("stream_id", F.explode(two).alias("x")).select("stream_id", F.col("x.s").alias("start"), F.col("x.e").alias("end"))
    return intervals.merge(w, us(0.1)).select("stream_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "n")
