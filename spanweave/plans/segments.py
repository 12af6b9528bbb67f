"""Segmentation of pulse and energy streams into spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import UNIT, clip01, us
from ..operators.islands import numbered, with_island
from ..operators.lookup import asof, small_side
from ..operators.motion_index import between, running, total, window_max
from ..sources import carriers
from ..sources.carriers import ctes
from .registry import query

BUCKET = 64 * UNIT


def _sql_islands(source: str, key: str, limit: int, out: str = "isl", extra: str = "") -> str:
    return (
        f"{out}_g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY {key} ORDER BY ts{extra}) AS gap FROM {source}), "
        f"{out} AS (SELECT *, sum(CASE WHEN gap > {limit} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ts{extra} ROWS UNBOUNDED PRECEDING) AS island FROM {out}_g)"
    )


@query(
    f"""{ctes('pulses')}, {_sql_islands('pulses', 'stream_id', us(1.85), extra=', event_id')}
    SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY min(ts)) AS span_no, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_pulses,
           max(ts) - min(ts) AS duration FROM isl GROUP BY stream_id, island"""
)
def pulse_gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of pulses with gaps of at most 1.85 units, numbered in each stream."""
    p = with_island(carriers.pulses(spark, sf_dir), ["stream_id"], "ts", us(1.85), tie="event_id")
    out = p.groupBy("stream_id", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_pulses"))
    return numbered(out, ["stream_id"], "first_ts").select("stream_id", F.col("span_no").cast("long"), "first_ts", "last_ts", "n_pulses", (F.col("last_ts") - F.col("first_ts")).alias("duration"))


_FORWARD = """supported AS (SELECT p.*, coalesce(e.energy, l.energy) AS near_energy FROM pulses p
    ASOF LEFT JOIN energy e ON p.court_id = e.court_id AND p.ts <= e.ts
    LEFT JOIN (SELECT court_id, max_by(energy, ts) AS energy FROM energy GROUP BY 1) l ON p.court_id = l.court_id)"""


def _with_forward_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of the first sample at or after each pulse; after the last sample, the last one's."""
    e = carriers.energy(spark, sf_dir)
    p = asof(carriers.pulses(spark, sf_dir), e, "court_id", "ts", ["energy"], BUCKET, forward=True)
    last = e.groupBy("court_id").agg(F.max_by("energy", "ts").alias("last_energy"))
    # without any sample of the court the energy counts as 1
    return p.join(last, "court_id", "left").withColumn("near_energy", F.coalesce("r_energy", "last_energy", F.lit(1.0)))


@query(f"{ctes('pulses', 'energy')}, {_FORWARD} SELECT event_id, stream_id, ts, round(near_energy, 6) AS near_energy FROM supported")
def pulse_energy_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_forward_energy(spark, sf_dir).select("event_id", "stream_id", "ts", F.round("near_energy", 6).alias("near_energy"))


@query(
    f"""{ctes('pulses', 'energy')}, {_FORWARD}, {_sql_islands('supported', 'stream_id', us(2.5), extra=', event_id')},
    opened AS (SELECT *, min(CASE WHEN near_energy >= 0.025 THEN ts END) OVER (PARTITION BY stream_id, island) AS start_at FROM isl)
    SELECT stream_id, start_at, max(ts) + {us(0.5)} AS end_at, count(*) AS n_pulses, 0.95 AS confidence FROM opened WHERE ts >= start_at
    GROUP BY stream_id, island, start_at HAVING count(*) >= 2 AND max(ts) + {us(0.5)} - start_at >= {us(2.0)}"""
)
def segment_fsm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle, serve, rally, end as one window query: a span opens at the first pulse of its island that motion supports."""
    p = with_island(_with_forward_energy(spark, sf_dir), ["stream_id"], "ts", us(2.5), tie="event_id")
    w = Window.partitionBy("stream_id", "island")
    p = p.withColumn("start_at", F.min(F.when(F.col("near_energy") >= 0.025, F.col("ts"))).over(w)).where("ts >= start_at")
    out = p.groupBy("stream_id", "island", "start_at").agg((F.max("ts") + us(0.5)).alias("end_at"), F.count(F.lit(1)).alias("n_pulses"))
    return out.where((F.col("n_pulses") >= 2) & (F.col("end_at") - F.col("start_at") >= us(2.0))).select("stream_id", "start_at", "end_at", "n_pulses", F.lit(0.95).alias("confidence"))


@query(
    f"""{ctes('energy')}, lively AS (SELECT * FROM energy WHERE energy >= 0.05), {_sql_islands('lively', 'court_id', us(2.5))}
    SELECT court_id, min(ts) AS start_at, max(ts) AS end_at, count(*) AS n_samples, 0.85 AS confidence FROM isl GROUP BY court_id, island HAVING max(ts) - min(ts) >= {us(2.0)}"""
)
def segment_energy_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = with_island(carriers.energy(spark, sf_dir).where("energy >= 0.05"), ["court_id"], "ts", us(2.5))
    out = e.groupBy("court_id", "island").agg(F.min("ts").alias("start_at"), F.max("ts").alias("end_at"), F.count(F.lit(1)).alias("n_samples"))
    return out.where(F.col("end_at") - F.col("start_at") >= us(2.0)).select("court_id", "start_at", "end_at", "n_samples", F.lit(0.85).alias("confidence"))


@query(
    f"""{ctes('pulses')}, {_sql_islands('pulses', 'stream_id', us(1.85), extra=', event_id')},
    g AS (SELECT stream_id, island, min(ts) AS f, max(ts) AS l, count(*) AS n FROM isl GROUP BY 1, 2)
    SELECT stream_id, greatest(0, f - {us(0.85)}) AS start_at, l + {us(0.70)} AS end_at, n AS n_pulses, 0.75 AS confidence FROM g
    WHERE n >= 2 AND l + {us(0.70)} - greatest(0, f - {us(0.85)}) >= {us(1.35)} AND NOT (n * {UNIT}.0 / greatest({us(0.25)}, l - f) < 0.28 AND n < 5)"""
)
def segment_audio_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_island(carriers.pulses(spark, sf_dir), ["stream_id"], "ts", us(1.85), tie="event_id")
    g = p.groupBy("stream_id", "island").agg(F.min("ts").alias("f"), F.max("ts").alias("l"), F.count(F.lit(1)).alias("n"))
    density = F.col("n") * float(UNIT) / F.greatest(F.lit(us(0.25)), F.col("l") - F.col("f"))
    g = g.withColumn("start_at", F.greatest(F.lit(0), F.col("f") - us(0.85))).withColumn("end_at", F.col("l") + us(0.70))
    keep = (F.col("n") >= 2) & (F.col("end_at") - F.col("start_at") >= us(1.35)) & ~((density < 0.28) & (F.col("n") < 5))
    return g.where(keep).select("stream_id", "start_at", "end_at", F.col("n").alias("n_pulses"), F.lit(0.75).alias("confidence"))


@query(
    f"""{ctes('pulses')}, {_sql_islands('pulses', 'stream_id', us(2.5), extra=', event_id')},
    g AS (SELECT stream_id, island, min(ts) AS f, max(ts) AS l, count(*) AS n, count(*) * {UNIT}.0 / greatest({us(0.25)}, max(ts) - min(ts)) AS d FROM isl GROUP BY 1, 2)
    SELECT stream_id, greatest(0, f - {us(0.75)}) AS start_at, l + {us(0.95)} AS end_at, n AS n_pulses,
           round(least(0.99, greatest(0.45, 0.45 + 0.3 * least(1.0, greatest(0.0, d / 0.8)) + 0.25 * least(1.0, greatest(0.0, n / 8.0)))), 6) AS confidence
    FROM g WHERE n >= 3 AND (d >= 0.28 OR n >= 5) AND l + {us(0.95)} - greatest(0, f - {us(0.75)}) BETWEEN {us(1.5)} AND {us(26)}"""
)
def segment_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_island(carriers.pulses(spark, sf_dir), ["stream_id"], "ts", us(2.5), tie="event_id")
    g = p.groupBy("stream_id", "island").agg(F.min("ts").alias("f"), F.max("ts").alias("l"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("d", F.col("n") * float(UNIT) / F.greatest(F.lit(us(0.25)), F.col("l") - F.col("f")))
    g = g.withColumn("start_at", F.greatest(F.lit(0), F.col("f") - us(0.75))).withColumn("end_at", F.col("l") + us(0.95))
    keep = (F.col("n") >= 3) & ((F.col("d") >= 0.28) | (F.col("n") >= 5)) & (F.col("end_at") - F.col("start_at")).between(us(1.5), us(26))
    conf = F.least(F.lit(0.99), F.greatest(F.lit(0.45), 0.45 + 0.3 * clip01(F.col("d") / 0.8) + 0.25 * clip01(F.col("n") / 8.0)))
    return g.where(keep).select("stream_id", "start_at", "end_at", F.col("n").alias("n_pulses"), F.round(conf, 6).alias("confidence"))


# --- robust statistics and thresholds -------------------------------------------------------------------------

_STATS = "stats AS (SELECT court_id, count(*) AS n, median(energy) AS m, quantile_cont(energy, 0.85) AS a FROM energy GROUP BY 1)"


def court_stats(e: DataFrame) -> DataFrame:
    """One row for each court: samples, median, 85th percentile (linear interpolation)."""
    return e.groupBy("court_id").agg(F.count(F.lit(1)).alias("n"), F.median("energy").alias("m"), F.percentile("energy", F.lit(0.85)).alias("a"))


@query(
    f"""{ctes('pulses')}, med AS (SELECT stream_id, median(height) AS m FROM pulses GROUP BY 1)
    SELECT stream_id, round(any_value(m), 6) AS median_height, round(median(abs(height - m)) * 1.4826, 6) AS sigma, round(any_value(m) + 4.5 * (median(abs(height - m)) * 1.4826), 6) AS height_threshold
    FROM pulses JOIN med USING (stream_id) GROUP BY stream_id"""
)
def stream_robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, scaled median absolute deviation, and the pulse threshold made of them."""
    p = carriers.pulses(spark, sf_dir).select("stream_id", "height")
    med = p.groupBy("stream_id").agg(F.median("height").alias("m"))
    sigma = F.median(F.abs(F.col("height") - F.col("m"))) * 1.4826
    out = p.join(med, "stream_id").groupBy("stream_id").agg(F.first("m").alias("m"), sigma.alias("s"))
    return out.select("stream_id", F.round("m", 6).alias("median_height"), F.round("s", 6).alias("sigma"), F.round(F.col("m") + 4.5 * F.col("s"), 6).alias("height_threshold"))


def thresholds(stats: DataFrame, motion: float = 0.01, onset_slope: float = 0.08) -> DataFrame:
    """The adaptive thresholds of a court; ``onset_slope`` is 0.10 in the on-device profile."""
    m, r = F.col("m"), F.greatest(F.lit(0.0), F.col("a") - F.col("m"))
    residual = F.greatest(F.lit(0.45 * motion), m + 0.06 * r)
    return stats.select(
        "court_id", "m", "a",
        F.greatest(F.lit(0.6 * motion), m + 0.10 * r).alias("support"),
        F.greatest(F.lit(0.55 * motion), m + 0.08 * r).alias("bridge"),
        residual.alias("residual"),
        F.greatest(residual, m + 0.14 * r).alias("merge_at"),
        F.greatest(F.lit(0.50 * motion), m + onset_slope * r).alias("onset"),
    )


def _sql_thresholds(onset: float = 0.08) -> str:
    r = "greatest(0.0, a - m)"
    return (
        f"{_STATS}, thr AS (SELECT court_id, m, a, greatest({0.6 * 0.01!r}, m + 0.10 * {r}) AS support, greatest({0.55 * 0.01!r}, m + 0.08 * {r}) AS bridge, "
        f"greatest({0.45 * 0.01!r}, m + 0.06 * {r}) AS residual, greatest(greatest({0.45 * 0.01!r}, m + 0.06 * {r}), m + 0.14 * {r}) AS merge_at, greatest({0.50 * 0.01!r}, m + {onset} * {r}) AS onset FROM stats)"
    )


_THR_OUT = "court_id, round(support, 6) AS support, round(bridge, 6) AS bridge, round(residual, 6) AS residual, round(merge_at, 6) AS merge_at, round(onset, 6) AS onset"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("court_id", *[F.round(c, 6).alias(c) for c in ("support", "bridge", "residual", "merge_at", "onset")])


@query(f"{ctes('energy')}, {_sql_thresholds()} SELECT {_THR_OUT} FROM thr")
def adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(thresholds(court_stats(carriers.energy(spark, sf_dir))))


@query(f"{ctes('energy')}, {_sql_thresholds(0.10)} SELECT {_THR_OUT} FROM thr")
def adaptive_thresholds_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(thresholds(court_stats(carriers.energy(spark, sf_dir)), onset_slope=0.10))


@query(
    f"""{ctes('energy')}, ranked AS (SELECT court_id, energy, row_number() OVER (PARTITION BY court_id ORDER BY energy) - 1 AS i, count(*) OVER (PARTITION BY court_id) AS n FROM energy)
    SELECT court_id, any_value(n) AS n, round(min(CASE WHEN i = CAST(floor((n - 1) * 0.85) AS BIGINT) THEN energy END), 6) AS p85_low FROM ranked GROUP BY court_id"""
)
def percentile_floor_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted sample at index floor((n - 1) q): the on-device percentile.

    By counts of equal values, so that a court's samples are summed before they meet and no array of them is made.
    """
    e = carriers.energy(spark, sf_dir).groupBy("court_id", "energy").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("court_id").orderBy("energy")
    e = e.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("court_id")))
    at = F.floor((F.col("n") - 1) * 0.85)
    pick = F.min(F.when(F.col("upto") > at, F.col("energy")))
    return e.groupBy("court_id").agg(F.first("n").alias("n"), F.round(pick, 6).alias("p85_low"))


# --- lookups around a pulse ------------------------------------------------------------------------------------

@query(
    f"""{ctes('pulses')} SELECT a.event_id, round(coalesce((a.ts - b.ts) / {UNIT}.0, 99.0), 6) AS isolation FROM (SELECT *, ts - {us(0.12)} AS before FROM pulses) a
    ASOF LEFT JOIN pulses b ON a.stream_id = b.stream_id AND a.before > b.ts"""
)
def pulse_prev_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the last pulse more than 0.12 units before; 99 where there is none."""
    p = carriers.pulses(spark, sf_dir).select("stream_id", "ts", "event_id")
    shifted = p.withColumn("own", F.col("ts")).withColumn("ts", F.col("ts") - us(0.12))
    out = asof(shifted, p, "stream_id", "ts", ["event_id"], BUCKET, strict=True)
    return out.select("event_id", F.round(F.coalesce((F.col("own") - F.col("r_ts")) / float(UNIT), F.lit(99.0)), 6).alias("isolation"))


@query(
    f"""{ctes('pulses')} SELECT a.event_id, round(coalesce((b.ts - a.ts) / {UNIT}.0, 99.0), 6) AS next_gap FROM (SELECT *, ts + {us(0.12)} AS after FROM pulses) a
    ASOF LEFT JOIN pulses b ON a.stream_id = b.stream_id AND a.after < b.ts"""
)
def pulse_next_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = carriers.pulses(spark, sf_dir).select("stream_id", "ts", "event_id")
    shifted = p.withColumn("own", F.col("ts")).withColumn("ts", F.col("ts") + us(0.12))
    out = asof(shifted, p, "stream_id", "ts", ["event_id"], BUCKET, forward=True, strict=True)
    return out.select("event_id", F.round(F.coalesce((F.col("r_ts") - F.col("own")) / float(UNIT), F.lit(99.0)), 6).alias("next_gap"))


@query(
    f"""{ctes('pulses', 'energy')}, probe AS (SELECT event_id, court_id, ts + {us(0.05)} AS t FROM pulses),
    b AS (SELECT p.event_id, p.t, e.ts AS bt, e.energy AS be FROM probe p ASOF LEFT JOIN energy e ON p.court_id = e.court_id AND p.t >= e.ts),
    f AS (SELECT p.event_id, e.ts AS ft, e.energy AS fe FROM probe p ASOF LEFT JOIN energy e ON p.court_id = e.court_id AND p.t <= e.ts)
    SELECT event_id, round(CASE WHEN ft IS NULL OR t - bt <= ft - t THEN be ELSE fe END, 6) AS nearest_energy FROM b JOIN f USING (event_id)"""
)
def pulse_energy_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy nearest to 0.05 units after each pulse; of two as near the earlier."""
    e = carriers.energy(spark, sf_dir)
    p = carriers.pulses(spark, sf_dir).select("event_id", "court_id", (F.col("ts") + us(0.05)).alias("ts"))
    near = asof(asof(p, e, "court_id", "ts", ["energy"], BUCKET, prefix="b_"), e, "court_id", "ts", ["energy"], BUCKET, forward=True, prefix="f_")
    early = F.col("f_ts").isNull() | (F.col("ts") - F.col("b_ts") <= F.col("f_ts") - F.col("ts"))
    return near.select("event_id", F.round(F.when(early, F.col("b_energy")).otherwise(F.col("f_energy")), 6).alias("nearest_energy"))


_LOCAL = f"""local AS (SELECT p.event_id, p.stream_id, p.court_id, p.ts, p.height, max(e.energy) AS near_max FROM pulses p JOIN energy e ON p.court_id = e.court_id AND e.ts BETWEEN p.ts - {us(0.4)} AND p.ts + {us(0.4)} GROUP BY ALL)"""


def local_max(p: DataFrame, e: DataFrame, radius: float = 0.4) -> DataFrame:
    """Adds ``near_max``: the greatest energy of the court within ``radius`` units.

    A pulse with no sample in reach keeps null (the caller falls back to the as-of sample).
    """
    return window_max(p, e, "court_id", "ts", "energy", us(radius), BUCKET, "near_max")


def local_motion(p: DataFrame, e: DataFrame, radius: float = 0.4) -> DataFrame:
    """Adds ``motion``: ``local_max``, or where no sample is in reach the first sample after the pulse (the court's last one behind it)."""
    near = local_max(p, e, radius)
    lone = near.where("near_max is null").drop("near_max")
    last = e.groupBy("court_id").agg(F.max_by("energy", "ts").alias("last_energy"))
    found = asof(lone, e, "court_id", "ts", ["energy"], BUCKET, forward=True).join(last, "court_id", "left").withColumn("motion", F.coalesce("r_energy", "last_energy"))
    return near.where("near_max is not null").withColumnRenamed("near_max", "motion").unionByName(found.select(*p.columns, "motion"))


@query(
    f"""{ctes('pulses', 'energy')}, {_sql_thresholds()}, {_LOCAL}, h AS (SELECT stream_id, median(height) AS hm FROM pulses GROUP BY 1)
    SELECT event_id, round(near_max, 6) AS near_max, near_max >= support AS in_court, height >= 1.55 * hm AS strong, (near_max >= bridge OR height >= 1.55 * hm OR near_max >= support) AS soft
    FROM local JOIN thr USING (court_id) JOIN h USING (stream_id)"""
)
def pulse_local_energy_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulse classes: in court, strong, soft (the stream's median height stands for the detector's threshold)."""
    p, e = carriers.pulses(spark, sf_dir), carriers.energy(spark, sf_dir)
    h = p.groupBy("stream_id").agg(F.median("height").alias("hm"))
    out = local_max(p, e).join(thresholds(court_stats(e)), "court_id").join(h, "stream_id")
    strong, inside = F.col("height") >= 1.55 * F.col("hm"), F.col("near_max") >= F.col("support")
    return out.select("event_id", F.round("near_max", 6).alias("near_max"), inside.alias("in_court"), strong.alias("strong"), ((F.col("near_max") >= F.col("bridge")) | strong | inside).alias("soft"))


# --- bridges -------------------------------------------------------------------------------------------------

MAX_SILENCE, MAX_BRIDGE = us(1.85), us(3.2)
_HOLES = f"""holes AS (SELECT stream_id, court_id, event_id, ts AS hi, lag(ts) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS lo FROM pulses),
    wide AS (SELECT * FROM holes WHERE hi - lo > {MAX_SILENCE} AND hi - lo <= {MAX_BRIDGE}),
    hole AS (SELECT w.event_id, w.stream_id, w.court_id, w.lo, w.hi, count(e.energy) AS n, coalesce(sum(e.e5) / (count(e.energy) * 100000.0), 0) AS mean_e, coalesce(sum(CASE WHEN e.energy >= t.bridge THEN 1 ELSE 0 END) / (count(e.energy) * 1.0), 0) AS active
      FROM wide w JOIN thr t ON w.court_id = t.court_id LEFT JOIN energy e ON e.court_id = w.court_id AND e.ts BETWEEN w.lo AND w.hi GROUP BY ALL)"""


def hole_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion in the holes between neighbour pulses that are too long for silence but not for a bridge."""
    p, e = carriers.pulses(spark, sf_dir), carriers.energy(spark, sf_dir)
    thr = small_side(thresholds(court_stats(e)).select("court_id", "bridge", "merge_at"), "court-thresholds")  # a row for each court
    w = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    holes = p.select("stream_id", "court_id", "event_id", F.lag("ts").over(w).alias("lo"), F.col("ts").alias("hi"))
    holes = holes.where((F.col("hi") - F.col("lo") > MAX_SILENCE) & (F.col("hi") - F.col("lo") <= MAX_BRIDGE)).join(thr, "court_id")
    index = level_index(e, thr, {"active": "bridge"})
    seen = between(holes, index, "court_id", "ts", ["event_id"], {"hole": (F.col("lo"), F.col("hi"))}, BUCKET)
    return holes.join(seen.select("event_id", total("hole", "n").alias("n"), mean_between("hole"), share_between("hole", "active")), "event_id")


def level_index(e: DataFrame, levels: DataFrame, counts: dict[str, str]) -> DataFrame:
    """Running totals by court: samples ``n``, energy ``e5``, and for each of ``counts`` the samples at or above that level of their court (rows ``court_id`` and levels)."""
    measures = {"n": F.lit(1), "e5": F.col("e5")} | {name: F.col("energy") >= F.col(level) for name, level in counts.items()}
    return running(e.join(levels, "court_id"), "court_id", "ts", {k: m.cast("int") for k, m in measures.items()}, BUCKET)


def mean_between(name: str) -> Column:
    n = total(name, "n")
    return F.when(n > 0, total(name, "e5") / (n * 100000.0)).otherwise(0.0).alias("mean_e")


def share_between(name: str, measure: str, none: float = 0.0) -> Column:
    n = total(name, "n")
    return F.when(n > 0, total(name, measure) / (n * 1.0)).otherwise(none).alias(measure)


@query(f"{ctes('pulses', 'energy')}, {_sql_thresholds()}, {_HOLES} SELECT event_id, lo, hi, n, round(mean_e, 12) AS mean_energy, round(active, 12) AS active FROM hole")
def hole_motion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hole_stats(spark, sf_dir).select("event_id", "lo", "hi", "n", F.round("mean_e", 12).alias("mean_energy"), F.round("active", 12).alias("active"))


def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, bridged``: whether the hole before a pulse is bridged by motion alone (the pure-motion rule, strict mode)."""
    h = hole_stats(spark, sf_dir)
    live = (F.col("hi") - F.col("lo") <= us(2.6)) & (F.round("active", 6) >= 0.55) & (F.round("mean_e", 6) >= F.round("merge_at", 6))
    return h.select("event_id", live.alias("bridged"))


_BRIDGED = f"{_HOLES}, bridge AS (SELECT h.event_id, (h.hi - h.lo <= {us(2.6)} AND round(h.active, 6) >= 0.55 AND round(h.mean_e, 6) >= round(t.merge_at, 6)) AS bridged FROM hole h JOIN thr t USING (court_id))"


@query(f"{ctes('pulses', 'energy')}, {_sql_thresholds()}, {_BRIDGED} SELECT event_id, bridged FROM bridge")
def bridge_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridges(spark, sf_dir)


@query(
    f"""{ctes('pulses', 'energy')}, {_sql_thresholds()}, {_BRIDGED},
    cut AS (SELECT p.*, CASE WHEN h.lo IS NULL THEN 0 WHEN h.hi - h.lo <= {MAX_SILENCE} THEN 0 WHEN coalesce(b.bridged, false) THEN 0 ELSE 1 END AS brk FROM pulses p JOIN holes h USING (event_id) LEFT JOIN bridge b USING (event_id)),
    isl AS (SELECT *, sum(brk) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM cut)
    SELECT stream_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_pulses FROM isl GROUP BY stream_id, island"""
)
def segment_bridged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouping by the bridge predicate: it depends on neighbours only, so islands are enough."""
    p = carriers.pulses(spark, sf_dir).join(bridges(spark, sf_dir), "event_id", "left")
    w = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    out = with_island(p, ["stream_id"], "ts", breaks=(gap > MAX_SILENCE) & ~F.coalesce("bridged", F.lit(False)), tie="event_id")
    return out.groupBy("stream_id", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_pulses")).drop("island")
