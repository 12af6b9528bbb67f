"""Scans: sampled frames, pictures, windows, resampled signals, grids and hops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import picture
from ..functions.units import us
from ..operators import folds, intervals
from ..operators.islands import with_island
from ..operators.lookup import asof, band
from ..sources import carriers
from ..sources.carriers import ctes, table
from .registry import query
from .segments import BUCKET
from .tracks import _SPANS_P, pulse_spans

#: Frames a second of the source and of the scan.
FPS, SCAN_FPS = 30.0, 8.0
STRIDE, STRIDE_DOWN = max(1, round(FPS / SCAN_FPS)), max(1, int(FPS / 5.0))
_FRAMES = "fr AS (SELECT stream_id, ts, x, y, row_number() OVER (PARTITION BY stream_id ORDER BY ts, x, y) - 1 AS frame_no FROM track)"


@query(
    f"""{ctes('track')}, {_FRAMES}, s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM fr WHERE frame_no % {STRIDE} = 0 WINDOW w AS (PARTITION BY stream_id ORDER BY frame_no))
    SELECT stream_id, frame_no, ts, frame_no % {STRIDE_DOWN} = 0 AS in_coarse_scan, round(abs(x - px), 9) AS dx, round(abs(y - py), 9) AS dy, abs(x - px) > 0.18 OR abs(y - py) > 0.18 AS changed FROM s"""
)
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th frame of a stream and its difference from the sampled frame before (the rounded and the truncated stride)."""
    w = Window.partitionBy("stream_id")
    fr = carriers.track(spark, sf_dir).withColumn("frame_no", (F.row_number().over(w.orderBy("ts", "x", "y")) - 1).cast("long")).where(F.col("frame_no") % STRIDE == 0)
    before = w.orderBy("frame_no")
    dx, dy = F.abs(F.col("x") - F.lag("x").over(before)), F.abs(F.col("y") - F.lag("y").over(before))
    s = fr.withColumn("dx", dx).withColumn("dy", dy)
    return s.select("stream_id", "frame_no", "ts", (F.col("frame_no") % STRIDE_DOWN == 0).alias("in_coarse_scan"), F.round("dx", 9).alias("dx"), F.round("dy", 9).alias("dy"), ((F.col("dx") > 0.18) | (F.col("dy") > 0.18)).alias("changed"))


def pictures(spark: SparkSession, sf_dir: str, cameras: int = 10) -> DataFrame:
    """``camera_id, frame_no, pixels``: vectors as grey pictures, each beside the one before of its camera."""
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % cameras).alias("camera_id"), F.floor(F.col("vec_id") / cameras).alias("frame_no"), F.col("embedding").alias("pixels"))
    return e


def court_change(frames: DataFrame, threshold: float = 0.05, wide: int = 8) -> DataFrame:
    """``camera_id, frame_no, energy``: the share of the court that changed since the frame before.

    Neighbour frames meet by an equi-join on the frame number, so one camera with most of the frames is spread.
    """
    before = frames.select("camera_id", (F.col("frame_no") + 1).alias("frame_no"), F.col("pixels").alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            energy = []
            for after, old in zip(b["pixels"], b["before"], strict=True):
                n = len(after) // wide * wide
                a, o = (np.asarray(v, float)[:n].reshape(-1, wide) for v in (after, old))
                court = np.zeros(a.shape, bool)
                court[1:, 1:-1] = True
                energy.append(picture.change_ratio(o, a, court, threshold))
            yield pd.DataFrame({"camera_id": b["camera_id"], "frame_no": b["frame_no"], "energy": energy})

    return frames.join(before, ["camera_id", "frame_no"]).mapInPandas(run, "camera_id long, frame_no long, energy double")


@query()
def court_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed, thresholded and opened difference of neighbour pictures in the court (tested against plain loops)."""
    return court_change(pictures(spark, sf_dir))


@query(
    f"""{ctes('pulses', 'track')}, {_SPANS_P}, w AS (SELECT stream_id, f - {us(3.2)} AS a, f + {us(0.45)} AS b FROM ps UNION ALL SELECT stream_id, l - {us(0.15)}, l + {us(3.4)} FROM ps)
    SELECT stream_id, ts, round(x, 9) AS x, round(y, 9) AS y FROM track t WHERE EXISTS (SELECT 1 FROM w WHERE w.stream_id = t.stream_id AND t.ts BETWEEN w.a AND w.b)"""
)
def windowed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that lie in any candidate window.  Overlapping windows are merged first, so each frame meets one of them at most."""
    s = pulse_spans(spark, sf_dir)
    two = F.array(F.struct((F.col("first") - us(3.2)).alias("s"), (F.col("first") + us(0.45)).alias("e")), F.struct((F.col("last") - us(0.15)).alias("s"), (F.col("last") + us(3.4)).alias("e")))
    w = s.select("stream_id", F.explode(two).alias("x")).select("stream_id", F.col("x.s").alias("start"), F.col("x.e").alias("end"))
    hit = band(intervals.merge(w, 0), carriers.track(spark, sf_dir), "stream_id", F.col("start"), F.col("end"), "ts", BUCKET)
    return hit.select("stream_id", F.col("r_ts").alias("ts"), F.round("r_x", 9).alias("x"), F.round("r_y", 9).alias("y"))


#: Input samples for two output samples, as whole numbers, and the most samples of a stream.
STEP_UP, STEP_DOWN, MOST = 3, 2, 5_000


@query(
    f"""{ctes('track')}, m AS (SELECT stream_id, (x + y) / 2 AS v, row_number() OVER w - 1 AS i, lead((x + y) / 2) OVER w AS nv FROM track WINDOW w AS (PARTITION BY stream_id ORDER BY ts, x, y)),
    o AS (SELECT stream_id, i, v, nv, unnest(generate_series(CAST((i * {STEP_DOWN} + {STEP_UP - 1}) // {STEP_UP} AS BIGINT), CAST(((i + 1) * {STEP_DOWN} + {STEP_UP - 1}) // {STEP_UP} - 1 AS BIGINT))) AS j FROM m WHERE nv IS NOT NULL OR i = 0)
    SELECT stream_id, j, round(v * (1 - (j * {STEP_UP} / {STEP_DOWN}.0 - i)) + coalesce(nv, 0) * (j * {STEP_UP} / {STEP_DOWN}.0 - i), 9) AS sample FROM o WHERE j < {MOST} AND (nv IS NOT NULL OR j = 0)"""
)
def resampled_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mono mean of two channels, resampled by linear interpolation at 2 / 3 of the rate.

    An online resampler carries its phase from sample to sample; as the phase is a multiple of the step, each pair of neighbour samples
    knows which outputs lie between them, and no order of processing is needed.
    """
    w = Window.partitionBy("stream_id").orderBy("ts", "x", "y")
    v = (F.col("x") + F.col("y")) / 2
    m = carriers.track(spark, sf_dir).select("stream_id", v.alias("v"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.lead(v).over(w).alias("nv"))
    ceil = lambda i: F.floor((i * STEP_DOWN + STEP_UP - 1) / STEP_UP)
    first, last = ceil(F.col("i")), ceil(F.col("i") + 1) - 1
    outputs = F.when(F.col("nv").isNotNull() & (last >= first), F.sequence(first, last)).when(F.col("nv").isNull() & (F.col("i") == 0), F.array(F.lit(0).cast("long")))
    o = m.select("*", F.explode(outputs).alias("j")).where(F.col("j") < MOST)
    frac = F.col("j") * STEP_UP / float(STEP_DOWN) - F.col("i")
    return o.select("stream_id", "j", F.round(F.col("v") * (1 - frac) + F.coalesce("nv", F.lit(0.0)) * frac, 9).alias("sample"))


_GRID = us(4.0)


@query(
    f"""{ctes('pulses')}, k AS (SELECT DISTINCT stream_id, ts FROM pulses WHERE event_id % 3 = 0), r AS (SELECT stream_id, min(ts) AS a, max(ts) AS z FROM pulses GROUP BY 1),
    g AS (SELECT stream_id, unnest(generate_series(a, z, {_GRID})) AS t FROM r),
    b AS (SELECT g.stream_id, g.t, k.ts AS bt FROM g ASOF LEFT JOIN k ON g.stream_id = k.stream_id AND g.t >= k.ts), f AS (SELECT g.stream_id, g.t, k.ts AS ft FROM g ASOF LEFT JOIN k ON g.stream_id = k.stream_id AND g.t <= k.ts)
    SELECT stream_id, t, CASE WHEN ft IS NULL OR t - bt <= ft - t THEN bt ELSE ft END AS key_ts FROM b JOIN f USING (stream_id, t) WHERE bt IS NOT NULL OR ft IS NOT NULL"""
)
def keyframe_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular grid of times and the keyframe nearest to each (of two as near the earlier)."""
    p = carriers.pulses(spark, sf_dir).select("stream_id", "ts", "event_id")
    g = p.groupBy("stream_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).select("stream_id", F.explode(F.sequence("a", "z", F.lit(_GRID))).alias("ts"))
    k = p.where("event_id % 3 = 0").select("stream_id", "ts")
    near = asof(asof(g, k, "stream_id", "ts", [], BUCKET, prefix="b_"), k, "stream_id", "ts", [], BUCKET, forward=True, prefix="f_")
    early = F.col("f_ts").isNull() | (F.col("ts") - F.col("b_ts") <= F.col("f_ts") - F.col("ts"))
    return near.where("b_ts is not null or f_ts is not null").select("stream_id", F.col("ts").alias("t"), F.when(early, F.col("b_ts")).otherwise(F.col("f_ts")).alias("key_ts"))


#: About so many samples make the statistics of a series.
SAMPLED = 50


@query(
    f"""{ctes('energy')}, r AS (SELECT court_id, energy, row_number() OVER (PARTITION BY court_id ORDER BY ts, e5) - 1 AS i, count(*) OVER (PARTITION BY court_id) AS n FROM energy),
    s AS (SELECT court_id, energy FROM r WHERE i % greatest(1, n // {SAMPLED}) = 0), m AS (SELECT court_id, median(energy) AS m FROM s GROUP BY 1)
    SELECT court_id, count(*) AS n_sampled, round(any_value(m), 9) AS median, round(median(abs(energy - m)) * 1.4826, 9) AS sigma FROM s JOIN m USING (court_id) GROUP BY court_id"""
)
def strided_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and scaled absolute deviation of about 50 samples of a series, taken at a fixed stride."""
    w = Window.partitionBy("court_id")
    r = carriers.energy(spark, sf_dir).withColumn("i", F.row_number().over(w.orderBy("ts", "e5")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    s = r.where(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / SAMPLED)) == 0).select("court_id", "energy")
    m = s.groupBy("court_id").agg(F.median("energy").alias("m"))
    out = s.join(m, "court_id").groupBy("court_id").agg(F.count(F.lit(1)).alias("n_sampled"), F.first("m").alias("m"), (F.median(F.abs(F.col("energy") - F.col("m"))) * 1.4826).alias("s"))
    return out.select("court_id", "n_sampled", F.round("m", 9).alias("median"), F.round("s", 9).alias("sigma"))


_HOP = us(0.5)


@query(
    f"""{ctes('energy')} SELECT court_id, ts // {_HOP} AS hop, count(*) AS n, round(sqrt(avg(energy * energy * (0.35 + abs(energy)))), 9) AS shaped FROM energy GROUP BY 1, 2"""
)
def energy_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hops: the root of the mean of samples shaped so that bursts count more than rumble."""
    e = carriers.energy(spark, sf_dir)
    shaped = F.avg(F.col("energy") * F.col("energy") * (0.35 + F.abs("energy")))
    return e.groupBy("court_id", F.floor(F.col("ts") / _HOP).alias("hop")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(shaped), 9).alias("shaped"))


#: Samples on each side of a peak that its prominence is measured against.
FLANK = 80


@query(
    f"""{ctes('energy')}, z AS (SELECT court_id, ts, e5, lag(e5) OVER w AS a, lead(e5) OVER w AS b, coalesce(lag(e5, {FLANK}) OVER w, first_value(e5) OVER w) AS l, coalesce(lead(e5, {FLANK}) OVER w, first_value(e5) OVER d) AS r
      FROM energy WINDOW w AS (PARTITION BY court_id ORDER BY ts, e5), d AS (PARTITION BY court_id ORDER BY ts DESC, e5 DESC))
    SELECT court_id, ts, e5, e5 - greatest(l, r) AS prominence FROM z WHERE e5 >= coalesce(a, e5) AND e5 >= coalesce(b, e5) AND e5 - greatest(l, r) >= 2500"""
)
def peak_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local peaks that stand out from the samples a fixed distance before and after (at the ends of a series: its first and last)."""
    w = Window.partitionBy("court_id").orderBy("ts", "e5")
    back = Window.partitionBy("court_id").orderBy(F.desc("ts"), F.desc("e5"))
    left, right = F.coalesce(F.lag("e5", FLANK).over(w), F.first("e5").over(w)), F.coalesce(F.lead("e5", FLANK).over(w), F.first("e5").over(back))
    z = carriers.energy(spark, sf_dir).select("court_id", "ts", "e5", F.lag("e5").over(w).alias("a"), F.lead("e5").over(w).alias("b"), (F.col("e5") - F.greatest(left, right)).alias("prominence"))
    return z.where((F.col("e5") >= F.coalesce("a", "e5")) & (F.col("e5") >= F.coalesce("b", "e5")) & (F.col("prominence") >= 2500)).select("court_id", "ts", "e5", "prominence")


#: Distance of two sampled frames by their stamps, and the most frames of a stream.
INTERVAL, MOST_FRAMES = us(2.0), 40


@query(
    f"""{ctes('track').replace('WITH', 'WITH RECURSIVE', 1)}, o AS (SELECT stream_id, ts, row_number() OVER (PARTITION BY stream_id ORDER BY ts) AS k FROM track), r AS (
      SELECT stream_id, k, ts, ts + {INTERVAL} AS nxt, true AS took, 1 AS n FROM o WHERE k = 1
      UNION ALL SELECT o.stream_id, o.k, o.ts, CASE WHEN o.ts >= r.nxt THEN o.ts + {INTERVAL} ELSE r.nxt END, o.ts >= r.nxt, CASE WHEN o.ts >= r.nxt THEN r.n + 1 ELSE r.n END FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1)
    SELECT stream_id, ts, n FROM r WHERE took AND n <= {MOST_FRAMES}"""
)
def frames_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame is taken when its stamp reaches the next sample time, which is then an interval later; so many at most."""
    t = with_island(carriers.track(spark, sf_dir).select("stream_id", "ts"), ["stream_id"], "ts", INTERVAL)
    kept = folds.refractory(t, ["stream_id", "island"], "ts", INTERVAL).select("stream_id", "ts")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("stream_id").orderBy("ts"))).where(F.col("n") <= MOST_FRAMES)
