"""Peels of the highlight filter: the part of a span that is the own court's, and the last pulse of a walk when play goes on after it.

A dense blob of pulses is cut to the cluster that lies in the own court.  Which pulses do is a lookup in the running totals of the court's samples; where the cluster ends is the first pulse that meets a
condition on itself and its neighbour, so windows over the pulses of a span say it and no state is folded.  Only pulses of spans that a peel can touch are looked up.  Play after a last pulse is a walk over runs
of activity.  Times are microseconds; ``t0`` is where a stream's time begins.  Spans without motion, and streams without pulses, give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import UNIT, us
from ..operators.islands import with_island
from ..operators.lookup import asof, small_side
from ..operators.motion_index import active_runs, between, first_at_or_after, last_at_or_before, total
from ..operators.staging import staged
from ..sources import carriers
from ..sources.carriers import ctes
from .highlights import _LEVELS, LAND_PAD, SERVE_PAD, motion_index, motion_levels
from .registry import query
from .segments import BUCKET, _sql_islands

# Fixed values of the peels (units).
SILENCE = us(1.85)
LEAST_PULSES, LEAST_LENGTH, LEAST_DENSITY = 10, us(6), 1.7  # a dense blob
ALONE = us(3.20)  # with so much rest before it a blob begins in the own court
HOLE, CORE, CROWDED = us(1.00), us(6.0), us(0.42)
NEAR = us(0.40)
WALK_LOW, WALK_HIGH, REST, AFTER = us(1.05), us(1.40), us(5.2), us(2.8)  # the last step of a walk, the rest and the motion after it
PLAY, SURE, TAIL, QUIET = us(3.5), us(0.80), us(0.45), 3
SERVE, LAND = us(SERVE_PAD), us(LAND_PAD)
_OUT = ("stream_id", "span_first", "start_at", "end_at", "first_at", "last_at", "n_pulses")


def spans_of(p: DataFrame) -> DataFrame:
    """Pulses with their span (island) and its shape: number ``i`` from 0, ``n``, bounds, distances to the pulses around it.  ``p``: stream_id, court_id, ts, event_id, t0."""
    p = with_island(p, ["stream_id"], "ts", SILENCE, tie="event_id")
    o = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    g = Window.partitionBy("stream_id", "island")
    i = g.orderBy("ts", "event_id")
    p = p.withColumn("before", F.lag("ts").over(o)).withColumn("after", F.lead("ts").over(o))
    p = p.withColumns({"i": F.row_number().over(i) - 1, "n": F.count(F.lit(1)).over(g), "gap": F.col("ts") - F.lag("ts").over(i), "f": F.min("ts").over(g), "l": F.max("ts").over(g), "prev": F.first("before").over(i)})
    far = F.lit(us(99.0))
    iso, nx = F.coalesce(F.col("f") - F.col("prev"), far), F.coalesce(F.col("after") - F.col("l"), far)
    return p.withColumn("iso", iso).withColumn("nx", nx).drop("before", "after", "prev")


def in_court(pulses: DataFrame, index: DataFrame) -> DataFrame:
    """``event_id, own``: whether a sample within 0.4 units is at the court's level; the nearest sample decides where there is none (of two equally near ones the earlier)."""
    rows = pulses.select("court_id", "event_id", "ts")
    seen = between(rows, index.select("court_id", "ts", "n", "court"), "court_id", "ts", ["court_id", "event_id"], {"near": (F.col("ts") - NEAR, F.col("ts") + NEAR)}, BUCKET)
    seen = staged(seen.select("court_id", "event_id", (total("near", "n") > 0).alias("any"), (total("near", "court") > 0).alias("own")), "pulses-in-court")
    w = Window.partitionBy("court_id").orderBy("ts")
    single = index.select("court_id", "ts", (F.col("court") > F.coalesce(F.lag("court").over(w), F.lit(0))).alias("own"))
    lone = staged(rows.join(seen.where("not any").select("event_id"), "event_id", "left_semi"), "pulses-without-samples")
    x = staged(asof(lone, single, "court_id", "ts", ["own"], BUCKET, prefix="b_"), "pulses-sample-before")
    x = asof(x, single, "court_id", "ts", ["own"], BUCKET, forward=True, prefix="a_")
    later = F.col("b_ts").isNull() | (F.col("a_ts") - F.col("ts") < F.col("ts") - F.col("b_ts"))
    return seen.where("any").select("event_id", "own").unionByName(x.select("event_id", F.when(later, F.col("a_own")).otherwise(F.col("b_own")).alias("own")))


def court_peels(p: DataFrame, index: DataFrame) -> DataFrame:
    """The cluster of the own court in every dense blob that has one, with ``how``: ``court`` (it begins the blob) or ``core`` (behind one or two pulses from outside)."""
    d = spans_of(p)
    density = F.col("n") / F.greatest(F.lit(0.25), (F.col("l") - F.col("f")) / float(UNIT))
    dense = (F.col("n") >= LEAST_PULSES) & (F.col("l") + LAND - F.col("f") + SERVE >= LEAST_LENGTH) & (density > LEAST_DENSITY)
    d = staged(d.where(dense), "dense-blobs")
    d = d.join(in_court(d, index), "event_id")
    g = Window.partitionBy("stream_id", "island")
    o = g.orderBy("i")
    ahead = F.lead("own").over(o)
    d = d.withColumns({
        "two_out": ~F.col("own") & F.coalesce(~ahead, F.lit(False)), "one_out": ~F.col("own") & F.coalesce(ahead, F.lit(True)),
        "inside": F.coalesce(F.sum(F.col("own").cast("int")).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "all_in": F.sum(F.col("own").cast("int")).over(g), "k0": F.min(F.when(F.col("own"), F.col("i"))).over(g), "alone": F.col("iso") >= ALONE,
    })
    hole = F.col("gap") >= HOLE
    d = d.withColumn("base", F.max(F.when(F.col("i") == F.col("k0"), F.col("ts"))).over(g))
    start = F.greatest("t0", F.col("base") - SERVE)
    ends_court = (F.col("i") >= 1) & ((hole & (F.col("i") >= 3)) | F.col("two_out") | (F.col("one_out") & (F.col("i") >= 3) & (F.col("inside") >= 3)))
    ends_core = (F.col("i") > F.col("k0")) & ((F.col("ts") + LAND - start >= CORE) | (hole & (F.col("i") - F.col("k0") >= 3)) | F.col("two_out"))
    d = d.withColumn("stop", F.min(F.when(F.when(F.col("alone"), ends_court).otherwise(ends_core), F.col("i"))).over(g))
    # a court blob needs a cut; a pulse in court before two outside makes a pair; a core may reach the end
    cut = F.when(~F.col("alone"), F.coalesce("stop", "n")).when((F.col("stop") == 1) & (F.col("k0") == 0), 2).when(F.col("stop") >= 3, F.col("stop"))
    d = d.withColumn("lo", F.when(F.col("alone"), 0).otherwise(F.col("k0"))).withColumn("hi", cut)
    fits = F.when(F.col("alone"), F.col("k0") < F.least(F.lit(2), F.col("hi"))).otherwise(F.col("k0").between(1, 2) & (F.col("all_in") >= 8) & (F.col("hi") - F.col("lo") >= 3))
    core = d.where(fits & (F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")))
    out = core.groupBy("stream_id", "island", "f", "t0", "alone").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n_pulses"), F.median(F.when(F.col("i") > F.col("lo"), F.col("gap"))).alias("middle"))
    out = out.where((F.col("n_pulses") < 8) | (F.col("middle") >= CROWDED))
    return out.select("stream_id", F.col("f").alias("span_first"), F.greatest("t0", F.col("first_at") - SERVE).alias("start_at"), (F.col("last_at") + LAND).alias("end_at"), "first_at", "last_at", "n_pulses", F.when(F.col("alone"), "court").otherwise("core").alias("how"))


def play_ends(rows: DataFrame, samples: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``end_at`` to rows with ``court_id, event_id, l``: where play that goes on after the pulse at ``l`` ends.

    Activity is followed from the pulse on and ends with a stretch of more than three quiet samples that reaches 0.8 units after it; 3.5 units at most.  Of the walk only its edges are looked up: the last active
    sample before that point, the first one from it on and the end of that one's run.
    """
    runs = active_runs(samples, "court_id", "ts", "e5", F.col("energy") >= F.col("run_at"), QUIET, BUCKET)
    sure, most = F.col("l") + SURE, F.col("l") + PLAY
    x = last_at_or_before(rows, sure - 1, runs, "court_id", "ts", BUCKET, "held")
    x = first_at_or_after(x, sure, runs, "court_id", "ts", BUCKET, "again")
    x = x.withColumn("again", F.when(F.col("again") <= most, F.col("again")))
    # without a later active sample the looked up rows are not used
    x = last_at_or_before(x, F.coalesce("again", sure), runs, "court_id", "ts", BUCKET, "__own", "opens", "ahead_of").drop("__own")
    x = first_at_or_after(x, F.coalesce("again", sure) + 1, runs.where("opens"), "court_id", "ts", BUCKET, "other")
    x = staged(last_at_or_before(x, F.least(F.col("other") - 1, most), runs, "court_id", "ts", BUCKET, "reached"), "play-ends")
    quiet = between(x, index.select("court_id", "ts", "n"), "court_id", "ts", ["event_id"], {"wait": (F.col("l"), F.coalesce("ahead_of", F.col("l") - 1))}, BUCKET).select("event_id", total("wait", "n").alias("waited"))
    x = x.join(quiet, "event_id")
    held = F.when(F.col("held") >= F.col("l"), F.col("held"))
    over = F.col("opens") & F.coalesce(F.col("ahead_of") >= sure, F.lit(False)) & (held.isNotNull() | (F.col("waited") > QUIET))
    reach = F.when(F.col("again").isNull() | over, F.coalesce(held, F.col("l"))).otherwise(F.col("reached"))
    return x.withColumn("end_at", F.greatest(F.col("l") + LAND, F.least(most, reach + TAIL))).select(*rows.columns, "end_at")


def serve_peels(p: DataFrame, e: DataFrame, levels: DataFrame, index: DataFrame) -> DataFrame:
    """The last pulse of a walking blob (seven pulses and more) that rests after it while the court bursts: a serve without an answer heard."""
    d = spans_of(p)
    shape = (F.col("i") == F.col("n") - 1) & (F.col("n") >= 7) & F.col("gap").between(WALK_LOW, WALK_HIGH) & (F.col("nx") >= REST)
    d = staged(d.where(shape).select("stream_id", "court_id", "event_id", "f", "l", "t0"), "walks-to-serve")
    seen = between(d, index, "court_id", "ts", ["event_id"], {"hot": (F.col("l"), F.col("l") + AFTER)}, BUCKET)
    three = F.col("hot_1.triple_ends") - F.col("hot_0.triple_starts") > 0  # a triple that ends in the range and does not begin before it
    hot = seen.where((total("hot", "peak") > 0) | three).select("event_id")
    d = play_ends(staged(d.join(hot, "event_id", "left_semi"), "serves"), e.join(levels, "court_id"), index)
    return d.select("stream_id", F.col("f").alias("span_first"), F.greatest("t0", F.col("l") - SERVE).alias("start_at"), "end_at", F.col("l").alias("first_at"), F.col("l").alias("last_at"), F.lit(1).cast("long").alias("n_pulses"))


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    p, e = carriers.pulses(spark, sf_dir).select("stream_id", "court_id", "ts", "event_id"), carriers.energy(spark, sf_dir)
    levels = small_side(motion_levels(e), "court-levels")  # a row for each court
    begin: Column = F.min("ts").over(Window.partitionBy("stream_id")) - us(0.5)
    return p.withColumn("t0", begin), e, levels, motion_index(e, levels)


_SPANS = f"""{_sql_islands('pulses', 'stream_id', SILENCE, extra=', event_id')}, {_LEVELS},
  pa AS (SELECT *, min(ts) OVER (PARTITION BY stream_id) - {us(0.5)} AS t0, lag(ts) OVER o AS bef, lead(ts) OVER o AS aft FROM isl WINDOW o AS (PARTITION BY stream_id ORDER BY ts, event_id)),
  pb AS (SELECT stream_id, court_id, island, event_id, ts, t0, row_number() OVER i - 1 AS i, count(*) OVER g AS n, ts - lag(ts) OVER i AS gap, min(ts) OVER g AS f, max(ts) OVER g AS l,
    coalesce(min(ts) OVER g - first_value(bef) OVER i, {us(99.0)}) AS iso, coalesce(aft - max(ts) OVER g, {us(99.0)}) AS nx FROM pa WINDOW g AS (PARTITION BY stream_id, island), i AS (PARTITION BY stream_id, island ORDER BY ts, event_id))"""
#: Every pulse is a sample of its own court, so that none is without a sample near it.
_PEELED = f"""{_SPANS}, de AS (SELECT * FROM pb WHERE n >= {LEAST_PULSES} AND l - f + {LAND + SERVE} >= {LEAST_LENGTH} AND n / greatest(0.25, (l - f) / {UNIT}.0) > {LEAST_DENSITY}),
  ow AS (SELECT d.event_id, max(e.energy) >= any_value(lv.court_at) AS own FROM de d JOIN lv USING (court_id) JOIN energy e ON e.court_id = d.court_id AND e.ts BETWEEN d.ts - {NEAR} AND d.ts + {NEAR} GROUP BY 1),
  ma AS (SELECT de.*, own, lead(own) OVER o AS ahead, list(own) OVER (PARTITION BY stream_id, island ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS owns FROM de JOIN ow USING (event_id) WINDOW o AS (PARTITION BY stream_id, island ORDER BY i)),
  mb AS (SELECT *, coalesce(list_position(owns, true) - 1, -1) AS k0, len(list_filter(owns, lambda x: x)) AS all_in, len(list_filter(owns[1:i], lambda x: x)) AS inside FROM ma),
  mc AS (SELECT *, greatest(t0, max(CASE WHEN i = k0 THEN ts END) OVER (PARTITION BY stream_id, island) - {SERVE}) AS s0 FROM mb),
  st AS (SELECT stream_id, island, min(CASE WHEN iso >= {ALONE} AND i >= 1 AND (gap >= {HOLE} AND i >= 3 OR NOT own AND NOT ahead OR NOT own AND coalesce(ahead, true) AND i >= 3 AND inside >= 3) THEN i
      WHEN iso < {ALONE} AND i > k0 AND (ts + {LAND} - s0 >= {CORE} OR gap >= {HOLE} AND i - k0 >= 3 OR NOT own AND NOT ahead) THEN i END) AS stop FROM mc GROUP BY 1, 2),
  cu AS (SELECT mc.*, CASE WHEN iso >= {ALONE} THEN 0 ELSE k0 END AS lo, CASE WHEN iso < {ALONE} THEN coalesce(stop, n) WHEN stop = 1 AND owns[1] THEN 2 WHEN stop >= 3 THEN stop END AS hi FROM mc JOIN st USING (stream_id, island)),
  co AS (SELECT stream_id, f AS span_first, t0, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_pulses, median(CASE WHEN i > lo THEN gap END) AS middle, CASE WHEN iso >= {ALONE} THEN 'court' ELSE 'core' END AS how FROM cu
    WHERE i >= lo AND i < hi AND CASE WHEN iso >= {ALONE} THEN owns[1] OR owns[2] ELSE k0 BETWEEN 1 AND 2 AND all_in >= 8 AND hi - lo >= 3 END GROUP BY ALL),
  pe AS (SELECT stream_id, span_first, greatest(t0, first_at - {SERVE}) AS start_at, last_at + {LAND} AS end_at, first_at, last_at, n_pulses, how FROM co WHERE n_pulses < 8 OR middle >= {CROWDED})"""
_SERVES = f"""{_SPANS}, ca AS (SELECT * FROM pb WHERE i = n - 1 AND n >= 7 AND gap BETWEEN {WALK_LOW} AND {WALK_HIGH} AND nx >= {REST}),
  wi AS (SELECT c.event_id, c.l, e.ts, row_number() OVER (PARTITION BY c.event_id ORDER BY e.ts, e.e5) AS j, e.energy >= lv.run_at AS hot, e.energy >= lv.peak_at AS peak FROM ca c JOIN lv USING (court_id) JOIN energy e ON e.court_id = c.court_id AND e.ts BETWEEN c.l AND c.l + {PLAY}),
  wq AS (SELECT *, j - coalesce(max(CASE WHEN hot THEN j END) OVER w, 0) AS quiet, hot AND lag(hot, 1, false) OVER w AND lag(hot, 2, false) OVER w AND ts <= l + {AFTER} AS three FROM wi WINDOW w AS (PARTITION BY event_id ORDER BY j)),
  bk AS (SELECT event_id, bool_or(three OR peak AND ts <= l + {AFTER}) AS burst, min(CASE WHEN quiet > {QUIET} AND ts >= l + {SURE} THEN j END) AS stop FROM wq GROUP BY 1),
  re AS (SELECT event_id, max(CASE WHEN hot AND (stop IS NULL OR j < stop) THEN ts END) AS reach FROM wq JOIN bk USING (event_id) GROUP BY 1)
  SELECT stream_id, f AS span_first, greatest(t0, l - {SERVE}) AS start_at, greatest(l + {LAND}, least(l + {PLAY}, coalesce(reach, l) + {TAIL})) AS end_at, l AS first_at, l AS last_at, CAST(1 AS BIGINT) AS n_pulses FROM ca JOIN bk USING (event_id) JOIN re USING (event_id) WHERE burst"""


@query(f"{ctes('pulses', 'energy')}, {_PEELED} SELECT {', '.join(_OUT)} FROM pe WHERE how = 'court'")
def peel_own_court(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cluster of the own court, off a dense blob that goes on next door."""
    p, _, _, index = _inputs(spark, sf_dir)
    return court_peels(p, index).where("how = 'court'").select(*_OUT)


@query(f"{ctes('pulses', 'energy')}, {_PEELED} SELECT {', '.join(_OUT)} FROM pe WHERE how = 'core'")
def peel_court_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core in court behind one or two pulses from outside, six units long at most."""
    p, _, _, index = _inputs(spark, sf_dir)
    return court_peels(p, index).where("how = 'core'").select(*_OUT)


@query(f"{ctes('pulses', 'energy')}, {_SERVES}")
def peel_last_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last pulse of a walking blob, when play goes on after it in silence."""
    return serve_peels(*_inputs(spark, sf_dir)).select(*_OUT)
