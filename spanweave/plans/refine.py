"""Court-aware refinement: classes of pulses, bridges, absorbed soft pulses, walks along motion, merges and expansion.

Motion between two pulses comes from a band join in time buckets; what depends on neighbours only is a window, and what depends on earlier
decisions a fold over a chain of spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import us
from ..operators import folds
from ..operators.islands import with_island
from ..operators.lookup import asof, band, small_side
from ..operators.motion_index import active_runs, between, last_at_or_before, running, total
from ..operators.staging import staged
from ..sources import carriers
from ..sources.carriers import ctes
from .registry import query
from .segments import _LOCAL, BUCKET, _sql_islands, _sql_thresholds, court_stats, level_index, local_motion, mean_between, share_between, thresholds

#: The standard profile with a wide bridge, and the strict one (units).
SILENCE, BRIDGE, LEAD_CAP, PURE_CAP = us(1.85), us(4.2), us(3.2), us(4.5)
LANDING, RESIDUAL_WINDOW, LOOKBACK, SERVE_LEAD, MOST = us(1.0), us(1.4), us(2.0), us(0.35), us(20.0)
#: Samples in a row that may be quiet: 0.40 and 0.45 of a second at 8 samples a second.
QUIET_BACK, QUIET_AHEAD = 3, 4
_IN = ctes("pulses", "energy")

# Fixed values of the profiles (units): silence, bridge, longest hole bridged by motion alone, share of motion around a soft pulse, reach of trailing and leading soft pulses; whether
# every pulse makes groups, and whether leading soft pulses must be lively.
PROFILES = {
    "strict": (1.85, 4.2, 2.6, 0.32, 0.85, 3.2, True, False),
    "standard": (1.85, 4.2, 4.5, 0.30, 4.2, 3.2, False, False),
    "device": (2.45, 4.2, 2.6, 0.32, 0.85, 3.5, True, True),
}
V = ["v_silence", "v_bridge", "v_pure", "v_share", "v_trail", "v_lead", "v_every", "v_lively"]


def profile_values(name: str) -> dict:
    silence, bridge, pure, share, trail, lead, every, lively = PROFILES[name]
    return dict(zip(V, (us(silence), us(bridge), us(min(bridge, pure)), share, us(min(bridge, trail)), us(min(bridge, lead)), every, lively), strict=True))


def one_profile(df: DataFrame, name: str = "standard") -> DataFrame:
    """All streams by one profile, if they have none."""
    return df if V[0] in df.columns else df.withColumns({k: F.lit(x) for k, x in profile_values(name).items()})


def stream_profiles(df: DataFrame) -> DataFrame:
    """Each stream by its own profile, from the table of profiles (three rows), joined by the stream's choice ``profile``."""
    rows = [(name, *profile_values(name).values()) for name in PROFILES]
    table = df.sparkSession.createDataFrame(rows, "profile string, v_silence long, v_bridge long, v_pure long, v_share double, v_trail long, v_lead long, v_every boolean, v_lively boolean")
    return df.join(F.broadcast(table), "profile")


_CLASS = f"""{_sql_thresholds()}, {_LOCAL}, h AS (SELECT stream_id, median(height) AS hm FROM pulses GROUP BY 1),
    cls AS (SELECT l.event_id, l.stream_id, l.court_id, l.ts, l.height, l.near_max AS motion, near_max >= support AS in_court, height >= 1.55 * hm AS strong, near_max >= bridge OR height >= 1.55 * hm OR near_max >= support AS soft, support, bridge, residual, merge_at, onset
      FROM local l JOIN thr USING (court_id) JOIN h USING (stream_id))"""


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(carriers.pulses(spark, sf_dir), carriers.energy(spark, sf_dir))


def classify(p: DataFrame, e: DataFrame) -> DataFrame:
    """Pulses with their motion, the court's thresholds and their classes; ``supported`` ones make groups in the standard profile."""
    h = p.groupBy("stream_id").agg(F.median("height").alias("hm"))
    x = local_motion(p, e).join(thresholds(court_stats(e)), "court_id").join(h, "stream_id")
    strong, inside = F.col("height") >= 1.55 * F.col("hm"), F.col("motion") >= F.col("support")
    return x.select("event_id", "stream_id", "court_id", "ts", "height", "motion", inside.alias("in_court"), strong.alias("strong"), ((F.col("motion") >= F.col("bridge")) | strong | inside).alias("soft"), (inside | strong).alias("supported"), "support", "bridge", "residual", "merge_at", "onset")


@query(f"{_IN}, {_CLASS} SELECT event_id, round(motion, 6) AS motion, in_court, strong, soft, in_court OR strong AS supported FROM cls")
def pulse_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In court, strong, soft, and supported (standard profile; the strict one groups every pulse)."""
    return classes(spark, sf_dir).select("event_id", F.round("motion", 6).alias("motion"), "in_court", "strong", "soft", "supported")


def _sql_motion(source: str, out: str, level: str = "residual") -> str:
    """Mean energy and share of active samples between ``lo`` and ``hi`` of rows ``id, court_id``."""
    return f"""{out} AS (SELECT w.id, count(e.energy) AS n, coalesce(sum(e.e5) / (count(e.energy) * 100000.0), 0) AS mean_e, coalesce(sum(CASE WHEN e.energy >= w.{level} THEN 1 ELSE 0 END) / (count(e.energy) * 1.0), 0) AS active
      FROM {source} w LEFT JOIN energy e ON e.court_id = w.court_id AND e.ts BETWEEN w.lo AND w.hi GROUP BY 1)"""


def motion_between(holes: DataFrame, e: DataFrame, level: str = "residual") -> DataFrame:
    """Adds ``mean_e`` and ``active`` (0 without samples; active at the court's ``level``) to rows ``id, court_id, lo, hi``, one for each id."""
    index = level_index(e, small_side(thresholds(court_stats(e)).select("court_id", level), "court-thresholds"), {"active": level})
    seen = between(holes, index, "court_id", "ts", ["id"], {"hole": (F.col("lo"), F.col("hi"))}, BUCKET)
    return holes.join(seen.select("id", mean_between("hole"), share_between("hole", "active")), "id")


_PURE = f"hi - lo <= {min(BRIDGE, PURE_CAP)} AND round(active, 9) >= 0.55 AND round(mean_e, 9) >= round(merge_at, 9)"
_BRIDGES = f"""{_CLASS}, sup AS (SELECT * FROM cls WHERE in_court OR strong), hol AS (SELECT *, event_id AS id, lag(ts) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS lo, ts AS hi FROM sup),
    wid AS (SELECT * FROM hol WHERE hi - lo > {SILENCE} AND hi - lo <= {BRIDGE}), {_sql_motion('wid', 'mot')},
    sof AS (SELECT w.id, count(*) AS n_soft FROM wid w JOIN cls c ON c.stream_id = w.stream_id AND c.soft AND c.motion >= c.bridge AND c.ts > w.lo + {us(0.05)} AND c.ts < w.hi - {us(0.05)} GROUP BY 1),
    bri AS (SELECT w.id, w.stream_id, w.lo, w.hi, coalesce(n_soft, 0) AS n_soft, ({_PURE}) OR (coalesce(n_soft, 0) > 0 AND round(active, 9) >= 0.30) AS bridged FROM wid w JOIN mot USING (id) LEFT JOIN sof USING (id))"""


def pure_motion() -> Column:
    return (F.col("hi") - F.col("lo") <= F.col("v_pure")) & (F.round("active", 9) >= 0.55) & (F.round("mean_e", 9) >= F.round("merge_at", 9))


def soft_inside(holes: DataFrame, lively: DataFrame, name: str) -> DataFrame:
    """``id`` and the number of lively soft pulses strictly inside each hole, by running counts."""
    index = running(lively.select("stream_id", "ts"), "stream_id", "ts", {"n": F.lit(1)}, BUCKET)
    return between(holes, index, "stream_id", "ts", ["id"], {"in": (F.col("lo") + us(0.05) + 1, F.col("hi") - us(0.05) - 1)}, BUCKET).select("id", total("in", "n").alias(name))


def grouping(c: DataFrame) -> Column:
    """Pulses that make groups."""
    return F.col("supported") | F.col("v_every")


def bridged_holes(c: DataFrame, e: DataFrame) -> DataFrame:
    """Holes between grouping pulses that are too long for silence: soft pulses inside, and whether they are bridged (classes without a profile: the standard one)."""
    c = one_profile(c)
    w = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    holes = c.where(grouping(c)).select("stream_id", "court_id", F.col("event_id").alias("id"), F.lag("ts").over(w).alias("lo"), F.col("ts").alias("hi"), "merge_at", *V)
    holes = staged(holes.where((F.col("hi") - F.col("lo") > F.col("v_silence")) & (F.col("hi") - F.col("lo") <= F.col("v_bridge"))), "group-holes")
    holes = motion_between(holes, e).join(soft_inside(holes, c.where("soft and motion >= bridge"), "n_soft"), "id")
    return holes.withColumn("bridged", pure_motion() | ((F.col("n_soft") > 0) & (F.round("active", 9) >= F.col("v_share"))))


@query(f"{_IN}, {_BRIDGES} SELECT id AS event_id, lo, hi, n_soft, bridged FROM bri")
def bridge_predicate_standard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holes bridged by motion, or by a soft pulse strictly inside with some motion around."""
    h = bridged_holes(staged(one_profile(classes(spark, sf_dir)), "pulse-classes"), carriers.energy(spark, sf_dir))
    return h.select(F.col("id").alias("event_id"), "lo", "hi", "n_soft", "bridged")


_GROUPS = f"""{_BRIDGES}, brk AS (SELECT h.*, CASE WHEN h.lo IS NULL OR h.hi - h.lo <= {SILENCE} OR coalesce(bridged, false) THEN 0 ELSE 1 END AS brk FROM hol h LEFT JOIN bri USING (id)),
    grp AS (SELECT *, sum(brk) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM brk),
    groups AS (SELECT stream_id, island, any_value(court_id) AS court_id, min(ts) AS f, max(ts) AS l, count(*) AS n FROM grp GROUP BY 1, 2)"""


def groups(c: DataFrame, e: DataFrame) -> DataFrame:
    """``stream_id, island, court_id, f, l, n``: grouping pulses by the bridge predicate."""
    c = one_profile(c)
    w = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    s = c.where(grouping(c)).join(bridged_holes(c, e).select(F.col("id").alias("event_id"), "bridged"), "event_id", "left")
    gap = F.col("ts") - F.lag("ts").over(w)
    s = with_island(s, ["stream_id"], "ts", breaks=(gap > F.col("v_silence")) & ~F.coalesce("bridged", F.lit(False)), tie="event_id")
    return s.groupBy("stream_id", "island").agg(F.first("court_id").alias("court_id"), F.min("ts").alias("f"), F.max("ts").alias("l"), F.count(F.lit(1)).alias("n"))


# --- soft pulses around a group ----------------------------------------------------------------------------------------

_PAIRS = f"""{_GROUPS}, sft AS (SELECT DISTINCT stream_id, court_id, ts, residual, merge_at, bool_or(motion >= bridge) OVER (PARTITION BY stream_id, ts) AS lively FROM cls WHERE soft),
    pr AS (SELECT a.stream_id, a.court_id, a.ts AS lo, b.ts AS hi, b.lively, a.residual, a.merge_at, row_number() OVER () AS id FROM sft a JOIN sft b ON a.stream_id = b.stream_id AND b.ts > a.ts AND b.ts - a.ts <= {BRIDGE}), {_sql_motion('pr', 'pmo')},
    pin AS (SELECT DISTINCT p.id FROM pr p JOIN sft s ON s.stream_id = p.stream_id AND s.lively AND s.ts > p.lo + {us(0.05)} AND s.ts < p.hi - {us(0.05)}),
    ok AS (SELECT stream_id, lo, hi, lively, hi - lo <= {SILENCE} OR ({_PURE}) OR (pin.id IS NOT NULL AND round(active, 9) >= 0.30) AS ok FROM pr JOIN pmo USING (id) LEFT JOIN pin USING (id)),
    nxt AS (SELECT stream_id, lo, min(hi) AS hi FROM ok WHERE ok AND lively GROUP BY 1, 2),
    lnk AS (SELECT s.stream_id, s.ts, lag(s.ts) OVER (PARTITION BY s.stream_id ORDER BY s.ts) AS before FROM sft s),
    lead_ok AS (SELECT l.*, CASE WHEN before IS NULL OR ts - before > {LEAD_CAP} OR NOT ok.ok THEN 1 ELSE 0 END AS brk FROM lnk l LEFT JOIN ok ON ok.stream_id = l.stream_id AND ok.lo = l.before AND ok.hi = l.ts),
    lead_isl AS (SELECT *, sum(brk) OVER (PARTITION BY stream_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM lead_ok), lead_of AS (SELECT stream_id, ts, min(ts) OVER (PARTITION BY stream_id, run) AS first_ts FROM lead_isl)"""


def soft_pulses(c: DataFrame, ends: DataFrame) -> DataFrame:
    """Soft pulses and the ends of groups (rows ``stream_id, ts``) by time: ``soft``, ``lively``, the soft pulse ``before`` each (``after_lively``: whether that is lively), the next lively one ``ahead``."""
    each = c.groupBy("stream_id", "ts").agg(
        F.first("court_id").alias("court_id"), F.first("merge_at").alias("merge_at"), F.max("soft").alias("soft"), F.max(F.col("soft") & (F.col("motion") >= F.col("bridge"))).alias("lively"), *[F.first(v).alias(v) for v in V]
    )
    each = each.join(ends.distinct().withColumn("end", F.lit(True)), ["stream_id", "ts"], "left").where("soft or end")
    w = Window.partitionBy("stream_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    # from the other end: a frame that grows
    back = Window.partitionBy("stream_id").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("soft"), F.struct("ts", "lively")), ignorenulls=True).over(w)
    each = each.withColumn("__b", last).withColumn("ahead", F.last(F.when(F.col("lively"), F.col("ts")), ignorenulls=True).over(back))
    return each.select("*", F.col("__b.ts").alias("before"), F.col("__b.lively").alias("after_lively")).drop("__b", "end")


def far_pairs(soft: DataFrame, e: DataFrame) -> DataFrame:
    """``stream_id, lo, hi, ok``: whether the bridge predicate holds over holes that are too long for silence.

    Only holes that decide are asked about: those to the soft pulse before, and from a pulse whose next lively one is beyond silence to the lively ones in reach (a nearer one holds without a test).
    """
    silence = F.col("v_silence")
    near = soft.select("stream_id", "court_id", "merge_at", *V, F.col("before").alias("lo"), F.col("ts").alias("hi")).where((F.col("hi") - F.col("lo") > silence) & (F.col("hi") - F.col("lo") <= F.col("v_lead")))
    waits = soft.where(F.col("ahead") - F.col("ts") > silence).select("stream_id", "court_id", "merge_at", *V, F.col("ts").alias("lo"))
    lively = soft.where("lively").select("stream_id", "ts")
    far = band(waits, lively, "stream_id", F.col("lo") + silence + 1, F.col("lo") + F.col("v_trail"), "ts", BUCKET).withColumnRenamed("r_ts", "hi")
    asked = staged(near.unionByName(far).dropDuplicates(["stream_id", "lo", "hi"]).withColumn("id", F.struct("stream_id", "lo", "hi")), "soft-holes")
    seen = motion_between(asked, e).join(soft_inside(asked, lively, "n_soft"), "id")
    return seen.select("stream_id", "lo", "hi", (pure_motion() | ((F.col("n_soft") > 0) & (F.round("active", 9) >= F.col("v_share")))).alias("ok"))


def absorb(c: DataFrame, e: DataFrame) -> DataFrame:
    """``stream_id, f, l, n, first_ts, last_ts``: groups with the soft pulses before and after them that the bridge predicate ties to them (written classes with the profile's columns).

    Before: one soft pulse after the other, to the first that fails, which is an island of neighbours.  After: the next lively soft pulse that holds, from
    there on again; each pulse has one successor, and the ends of chains are found by doubling.
    """
    g = staged(groups(c, e), "pulse-groups")
    soft = staged(soft_pulses(c, g.select("stream_id", F.col("f").alias("ts")).unionByName(g.select("stream_id", F.col("l").alias("ts")))), "soft-pulses")
    ok = staged(far_pairs(soft, e).where("ok").select("stream_id", "lo", "hi"), "bridged-holes")
    reach = soft.select("stream_id", F.col("ts").alias("lo"), "v_trail")
    to_far = ok.join(soft.where("lively").select("stream_id", F.col("ts").alias("hi")), ["stream_id", "hi"]).join(reach, ["stream_id", "lo"]).where("hi - lo <= v_trail").groupBy("stream_id", F.col("lo").alias("ts")).agg(F.min("hi").alias("far"))
    step = F.col("ahead") - F.col("ts")
    to = F.when(step <= F.col("v_silence"), F.when(step <= F.col("v_trail"), F.col("ahead"))).otherwise(F.col("far"))
    trail = ends_of_chains(soft.join(to_far, ["stream_id", "ts"], "left").select("stream_id", "ts", to.alias("to")))
    near = soft.join(ok.select("stream_id", F.col("lo").alias("before"), F.col("hi").alias("ts"), F.lit(True).alias("held")), ["stream_id", "before", "ts"], "left")
    gap = F.col("ts") - F.col("before")
    tied = (gap <= F.col("v_lead")) & ((gap <= F.col("v_silence")) | F.col("held").isNotNull()) & (F.col("after_lively") | ~F.col("v_lively"))
    near = staged(near.select("stream_id", "ts", "soft", "before", F.coalesce(tied, F.lit(False)).alias("tied")), "tied-pulses")
    runs = with_island(near.where("soft"), ["stream_id"], "ts", breaks=~F.col("tied"), name="run")
    runs = runs.select("stream_id", F.col("ts").alias("before"), F.min("ts").over(Window.partitionBy("stream_id", "run")).alias("run_first"))
    lead = near.join(runs, ["stream_id", "before"], "left").select("stream_id", F.col("ts").alias("f"), F.when(F.col("tied"), F.col("run_first")).otherwise(F.col("ts")).alias("first_ts"))
    return g.join(trail.withColumnRenamed("ts", "l"), ["stream_id", "l"]).join(lead, ["stream_id", "f"])


def ends_of_chains(follows: DataFrame, name: str = "chain-ends") -> DataFrame:
    """``stream_id, ts, last_ts`` of rows ``stream_id, ts, to`` (null: the chain ends here) by doubling the steps: as many rounds as the binary digits of the longest chain."""
    x = staged(follows.select("stream_id", "ts", F.coalesce("to", "ts").alias("to")), name)
    while True:
        y = x.select("stream_id", F.col("ts").alias("to"), F.col("to").alias("on"))
        nxt = staged(x.join(y, ["stream_id", "to"]).select("stream_id", "ts", F.col("on").alias("to"), (F.col("on") != F.col("to")).alias("moved")), name)
        x = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return x.withColumnRenamed("to", "last_ts")


@query(
    f"""{_IN.replace('WITH', 'WITH RECURSIVE', 1)}, {_PAIRS}, walk AS (SELECT stream_id, island, l AS t0 FROM groups UNION ALL SELECT w.stream_id, w.island, n.hi FROM walk w JOIN nxt n ON n.stream_id = w.stream_id AND n.lo = w.t0),
    trail AS (SELECT stream_id, island, max(t0) AS last_ts FROM walk GROUP BY 1, 2)
    SELECT g.stream_id, g.f AS group_first, g.l AS group_last, g.n, d.first_ts, t.last_ts FROM groups g JOIN trail t USING (stream_id, island) JOIN lead_of d ON d.stream_id = g.stream_id AND d.ts = g.f"""
)
def soft_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of the standard profile with the soft pulses around them."""
    c = staged(one_profile(classes(spark, sf_dir)), "pulse-classes")
    out = absorb(c, carriers.energy(spark, sf_dir))
    return out.select("stream_id", F.col("f").alias("group_first"), F.col("l").alias("group_last"), "n", "first_ts", "last_ts")


_VALUES = ", ".join(f"('{name}', {', '.join(str(x).lower() for x in profile_values(name).values())})" for name in PROFILES)
_BY_STREAM = f"""{_CLASS}, pf(profile, {', '.join(V)}) AS (VALUES {_VALUES}), cv AS (SELECT cls.*, pf.* FROM cls JOIN pf ON pf.profile = ['strict', 'standard', 'device'][1 + stream_id % 3]),
    sup AS (SELECT *, event_id AS id, lag(ts) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS lo, ts AS hi FROM cv WHERE in_court OR strong OR v_every), node AS (SELECT DISTINCT stream_id, court_id, ts, merge_at, residual, {', '.join(V)}, bool_or(soft) OVER t AS soft, bool_or(soft AND motion >= bridge) OVER t AS lively FROM cv WINDOW t AS (PARTITION BY stream_id, ts)),
    sft AS (SELECT * FROM node WHERE soft), ask AS (SELECT DISTINCT a.stream_id, a.court_id, a.residual, a.merge_at, a.v_silence, a.v_pure, a.v_share, a.ts AS lo, b.ts AS hi FROM node a JOIN node b ON a.stream_id = b.stream_id AND b.ts - a.ts > a.v_silence AND b.ts - a.ts <= a.v_bridge),
    mot AS (SELECT w.stream_id, w.lo, w.hi, coalesce(sum(e.e5) / (count(e.energy) * 100000.0), 0) AS mean_e, coalesce(sum(CASE WHEN e.energy >= w.residual THEN 1 ELSE 0 END) / (count(e.energy) * 1.0), 0) AS active FROM ask w LEFT JOIN energy e ON e.court_id = w.court_id AND e.ts BETWEEN w.lo AND w.hi GROUP BY 1, 2, 3),
    pin AS (SELECT DISTINCT w.stream_id, w.lo, w.hi FROM ask w JOIN sft s ON s.stream_id = w.stream_id AND s.lively AND s.ts > w.lo + {us(0.05)} AND s.ts < w.hi - {us(0.05)}),
    ok AS (SELECT w.stream_id, w.lo, w.hi FROM ask w JOIN mot m USING (stream_id, lo, hi) LEFT JOIN pin ON pin.stream_id = w.stream_id AND pin.lo = w.lo AND pin.hi = w.hi WHERE (w.hi - w.lo <= v_pure AND round(active, 9) >= 0.55 AND round(mean_e, 9) >= round(merge_at, 9)) OR (pin.lo IS NOT NULL AND round(active, 9) >= v_share)),
    brk AS (SELECT s.*, CASE WHEN s.lo IS NULL OR s.hi - s.lo <= s.v_silence OR ok.lo IS NOT NULL THEN 0 ELSE 1 END AS brk FROM sup s LEFT JOIN ok ON ok.stream_id = s.stream_id AND ok.lo = s.lo AND ok.hi = s.hi),
    grp AS (SELECT *, sum(brk) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM brk),
    groups AS (SELECT stream_id, island, any_value(profile) AS profile, min(ts) AS f, max(ts) AS l, count(*) AS n FROM grp GROUP BY 1, 2),
    fwd AS (SELECT a.stream_id, a.ts, min(b.ts) AS hi FROM node a JOIN sft b ON b.stream_id = a.stream_id AND b.lively AND b.ts > a.ts AND b.ts - a.ts <= a.v_trail LEFT JOIN ok ON ok.stream_id = a.stream_id AND ok.lo = a.ts AND ok.hi = b.ts WHERE b.ts - a.ts <= a.v_silence OR ok.lo IS NOT NULL GROUP BY 1, 2),
    prv AS (SELECT a.stream_id, a.ts, a.v_lead, a.v_silence, a.v_lively, max(b.ts) AS lo, arg_max(b.lively, b.ts) AS lv FROM node a JOIN sft b ON b.stream_id = a.stream_id AND b.ts < a.ts GROUP BY ALL),
    bwd AS (SELECT p.stream_id, p.ts, p.lo FROM prv p LEFT JOIN ok ON ok.stream_id = p.stream_id AND ok.lo = p.lo AND ok.hi = p.ts WHERE p.ts - p.lo <= v_lead AND (p.ts - p.lo <= v_silence OR ok.lo IS NOT NULL) AND (lv OR NOT v_lively)),
    ahead AS (SELECT stream_id, island, l AS t FROM groups UNION ALL SELECT w.stream_id, w.island, n.hi FROM ahead w JOIN fwd n ON n.stream_id = w.stream_id AND n.ts = w.t),
    back AS (SELECT stream_id, island, f AS t FROM groups UNION ALL SELECT w.stream_id, w.island, n.lo FROM back w JOIN bwd n ON n.stream_id = w.stream_id AND n.ts = w.t)"""


@query(
    f"""{_IN.replace('WITH', 'WITH RECURSIVE', 1)}, {_BY_STREAM} SELECT stream_id, profile, f AS group_first, l AS group_last, n, (SELECT min(t) FROM back b WHERE b.stream_id = g.stream_id AND b.island = g.island) AS first_ts, (SELECT max(t) FROM ahead a WHERE a.stream_id = g.stream_id AND a.island = g.island) AS last_ts FROM groups g"""
)
def profile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of strict, standard and on-device streams, each by its own profile, in one plan."""
    name = F.element_at(F.array(*map(F.lit, PROFILES)), (F.col("stream_id") % 3 + 1).cast("int"))
    c = staged(stream_profiles(classes(spark, sf_dir).withColumn("profile", name)), "pulse-classes")
    out = absorb(c, carriers.energy(spark, sf_dir)).join(c.select("stream_id", "profile").distinct(), "stream_id")
    return out.select("stream_id", "profile", F.col("f").alias("group_first"), F.col("l").alias("group_last"), "n", "first_ts", "last_ts")


# --- confidence of a group -------------------------------------------------------------------------------------------------

#: By pulses and by their mean motion over the support level, in shares of the court's range.
_CONFIDENCE = "round(round(least(0.99, 0.48 + 0.30 * least(1.0, n / 6.0) + 0.22 * least(1.0, greatest(0.0, (mean_motion - support) / greatest(0.001, a - support)))), 9), 3)"


@query(
    f"""{_IN}, {_CLASS}, {_sql_islands('cls', 'stream_id', us(1.85), extra=', event_id')}, mg AS (SELECT stream_id, island, any_value(court_id) AS court_id, min(ts) AS f, count(*) AS n, CAST(sum(CAST(round(motion * 100000) AS BIGINT)) AS BIGINT) / (count(*) * 100000.0) AS mean_motion FROM isl GROUP BY 1, 2)
    SELECT stream_id, f AS first_ts, n, round(mean_motion, 9) AS mean_motion, {_CONFIDENCE} AS confidence FROM mg JOIN thr USING (court_id)"""
)
def span_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of a group from its pulses and the mean motion at them (motion in hundred-thousandths, so that sums do not depend on their order)."""
    c = with_island(classes(spark, sf_dir), ["stream_id"], "ts", us(1.85), tie="event_id")
    g = c.groupBy("stream_id", "island").agg(F.first("court_id").alias("court_id"), F.min("ts").alias("f"), F.count(F.lit(1)).alias("n"), (F.sum(F.round(F.col("motion") * 100000).cast("long")) / (F.count(F.lit(1)) * 100000.0)).alias("mean_motion"))
    x = g.join(thresholds(court_stats(carriers.energy(spark, sf_dir))).select("court_id", "a", "support"), "court_id")
    return x.select("stream_id", F.col("f").alias("first_ts"), "n", F.round("mean_motion", 9).alias("mean_motion"), F.expr(_CONFIDENCE).alias("confidence"))


# --- ends of groups ------------------------------------------------------------------------------------------------------

_ISL = _sql_islands("cls", "stream_id", us(1.85), extra=", event_id")


def _islands(c: DataFrame, limit: int = SILENCE) -> DataFrame:
    return with_island(c, ["stream_id"], "ts", limit, tie="event_id")


@query(
    f"""{_IN}, {_CLASS}, {_ISL}, z AS (SELECT *, count(*) OVER g AS n, min(ts) OVER g AS f, row_number() OVER (PARTITION BY stream_id, island ORDER BY ts DESC, event_id DESC) - 1 AS r, ts - lag(ts) OVER (PARTITION BY stream_id, island ORDER BY ts, event_id) AS step FROM isl WINDOW g AS (PARTITION BY stream_id, island)),
    s AS (SELECT stream_id, island, f, n, min(CASE WHEN n < 5 OR n - r < 4 OR NOT (step > {us(1.35)} AND motion < support) THEN r END) AS popped FROM z GROUP BY ALL)
    SELECT z.stream_id, z.f AS first_ts, z.ts AS last_ts, z.n - popped AS n_left, popped FROM z JOIN s USING (stream_id, island) WHERE z.r = popped"""
)
def tail_strip_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing pulses off the court behind a hole go, while four are left: up to the first from the end that stays."""
    g = Window.partitionBy("stream_id", "island")
    z = _islands(classes(spark, sf_dir)).select("stream_id", "island", "ts", "event_id", "motion", "support")
    z = z.withColumn("n", F.count(F.lit(1)).over(g)).withColumn("f", F.min("ts").over(g))
    z = z.withColumn("r", F.row_number().over(g.orderBy(F.desc("ts"), F.desc("event_id"))) - 1).withColumn("step", F.col("ts") - F.lag("ts").over(g.orderBy("ts", "event_id")))
    goes = (F.col("n") >= 5) & (F.col("n") - F.col("r") >= 4) & F.coalesce((F.col("step") > us(1.35)) & (F.col("motion") < F.col("support")), F.lit(False))
    z = z.withColumn("popped", F.min(F.when(~goes, F.col("r"))).over(g)).where("r = popped")
    return z.select("stream_id", F.col("f").alias("first_ts"), F.col("ts").alias("last_ts"), (F.col("n") - F.col("popped")).alias("n_left"), F.col("popped").cast("long").alias("popped"))


@query(
    f"""{_IN}, {_CLASS}, {_ISL}, z AS (SELECT *, count(*) OVER g AS n, count(CASE WHEN in_court THEN 1 END) OVER g AS n_court, min(ts) OVER g AS f, max(ts) OVER g AS l, row_number() OVER o - 1 AS i, lead(ts) OVER o AS nx FROM isl WINDOW g AS (PARTITION BY stream_id, island), o AS (PARTITION BY stream_id, island ORDER BY ts, event_id)),
    k AS (SELECT stream_id, island, f, l, n, n_court, min(CASE WHEN n BETWEEN 4 AND 6 AND nx - ts BETWEEN {us(1.55)} AND {us(2.15)} AND n - 1 - i BETWEEN 2 AND 3 AND l - nx BETWEEN {us(1.40)} AND {us(2.60)} THEN i END) AS cut FROM z GROUP BY ALL),
    v AS (SELECT *, n_court = 0 AND n >= 3 AND l - f + {us(1.2)} > {us(3.2)} AS zero FROM k)
    SELECT v.stream_id, v.f AS first_ts, v.n, v.n_court, CASE WHEN zero AND cut IS NULL THEN 'drop' WHEN zero THEN 'peel' WHEN n >= 4 AND n * {us(1.0)}.0 / greatest({us(0.25)}, l - f) < 0.22 THEN 'sparse' ELSE 'keep' END AS verdict, CASE WHEN zero THEN cut + 1 END AS tail_from FROM v"""
)
def zero_court_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = zero_court(classes(spark, sf_dir))
    return k.select("stream_id", F.col("f").alias("first_ts"), "n", "n_court", "verdict", "tail_from")


def zero_court(c: DataFrame) -> DataFrame:
    """Long groups without a pulse in court go, unless a compact exchange can be peeled off their end; sparse groups go too."""
    g = Window.partitionBy("stream_id", "island")
    o = g.orderBy("ts", "event_id")
    z = _islands(c).select("stream_id", "island", "ts", "event_id", "in_court")
    z = z.withColumn("n", F.count(F.lit(1)).over(g)).withColumn("l", F.max("ts").over(g)).withColumn("i", F.row_number().over(o) - 1).withColumn("nx", F.lead("ts").over(o))
    behind = F.col("n") - 1 - F.col("i")
    fits = F.col("n").between(4, 6) & (F.col("nx") - F.col("ts")).between(us(1.55), us(2.15)) & behind.between(2, 3) & (F.col("l") - F.col("nx")).between(us(1.40), us(2.60))
    k = z.groupBy("stream_id", "island").agg(F.min("ts").alias("f"), F.max("ts").alias("l"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("in_court"), 1)).alias("n_court"), F.min(F.when(fits, F.col("i"))).alias("cut"))
    zero = (F.col("n_court") == 0) & (F.col("n") >= 3) & (F.col("l") - F.col("f") + us(1.2) > us(3.2))
    thin = (F.col("n") >= 4) & (F.col("n") * float(us(1.0)) / F.greatest(F.lit(us(0.25)), F.col("l") - F.col("f")) < 0.22)
    verdict = F.when(zero & F.col("cut").isNull(), "drop").when(zero, "peel").when(thin, "sparse").otherwise("keep")
    return k.withColumn("verdict", verdict).withColumn("tail_from", F.when(zero, (F.col("cut") + 1).cast("long")))


_BASE = f"""{_CLASS}, {_sql_islands('cls', 'stream_id', us(0.8), extra=', event_id')}, bs AS (SELECT stream_id, island, any_value(court_id) AS court_id, min(ts) AS f, max(ts) AS l, count(*) AS n, any_value(residual) AS residual, any_value(merge_at) AS merge_at, any_value(onset) AS onset, stream_id * 1000000 + island AS id FROM isl GROUP BY 1, 2)"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short fragments (gaps of at most 0.8 units) with their court's thresholds: what merges and walks start from."""
    i = _islands(classes(spark, sf_dir), us(0.8))
    g = i.groupBy("stream_id", "island").agg(F.first("court_id").alias("court_id"), F.min("ts").alias("f"), F.max("ts").alias("l"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("residual", "merge_at", "onset")])
    return g.withColumn("id", F.col("stream_id") * 1_000_000 + F.col("island"))


_AHEAD = RESIDUAL_WINDOW + us(1.5)


@query(
    f"""{_IN}, {_BASE}, s AS (SELECT b.id, b.l, b.residual, b.merge_at, e.ts, e.energy, row_number() OVER w AS k, max(CASE WHEN e.energy >= b.residual THEN 1 END) OVER w AS any_active FROM bs b JOIN energy e ON e.court_id = b.court_id AND e.ts BETWEEN b.l AND b.l + {_AHEAD} WINDOW w AS (PARTITION BY b.id ORDER BY e.ts, e.e5 ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT *, k - coalesce(max(CASE WHEN energy >= residual THEN k END) OVER (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS quiet FROM s), b AS (SELECT id, min(CASE WHEN quiet > {QUIET_AHEAD} AND ts >= l + {LANDING} THEN k END) AS stop FROM q GROUP BY 1),
    a AS (SELECT q.id, max(CASE WHEN energy >= residual THEN ts END) AS active_at, max(CASE WHEN energy >= residual AND energy >= merge_at THEN ts END) AS strong_at FROM q JOIN b USING (id) WHERE stop IS NULL OR k < stop GROUP BY 1)
    SELECT stream_id, f AS first_ts, l AS last_ts, greatest(l + {LANDING}, CASE WHEN a.id IS NULL THEN l ELSE least(l + {RESIDUAL_WINDOW}, coalesce(active_at, l) + {us(0.45)}) END, CASE WHEN a.id IS NULL THEN l ELSE least(l + {_AHEAD}, coalesce(strong_at, l) + {us(0.35)}) END) AS end_at FROM bs LEFT JOIN a USING (id)"""
)
def walk_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a span goes on after its last pulse while motion lingers, to the first pause that is long enough."""
    b = staged(fragments(spark, sf_dir), "fragments")
    walked = _walk_ahead(b, carriers.energy(spark, sf_dir), F.col("l") + _AHEAD)
    out = b.join(walked, "id", "left")
    seen = F.col("seen").isNotNull()
    soft_end = F.when(seen, F.least(F.col("l") + RESIDUAL_WINDOW, F.coalesce("active_at", "l") + us(0.45))).otherwise(F.col("l"))
    hard_end = F.when(seen, F.least(F.col("l") + _AHEAD, F.coalesce("strong_at", "l") + us(0.35))).otherwise(F.col("l"))
    return out.select("stream_id", F.col("f").alias("first_ts"), F.col("l").alias("last_ts"), F.greatest(F.col("l") + LANDING, soft_end, hard_end).alias("end_at"))


def _walk_ahead(b: DataFrame, e: DataFrame, until: Column) -> DataFrame:
    """``id, seen, active_at, strong_at``: the last active and strong sample after the last pulse, before the first long pause that ends when landing is over.

    Long pauses are the edges of the runs of active samples.  The one that stops the walk is the first whose last quiet sample is late enough; before the first
    active sample only quiet ones after the pulse count, and there the next pause stops the walk if they are too few.
    """
    levels = small_side(thresholds(court_stats(e)).select("court_id", F.col("residual").alias("__r"), F.col("merge_at").alias("__m")), "court-thresholds")  # a row for each court
    leveled = e.join(levels, "court_id")
    runs = active_runs(leveled, "court_id", "ts", "e5", F.col("energy") >= F.col("__r"), QUIET_AHEAD, BUCKET)
    index = level_index(e, levels, {"active": "__r"})
    strong = leveled.where((F.col("energy") >= F.col("__r")) & (F.col("energy") >= F.col("__m"))).select("court_id", "ts")
    pauses = runs.where("opens").select("court_id", F.col("ts").alias("first"), F.coalesce("ahead_of", "ts").alias("ts"))
    x = staged(b.select("id", "court_id", "l", until.alias("until")).withColumn("ts", F.col("l") + LANDING), "walks")
    x = asof(x, pauses, "court_id", "ts", ["first"], BUCKET, forward=True, prefix="p_").drop("ts")
    # the pause after the next active sample that follows the first one
    x = staged(x.withColumn("ts", F.col("p_ts") + 1), "walks")
    x = staged(asof(x, pauses, "court_id", "ts", ["first"], BUCKET, forward=True, prefix="q_").drop("ts", "p_ts", "q_ts"), "walks")
    far = F.lit((1 << 62) - 1)
    head = between(x, index, "court_id", "ts", ["id"], {"head": (F.col("l"), F.coalesce("p_first", far) - 1), "all": (F.col("l"), F.col("until"))}, BUCKET)
    x = x.join(head.select("id", total("head", "n").alias("n"), total("head", "active").alias("active"), total("all", "n").alias("seen")), "id")
    stop = F.when((F.col("active") > 0) | (F.col("n") > QUIET_AHEAD), F.col("p_first")).otherwise(F.col("q_first"))
    x = x.where("seen > 0").withColumn("upto", F.least("until", F.coalesce(stop, far) - 1))
    x = last_at_or_before(x, F.col("upto"), runs, "court_id", "ts", BUCKET, "active_at")
    x = last_at_or_before(x, F.col("upto"), strong, "court_id", "ts", BUCKET, "strong_at")
    inside = lambda c: F.when(F.col(c) >= F.col("l"), F.col(c)).alias(c)
    return x.select("id", "seen", inside("active_at"), inside("strong_at"))


# --- merges of fragments ---------------------------------------------------------------------------------------------------

_LINKS = f"""{_BASE}, ln AS (SELECT *, lag(l) OVER (PARTITION BY stream_id ORDER BY f) AS lo, f AS hi, f - {us(0.25)} AS s, l + {us(0.2)} AS e, row_number() OVER (PARTITION BY stream_id ORDER BY f) AS k, 0.5 + (id % 50) / 100.0 AS conf FROM bs),
    gaps AS (SELECT * FROM ln WHERE hi - lo <= {BRIDGE}), {_sql_motion('gaps', 'gm', 'merge_at')}, li AS (SELECT ln.*, coalesce(round(active, 9) >= 0.48 AND round(mean_e, 9) >= round(merge_at, 9), false) AS bridged, coalesce(round(active, 9) >= 0.40, false) AS lively FROM ln LEFT JOIN gm USING (id))"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments as spans, and whether the hole before each is full of motion."""
    b = fragments(spark, sf_dir)
    w = Window.partitionBy("stream_id").orderBy("f")
    ln = b.select("*", F.lag("l").over(w).alias("lo"), F.col("f").alias("hi"), (F.col("f") - us(0.25)).alias("start"), (F.col("l") + us(0.2)).alias("end"), (0.5 + (F.col("id") % 50) / 100.0).alias("conf"))
    m = motion_between(ln.where(F.col("hi") - F.col("lo") <= BRIDGE), carriers.energy(spark, sf_dir), "merge_at")
    full = m.select("id", ((F.round("active", 9) >= 0.48) & (F.round("mean_e", 9) >= F.round("merge_at", 9))).alias("bridged"), (F.round("active", 9) >= 0.40).alias("lively"))
    out = ln.join(full, "id", "left").fillna(False, ["bridged", "lively"])
    return out.select("stream_id", "start", "end", F.col("f").alias("first"), F.col("l").alias("last"), "conf", "bridged", "lively")


def _sql_fold(joined: str) -> str:
    return f"""r AS (SELECT stream_id, k, s, e, f, l, conf, 1 AS n, 1 AS grp FROM li WHERE k = 1
      UNION ALL SELECT o.stream_id, o.k, CASE WHEN j THEN q.s ELSE o.s END, CASE WHEN j THEN greatest(q.e, o.e) ELSE o.e END, CASE WHEN j THEN q.f ELSE o.f END, CASE WHEN j THEN greatest(q.l, o.l) ELSE o.l END, CASE WHEN j THEN least(q.conf, o.conf) ELSE o.conf END, CASE WHEN j THEN q.n + 1 ELSE 1 END, CASE WHEN j THEN grp ELSE grp + 1 END
      FROM (SELECT r.*, {joined} AS j FROM r JOIN li o2 ON o2.stream_id = r.stream_id AND o2.k = r.k + 1) q JOIN li o ON o.stream_id = q.stream_id AND o.k = q.k + 1)
      SELECT stream_id, s AS start_at, max(e) AS end_at, max(l) AS last_ts, arg_max(n, k) AS n, round(arg_max(conf, k), 6) AS conf FROM r GROUP BY stream_id, grp, s"""


def _merged(df: DataFrame) -> DataFrame:
    x = folds.spans_of(df, "stream_id")
    return x.select("stream_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), F.col("last").alias("last_ts"), "n", F.round("conf", 6).alias("conf"))


_STD = f"(((o2.s - r.e <= {us(0.8)} AND o2.f - r.l <= {us(3.0)}) OR o2.f - r.l <= {min(us(2.4), us(1.85))} OR (o2.f - r.l <= {BRIDGE} AND o2.bridged)) AND NOT (greatest(r.e, o2.e) - r.s > {MOST} AND o2.f - r.l > {us(2.0)}))"


@query(f"{_IN.replace('WITH', 'WITH RECURSIVE', 1)}, {_LINKS}, {_sql_fold(_STD)}")
def motion_linked_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments joined by nearness or by a hole full of motion, with the cap on the joint length (standard profile)."""
    s = folds.chains(links(spark, sf_dir), "stream_id", "start", "end", BRIDGE)
    return _merged(folds.capped_merge(s, ["stream_id", "chain"], us(0.8), us(3.0), min(us(2.4), us(1.85)), MOST, us(2.0), bridged=BRIDGE))


_DEV = f"(o2.e - r.s <= {us(24)} AND ((o2.s - r.e <= {us(0.4)} AND o2.f - r.l <= {us(2.2)}) OR o2.f - r.l <= {us(1.15)} OR (o2.f - r.l <= {BRIDGE} AND o2.s - r.e <= {us(2.2)} AND o2.lively)))"


@query(f"{_IN.replace('WITH', 'WITH RECURSIVE', 1)}, {_LINKS}, {_sql_fold(_DEV)}")
def device_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The on-device merge: the joint length stays within 24 units in every case."""
    s = folds.chains(links(spark, sf_dir), "stream_id", "start", "end", BRIDGE)
    return _merged(folds.device_merge(s, ["stream_id", "chain"], us(24), us(0.4), us(2.2), us(1.15), BRIDGE, us(2.2)))


@query(
    f"""{_IN}, {_BASE}, p AS (SELECT stream_id, f, l, f - {us(2.6)} - (id % 5) * {us(0.3)} AS s, l + {us(1.6)} + (id % 3) * {us(0.4)} AS e FROM bs), t AS (SELECT *, e - s <= {us(4.4)} OR l - f <= {us(0.2)} AS fits FROM p)
    SELECT stream_id, f AS first_ts, fits, CASE WHEN fits THEN greatest(s, f - {min(LOOKBACK, us(2.2))}) ELSE greatest(s, f - {us(1.5)}) END AS start_at, CASE WHEN fits THEN least(e, l + {min(RESIDUAL_WINDOW, us(1.8))}) ELSE least(e, l + {us(1.5)}) END AS end_at FROM t"""
)
def overlong_tighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding of spans within the limit is cut to the profile's; that of longer ones hard (the carrier's limit is 4.4 units)."""
    p = fragments(spark, sf_dir).select("stream_id", "f", "l", (F.col("f") - us(2.6) - (F.col("id") % 5) * us(0.3)).alias("s"), (F.col("l") + us(1.6) + (F.col("id") % 3) * us(0.4)).alias("e"))
    return tighten_overlong(p, us(4.4), us(0.2)).select("stream_id", F.col("f").alias("first_ts"), "fits", F.col("s").alias("start_at"), F.col("e").alias("end_at"))


def tighten_overlong(p: DataFrame, most: int, most_hits: int | None = None) -> DataFrame:
    fits = (F.col("e") - F.col("s") <= most) | (F.col("l") - F.col("f") <= (most if most_hits is None else most_hits))
    start = F.greatest("s", F.col("f") - F.when(F.col("fits"), min(LOOKBACK, us(2.2))).otherwise(us(1.5)))
    end = F.least("e", F.col("l") + F.when(F.col("fits"), min(RESIDUAL_WINDOW, us(1.8))).otherwise(us(1.5)))
    return p.withColumn("fits", fits).withColumn("s", start).withColumn("e", end)
