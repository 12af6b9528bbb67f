"""The scorer's passes over spans: widen by track, tighten to pulses, merge by score, split at silences, drop sparse ones; and expansion along motion.

Each pass takes and gives ``stream_id, court_id, s, e, f, l`` (bounds, first and last pulse), so passes are stages that can be put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import UNIT, clip01, us
from ..operators import folds
from ..operators.islands import with_island
from ..operators.lookup import band, small_side
from ..operators.motion_index import active_runs, between, first_at_or_after, last_at_or_before, positions, running, total
from ..operators.staging import staged
from ..sources import carriers
from ..sources.carriers import ctes
from .refine import _BASE, LANDING, LOOKBACK, QUIET_AHEAD, QUIET_BACK, RESIDUAL_WINDOW, SERVE_LEAD, _walk_ahead, fragments
from .registry import query
from .segments import _STATS, BUCKET, _sql_islands, court_stats, level_index, share_between, thresholds
from .tracks import _sql_clusters, cluster_rows, clusters

#: Parameters of the scorer (units); the longest span is short here, as the carrier's spans are.
BACK, AHEAD, MERGE_GAP, MOST, DENSITY = us(1.2), us(1.2), us(3.5), us(12.0), 0.32
#: The score that ties two spans.
CONTINUE = 0.72
_GAP = 1.0
_COLUMNS = ["stream_id", "court_id", "s", "e", "f", "l"]

_RL = f"""{_sql_islands('pulses', 'stream_id', us(1.85), extra=', event_id')}, rl AS (SELECT stream_id, any_value(court_id) AS court_id, min(ts) - {us(0.85)} AS s, max(ts) + {us(0.7)} AS e, min(ts) AS f, max(ts) AS l FROM isl GROUP BY stream_id, island)"""


def rallies(p: DataFrame) -> DataFrame:
    g = with_island(p, ["stream_id"], "ts", us(1.85), tie="event_id").groupBy("stream_id", "island").agg(F.first("court_id").alias("court_id"), F.min("ts").alias("f"), F.max("ts").alias("l"))
    return g.select("stream_id", "court_id", (F.col("f") - us(0.85)).alias("s"), (F.col("l") + us(0.7)).alias("e"), "f", "l")


def _pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carriers.pulses(spark, sf_dir)


# --- widen by track ---------------------------------------------------------------------------------------------------------

_TRACKED = f"""c1 AS (SELECT p.stream_id, p.f, t.ts, t.x, t.y FROM rl p JOIN track t ON t.stream_id = p.stream_id AND t.ts BETWEEN greatest(0, p.f - {BACK}) AND p.f + {us(0.25)}), {_sql_clusters('c1', 'stream_id, f', _GAP, 'k1')},
    c2 AS (SELECT p.stream_id, p.l, t.ts, t.x, t.y FROM rl p JOIN track t ON t.stream_id = p.stream_id AND t.ts BETWEEN p.l - {us(0.15)} AND p.l + {AHEAD}), {_sql_clusters('c2', 'stream_id, l', _GAP, 'k2')},
    sv AS (SELECT stream_id, f, min(c0) - {us(0.25)} AS serve FROM k1 WHERE moving AND c1 >= f - {us(0.4)} GROUP BY 1, 2), ld AS (SELECT stream_id, l, max(c1) + {us(0.25)} AS land FROM k2 WHERE moving AND c0 <= l + {us(0.45)} GROUP BY 1, 2),
    tr1 AS (SELECT rl.stream_id, court_id, greatest(0, CASE WHEN f - serve <= {BACK} THEN least(s, greatest(serve, f - {BACK})) ELSE s END) AS s, CASE WHEN land - l <= {AHEAD + us(0.4)} THEN greatest(e, least(land, l + {AHEAD + us(0.3)})) ELSE e END AS e, f, l FROM rl LEFT JOIN sv USING (stream_id, f) LEFT JOIN ld USING (stream_id, l)),
    tr AS (SELECT stream_id, court_id, s, greatest(s + {us(0.2)}, e) AS e, f, l FROM tr1)"""


def widen_by_track(r: DataFrame, t: DataFrame) -> DataFrame:
    """Starts and ends moved out to the flights that join the first and last pulse, within the look back and ahead."""

    def flights(end: str, lo, hi) -> DataFrame:
        cut = band(r.select("stream_id", end), t, "stream_id", lo, hi, "ts", BUCKET).select("stream_id", end, F.col("r_ts").alias("ts"), F.col("r_x").alias("x"), F.col("r_y").alias("y"))
        return cluster_rows(clusters(cut, ["stream_id", end], _GAP), ["stream_id", end]).where("moving")

    serve = flights("f", F.greatest(F.lit(0), F.col("f") - BACK), F.col("f") + us(0.25)).where(F.col("c1") >= F.col("f") - us(0.4)).groupBy("stream_id", "f").agg((F.min("c0") - us(0.25)).alias("serve"))
    land = flights("l", F.col("l") - us(0.15), F.col("l") + AHEAD).where(F.col("c0") <= F.col("l") + us(0.45)).groupBy("stream_id", "l").agg((F.max("c1") + us(0.25)).alias("land"))
    x = r.join(serve, ["stream_id", "f"], "left").join(land, ["stream_id", "l"], "left")
    start = F.when(F.col("f") - F.col("serve") <= BACK, F.least("s", F.greatest("serve", F.col("f") - BACK))).otherwise(F.col("s"))
    end = F.when(F.col("land") - F.col("l") <= AHEAD + us(0.4), F.greatest("e", F.least("land", F.col("l") + AHEAD + us(0.3)))).otherwise(F.col("e"))
    x = x.withColumn("s", F.greatest(F.lit(0), start)).withColumn("e", end)
    return x.withColumn("e", F.greatest(F.col("s") + us(0.2), "e")).select(*_COLUMNS)


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("stream_id", F.col("s").alias("start_at"), F.col("e").alias("end_at"), F.col("f").alias("first_ts"), F.col("l").alias("last_ts"), *more)


_SHOWN = "stream_id, s AS start_at, e AS end_at, f AS first_ts, l AS last_ts"


@query(f"{ctes('pulses', 'track')}, {_RL}, {_TRACKED} SELECT {_SHOWN} FROM tr")
def track_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(widen_by_track(rallies(_pulses(spark, sf_dir)), carriers.track(spark, sf_dir)))


# --- tighten to pulses ---------------------------------------------------------------------------------------------------------

def _sql_tighten(source: str, out: str) -> str:
    return f"""{out}_i AS (SELECT r.stream_id, r.s, r.e, r.f, r.l, any_value(r.court_id) AS court_id, coalesce(min(p.ts), r.f) AS nf, coalesce(max(p.ts), r.l) AS nl FROM {source} r LEFT JOIN pulses p ON p.stream_id = r.stream_id AND p.ts BETWEEN r.s - {us(0.5)} AND r.e + {us(0.5)} GROUP BY 1, 2, 3, 4, 5),
    {out}_j AS (SELECT stream_id, court_id, greatest(0, greatest(s, nf - {BACK})) AS s, least(e, nl + {AHEAD}) AS e, nf AS f, nl AS l FROM {out}_i), {out} AS (SELECT stream_id, court_id, s, greatest(s + {us(0.25)}, e) AS e, f, l FROM {out}_j)"""


def tighten(r: DataFrame, p: DataFrame) -> DataFrame:
    """Bounds within 1.2 units of the first and last pulse that lie in or near the span; the least length is a quarter."""
    keys = ["stream_id", "s", "e", "f", "l"]
    inside = band(r.select(*keys), p.select("stream_id", "ts"), "stream_id", F.col("s") - us(0.5), F.col("e") + us(0.5), "ts", BUCKET).groupBy(*keys).agg(F.min("r_ts").alias("nf"), F.max("r_ts").alias("nl"))
    x = r.join(inside, keys, "left").withColumn("f", F.coalesce("nf", "f")).withColumn("l", F.coalesce("nl", "l"))
    x = x.withColumn("s", F.greatest(F.lit(0), "s", F.col("f") - BACK)).withColumn("e", F.least("e", F.col("l") + AHEAD))
    return x.withColumn("e", F.greatest(F.col("s") + us(0.25), "e")).select(*_COLUMNS)


@query(f"{ctes('pulses', 'track')}, {_RL}, {_TRACKED}, {_sql_tighten('tr', 'ti')} SELECT {_SHOWN} FROM ti")
def hits_tighten(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pulses(spark, sf_dir)
    return _shown(tighten(widen_by_track(rallies(p), carriers.track(spark, sf_dir)), p))


# --- merge by score ----------------------------------------------------------------------------------------------------------------

_C = "least(1.0, greatest(0.0, {}))"


#: Holes whose score decides a merge.
_ASKED = f"hi - lo > {us(2.2)} AND hi - lo <= {MERGE_GAP}"


def _sql_holes(source: str, asked: str) -> str:
    return f"""{_STATS}, lk AS (SELECT *, lag(l) OVER w AS lo, f AS hi, row_number() OVER w AS k FROM {source} WINDOW w AS (PARTITION BY stream_id ORDER BY s, e, f, l)), ho AS (SELECT * FROM lk WHERE {asked}),
    c3 AS (SELECT p.stream_id, p.k, t.ts, t.x, t.y FROM ho p JOIN track t ON t.stream_id = p.stream_id AND t.ts BETWEEN p.lo AND p.hi), {_sql_clusters('c3', 'stream_id, k', _GAP, 'k3')},
    fl AS (SELECT stream_id, k, coalesce(sum(CASE WHEN moving THEN c1 - c0 END), 0) AS flying, bool_or(moving) AS has, sum(n) AS points FROM k3 GROUP BY 1, 2),
    pi AS (SELECT h.stream_id, h.k, count(*) AS hits FROM ho h JOIN pulses p ON p.stream_id = h.stream_id AND p.ts > h.lo AND p.ts < h.hi GROUP BY 1, 2),
    mo AS (SELECT h.stream_id, h.k, sum(CASE WHEN e.energy >= m + 0.18 * greatest(0.0, a - m) THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS ma FROM ho h JOIN stats USING (court_id) JOIN energy e ON e.court_id = h.court_id AND e.ts BETWEEN h.lo AND h.hi GROUP BY 1, 2),
    co AS (SELECT h.*, coalesce(has, false) AS has, CASE WHEN h.hi <= h.lo THEN 1.0 ELSE {_C.format(f"0.35 * CASE WHEN has THEN 1.0 ELSE 0.0 END + 0.20 * {_C.format(f'coalesce(flying, 0) / CAST(greatest({us(0.05)}, h.hi - h.lo) AS DOUBLE)')} + 0.15 * {_C.format(f'coalesce(points, 0) * {UNIT}.0 / greatest({us(0.05)}, h.hi - h.lo) / 6.0')} + 0.25 * {_C.format('coalesce(hits, 0) / 3.0')} + 0.05 * {_C.format('coalesce(ma, 0.0)')}")} END AS score
      FROM ho h LEFT JOIN fl USING (stream_id, k) LEFT JOIN pi USING (stream_id, k) LEFT JOIN mo USING (stream_id, k))"""


def _sql_continue(source: str) -> str:
    return f"{_sql_holes(source, _ASKED)}, li AS (SELECT lk.*, coalesce(has AND round(score, 9) >= {CONTINUE}, false) AS go FROM lk LEFT JOIN (SELECT stream_id, k, has, score FROM co) co USING (stream_id, k))"


def with_holes(r: DataFrame) -> DataFrame:
    """Adds ``lo, hi``: the hole before each span, from the last pulse before it to its first."""
    return r.withColumn("lo", F.lag("l").over(Window.partitionBy("stream_id").orderBy("s", "e", "f", "l"))).withColumn("hi", F.col("f"))


def continue_scores(ho: DataFrame, p: DataFrame, e: DataFrame, t: DataFrame) -> DataFrame:
    """``stream_id, lo, hi, has, score``: how much flight, track, pulses and motion in a hole (distinct rows ``court_id, stream_id, lo, hi``) say that play went on; 1 where there is no hole."""
    keys = ["stream_id", "lo", "hi"]
    cut = band(ho.select(*keys), t, "stream_id", F.col("lo"), F.col("hi"), "ts", BUCKET).select(*keys, F.col("r_ts").alias("ts"), F.col("r_x").alias("x"), F.col("r_y").alias("y"))
    fl = cluster_rows(clusters(cut, keys, _GAP), keys).groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("moving"), F.col("c1") - F.col("c0"))), F.lit(0)).alias("flying"), F.max("moving").alias("has"), F.sum("n").alias("points"))
    pi = pulses_between(ho, p, keys, F.col("lo") + 1, F.col("hi") - 1)
    level = small_side(court_stats(e).select("court_id", (F.col("m") + 0.18 * F.greatest(F.lit(0.0), F.col("a") - F.col("m"))).alias("level")), "court-levels")  # a row for each court
    index = level_index(e, level, {"ma": "level"})
    mo = between(ho, index, "court_id", "ts", keys, {"hole": (F.col("lo"), F.col("hi"))}, BUCKET).select(*keys, share_between("hole", "ma"))
    x = ho.join(fl, keys, "left").join(pi, keys).join(mo, keys)
    long = F.greatest(F.lit(us(0.05)), F.col("hi") - F.col("lo")).cast("double")
    score = clip01(
        0.35 * F.when(F.col("has"), 1.0).otherwise(0.0) + 0.20 * clip01(F.coalesce("flying", F.lit(0)) / long) + 0.15 * clip01(F.coalesce("points", F.lit(0)) * float(UNIT) / long / 6.0)
        + 0.25 * clip01(F.col("hits") / 3.0) + 0.05 * clip01(F.col("ma"))
    )
    return x.select(*keys, F.coalesce("has", F.lit(False)).alias("has"), F.when(F.col("hi") <= F.col("lo"), 1.0).otherwise(score).alias("score"))


def pulses_between(r: DataFrame, p: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """``keys, hits``: pulses of the stream in [lo, hi], by running counts."""
    index = running(p, "stream_id", "ts", {"n": F.lit(1)}, BUCKET)
    return between(r, index, "stream_id", "ts", keys, {"in": (lo, hi)}, BUCKET).select(*keys, total("in", "n").alias("hits"))


def continued(r: DataFrame, p: DataFrame, e: DataFrame, t: DataFrame) -> DataFrame:
    """Adds ``go``: whether the score of the hole before a span ties it to the one before.

    A pulse at the hole's edges is within the slack of the count of pulses, so the rule that asks for one holds wherever the hole begins with a pulse.
    """
    lk = with_holes(r)
    keys = ["stream_id", "lo", "hi"]
    ho = staged(lk.where((F.col("hi") - F.col("lo") > us(2.2)) & (F.col("hi") - F.col("lo") <= MERGE_GAP)).select("court_id", *keys).distinct(), "scored-holes")
    go = continue_scores(ho, p, e, t).select(*keys, (F.col("has") & (F.round("score", 9) >= CONTINUE)).alias("go"))
    return lk.join(go, keys, "left").fillna(False, ["go"])


def merge_by_score(r: DataFrame, p: DataFrame, e: DataFrame, t: DataFrame) -> DataFrame:
    s = continued(r, p, e, t).select("stream_id", "court_id", F.col("s").alias("start"), F.col("e").alias("end"), F.col("f").alias("first"), F.col("l").alias("last"), F.lit(0.75).alias("conf"), F.col("go").alias("bridged"))
    s = folds.chains(s, "stream_id", "start", "end", MERGE_GAP + us(3.0))
    out = folds.spans_of(folds.capped_merge(s, ["stream_id", "chain", "court_id"], us(0.7), 1 << 62, us(2.2), MOST, us(2.0), bridged=MERGE_GAP), "stream_id", "court_id")
    return out.select("stream_id", "court_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("first").alias("f"), F.col("last").alias("l"), "n")


_JOIN = f"((o2.s - r.e <= {us(0.7)} OR o2.f - r.l <= {us(2.2)} OR (o2.f - r.l <= {MERGE_GAP} AND o2.go)) AND NOT (greatest(r.e, o2.e) - r.s > {MOST} AND o2.f - r.l > {us(2.0)}))"
_MERGE = f"""rr AS (SELECT stream_id, court_id, k, s, e, f, l, 1 AS n, 1 AS grp FROM li WHERE k = 1
      UNION ALL SELECT o.stream_id, o.court_id, o.k, CASE WHEN j THEN q.s ELSE o.s END, CASE WHEN j THEN greatest(q.e, o.e) ELSE o.e END, CASE WHEN j THEN q.f ELSE o.f END, CASE WHEN j THEN greatest(q.l, o.l) ELSE o.l END, CASE WHEN j THEN q.n + 1 ELSE 1 END, CASE WHEN j THEN grp ELSE grp + 1 END
      FROM (SELECT r.*, {_JOIN} AS j FROM rr r JOIN li o2 ON o2.stream_id = r.stream_id AND o2.k = r.k + 1) q JOIN li o ON o.stream_id = q.stream_id AND o.k = q.k + 1),
    mg AS (SELECT stream_id, any_value(court_id) AS court_id, min(s) AS s, max(e) AS e, min(f) AS f, max(l) AS l, max(n) AS n FROM rr GROUP BY stream_id, grp)"""
_REC = ctes("pulses", "energy", "track").replace("WITH", "WITH RECURSIVE", 1)


@query(f"{_REC}, {_RL}, {_TRACKED}, {_sql_tighten('tr', 'ti')}, {_sql_continue('ti')}, {_MERGE} SELECT {_SHOWN}, n FROM mg")
def score_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans joined where they touch, or where the hole between them scores as play (veto on the joint length)."""
    p, e, t = _pulses(spark, sf_dir), carriers.energy(spark, sf_dir), carriers.track(spark, sf_dir)
    return _shown(merge_by_score(staged(tighten(widen_by_track(rallies(p), t), p), "scorer-tight"), p, e, t), "n")


# --- split, and drop what is sparse ------------------------------------------------------------------------------------------------

_SPLIT = f"""lo_ AS (SELECT *, e - s > {MOST} AS long FROM mg), ip AS (SELECT m.stream_id, m.s, m.e, p.ts, p.event_id FROM lo_ m JOIN pulses p ON p.stream_id = m.stream_id AND p.ts BETWEEN m.s AND m.e WHERE long),
    ig AS (SELECT *, count(*) OVER (PARTITION BY stream_id, s, e) AS cnt, ts - lag(ts) OVER w AS gap, row_number() OVER w AS i FROM ip WINDOW w AS (PARTITION BY stream_id, s, e ORDER BY ts, event_id)),
    ib AS (SELECT *, max(CASE WHEN gap >= {us(2.6)} THEN 1 ELSE 0 END) OVER g AS silent, max(gap) OVER g AS widest FROM ig WINDOW g AS (PARTITION BY stream_id, s, e)),
    ic AS (SELECT *, max(CASE WHEN gap = widest THEN i END) OVER (PARTITION BY stream_id, s, e) AS at_i FROM ib),
    id_ AS (SELECT *, sum(CASE WHEN silent = 1 AND gap >= {us(2.6)} OR silent = 0 AND widest >= {us(2.0)} AND i = at_i THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, s, e ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM ic WHERE cnt >= 4 AND (silent = 1 OR widest >= {us(2.0)})),
    pt AS (SELECT stream_id, s AS os, e AS oe, part, greatest(s, min(ts) - {us(1.2)}) AS s, least(e, max(ts) + {us(1.3)}) AS e, min(ts) AS f, max(ts) AS l FROM id_ GROUP BY stream_id, s, e, part),
    sp AS (SELECT pt.stream_id, m.court_id, pt.s, pt.e, pt.f, pt.l FROM pt JOIN mg m ON m.stream_id = pt.stream_id AND m.s = os AND m.e = oe WHERE pt.e - pt.s >= {us(0.9)}
      UNION ALL SELECT stream_id, court_id, s, e, f, l FROM mg m WHERE NOT EXISTS (SELECT 1 FROM pt WHERE pt.stream_id = m.stream_id AND pt.os = m.s AND pt.oe = m.e))"""


def split_long(r: DataFrame, p: DataFrame) -> DataFrame:
    """Spans beyond the limit are cut at every silence of 2.6 units, else at the widest gap of 2.0 or more (of equal ones the last)."""
    keys = ["stream_id", "s", "e"]
    g, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("ts", "event_id")
    x = band(r.where(F.col("e") - F.col("s") > MOST).select("court_id", *keys), p.select("stream_id", "ts", "event_id"), "stream_id", F.col("s"), F.col("e"), "ts", BUCKET)
    x = x.select("court_id", *keys, F.col("r_ts").alias("ts"), F.col("r_event_id").alias("event_id"))
    x = x.withColumn("cnt", F.count(F.lit(1)).over(g)).withColumn("gap", F.col("ts") - F.lag("ts").over(w)).withColumn("i", F.row_number().over(w)).withColumn("widest", F.max("gap").over(g))
    x = x.where((F.col("cnt") >= 4) & (F.col("widest") >= us(2.0))).withColumn("at", F.max(F.when(F.col("gap") == F.col("widest"), F.col("i"))).over(g))
    cut = F.when(F.col("widest") >= us(2.6), F.col("gap") >= us(2.6)).otherwise(F.col("i") == F.col("at"))
    x = x.withColumn("part", F.sum(F.coalesce(cut.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = x.groupBy(*keys, "part").agg(F.first("court_id").alias("court_id"), F.min("ts").alias("f"), F.max("ts").alias("l"))
    whole = r.join(parts.select(*keys).distinct(), keys, "left_anti").select(*_COLUMNS)
    parts = parts.withColumn("s", F.greatest("s", F.col("f") - us(1.2))).withColumn("e", F.least("e", F.col("l") + us(1.3)))
    return whole.unionByName(parts.where(F.col("e") - F.col("s") >= us(0.9)).select(*_COLUMNS))


_ALL = f"{_REC}, {_RL}, {_TRACKED}, {_sql_tighten('tr', 'ti')}, {_sql_continue('ti')}, {_MERGE}, {_SPLIT}"


@query(f"{_ALL} SELECT {_SHOWN} FROM sp")
def silence_split_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, e, t = _pulses(spark, sf_dir), carriers.energy(spark, sf_dir), carriers.track(spark, sf_dir)
    x = staged(tighten(widen_by_track(rallies(p), t), p), "scorer-tight")
    return _shown(split_long(staged(merge_by_score(x, p, e, t).select(*_COLUMNS), "scorer-merged"), p))


def counted(r: DataFrame, p: DataFrame) -> DataFrame:
    """Adds ``hits``: pulses from the first to the last, with a slack of 0.15."""
    keys = ["stream_id", "f", "l"]
    n = pulses_between(r.select(*keys).distinct(), p, keys, F.col("f") - us(0.15), F.col("l") + us(0.15))
    return r.join(n, keys)


def _sql_counted(source: str) -> str:
    return f"ct AS (SELECT r.stream_id, r.court_id, r.s, r.e, r.f, r.l, count(p.ts) AS hits FROM {source} r LEFT JOIN pulses p ON p.stream_id = r.stream_id AND p.ts BETWEEN r.f - {us(0.15)} AND r.l + {us(0.15)} GROUP BY ALL)"


# --- scores ---------------------------------------------------------------------------------------------------------------

#: The measures of a span: seconds of lead and trail, length, pulses and points a second, shares of flight and of samples above the level, decay of motion.
_START = f"{_C.format(f'0.30 * {_C.format('lead_s / 1.8')} + 0.35 * CASE WHEN serve THEN 1.0 ELSE 0.0 END + 0.25 * {_C.format('1.0 - abs(lead_s - 0.6) / 1.5')} + 0.10 * ma')}"
_END = f"{_C.format(f'0.30 * {_C.format('trail_s / 1.5')} + 0.30 * CASE WHEN trail_s >= 0.35 THEN 1.0 ELSE {_C.format('trail_s / 0.35')} END + 0.20 * decay + 0.20 * (1.0 - landing)')}"
_KEEP = f"{_C.format(f'0.30 * flight + 0.35 * {_C.format('rho / 0.7')} + 0.20 * ma + 0.10 * {_C.format('track_rho / 5.0')} + 0.05 * {_C.format('least(d, 12.0) / 12.0')}')} * CASE WHEN d > 20.0 AND rho < 0.25 THEN 0.7 ELSE 1.0 END"
_CONF = f"greatest(CASE WHEN near >= 3 AND d >= 2.0 AND rho >= 0.25 THEN 0.55 ELSE 0.0 END, round(round({_C.format('0.45 * keep + 0.25 * start + 0.30 * finish')}, 9), 3))"
REVIEW = 0.58
_SCORES = ["score_start", "score_end", "score_keep", "confidence", "needs_review"]


def _sql_scored(source: str) -> str:
    """Rows of ``source`` with the five scores, as ``fs``."""
    u = f"{UNIT}.0"
    return f"""sk AS (SELECT *, row_number() OVER (ORDER BY stream_id, s, e, f, l) AS k FROM {source}),
    ww AS (SELECT k, stream_id, 0 AS win, s AS lo, e AS hi FROM sk UNION ALL SELECT k, stream_id, 1, s, f + {us(0.3)} FROM sk UNION ALL SELECT k, stream_id, 2, greatest(l, e - {us(0.8)}), e + {us(0.05)} FROM sk),
    wc AS (SELECT w.k, w.win, t.ts, t.x, t.y FROM ww w JOIN track t ON t.stream_id = w.stream_id AND t.ts BETWEEN w.lo AND w.hi), {_sql_clusters('wc', 'k, win', _GAP, 'wk')},
    wf AS (SELECT k, coalesce(sum(CASE WHEN win = 0 AND moving THEN c1 - c0 END), 0) AS flying, coalesce(sum(CASE WHEN win = 0 THEN n END), 0) AS points, bool_or(win = 1 AND moving) AS serve, coalesce(sum(CASE WHEN win = 2 AND moving THEN c1 - c0 END), 0) AS falling FROM wk GROUP BY 1),
    wh AS (SELECT sk.k, count(p.ts) AS near FROM sk LEFT JOIN pulses p ON p.stream_id = sk.stream_id AND p.ts BETWEEN sk.s - {us(0.15)} AND sk.e + {us(0.15)} GROUP BY 1),
    wm AS (SELECT sk.k, e.e5, e.energy >= m + 0.10 * greatest(0.0, a - m) AS act, row_number() OVER (PARTITION BY sk.k ORDER BY e.ts, e.e5) - 1 AS i, count(*) OVER (PARTITION BY sk.k) AS c FROM sk JOIN stats USING (court_id) JOIN energy e ON e.court_id = sk.court_id AND e.ts BETWEEN sk.s AND sk.e),
    wd AS (SELECT k, sum(CASE WHEN act THEN 1 ELSE 0 END) / (any_value(c) * 1.0) AS ma, sum(CASE WHEN i < greatest(1, c // 2) THEN e5 END) / (greatest(1, any_value(c) // 2) * 100000.0) AS head, sum(CASE WHEN i >= c // 2 THEN e5 END) / ((any_value(c) - any_value(c) // 2) * 100000.0) AS tail FROM wm GROUP BY 1),
    wx AS (SELECT sk.*, near, greatest({us(0.2)}, e - s) / {u} AS d, greatest(0, f - s) / {u} AS lead_s, greatest(0, e - l) / {u} AS trail_s, coalesce(serve, false) AS serve, coalesce(ma, 0.0) AS ma, CASE WHEN head > 1e-6 THEN {_C.format('1.0 - tail / head')} ELSE 0.5 END AS decay,
      {_C.format(f'coalesce(flying, 0) / CAST(greatest({us(0.05)}, e - s) AS DOUBLE)')} AS flight, {_C.format(f'coalesce(falling, 0) / CAST(greatest({us(0.05)}, e + {us(0.05)} - greatest(l, e - {us(0.8)})) AS DOUBLE)')} AS landing, coalesce(points, 0) * {u} / greatest({us(0.05)}, e - s) AS track_rho, near * {u} / greatest({us(0.2)}, e - s) AS rho
      FROM sk JOIN wh USING (k) LEFT JOIN wf USING (k) LEFT JOIN wd USING (k)),
    wy AS (SELECT *, {_START} AS start, {_END} AS finish, {_KEEP} AS keep FROM wx), wz AS (SELECT *, {_CONF} AS confidence FROM wy),
    fs AS (SELECT *, round(round(start, 9), 3) AS score_start, round(round(finish, 9), 3) AS score_end, round(round(keep, 9), 3) AS score_keep, confidence < {REVIEW} AS needs_review FROM wz)"""


def scored(r: DataFrame, p: DataFrame, e: DataFrame, t: DataFrame) -> DataFrame:
    """Adds ``score_start, score_end, score_keep, confidence, needs_review``.

    Pulses, motion and its decay are looked up in running totals; the track is cut to three windows of each span (the span, its lead, its landing) and clustered there.
    """
    keys = ["stream_id", "s", "e", "f", "l"]
    rows = staged(r.select("court_id", *keys).distinct(), "spans-to-score")
    windows = F.array(*[F.struct(F.lit(k).alias("win"), lo.alias("lo"), hi.alias("hi")) for k, (lo, hi) in enumerate((
        (F.col("s"), F.col("e")), (F.col("s"), F.col("f") + us(0.3)), (F.greatest("l", F.col("e") - us(0.8)), F.col("e") + us(0.05)),
    ))])
    cut = rows.select(*keys, F.explode(windows).alias("w")).select(*keys, "w.*")
    cut = band(cut, t, "stream_id", F.col("lo"), F.col("hi"), "ts", BUCKET).select(*keys, "win", F.col("r_ts").alias("ts"), F.col("r_x").alias("x"), F.col("r_y").alias("y"))
    each = cluster_rows(clusters(cut, [*keys, "win"], _GAP), [*keys, "win"])
    flying = lambda k: F.sum(F.when((F.col("win") == k) & F.col("moving"), F.col("c1") - F.col("c0")))
    track = each.groupBy(*keys).agg(flying(0).alias("flying"), F.sum(F.when(F.col("win") == 0, F.col("n"))).alias("points"), F.max((F.col("win") == 1) & F.col("moving")).alias("serve"), flying(2).alias("falling"))
    near = pulses_between(rows, p, keys, F.col("s") - us(0.15), F.col("e") + us(0.15)).withColumnRenamed("hits", "near")
    level = small_side(court_stats(e).select("court_id", (F.col("m") + 0.10 * F.greatest(F.lit(0.0), F.col("a") - F.col("m"))).alias("level")), "court-levels")  # a row for each court
    index = level_index(e, level, {"ma": "level"})
    motion = between(rows, index, "court_id", "ts", keys, {"span": (F.col("s"), F.col("e"))}, BUCKET).select(*keys, share_between("span", "ma"))
    x = rows.join(near, keys).join(motion, keys).join(track, keys, "left").join(decays(rows, e, keys), keys, "left")
    unit, least = float(UNIT), F.greatest(F.lit(us(0.05)), F.col("e") - F.col("s"))
    falls = F.greatest(F.lit(us(0.05)), F.col("e") + us(0.05) - F.greatest("l", F.col("e") - us(0.8)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    x = x.select(
        "court_id", *keys, "near", (F.greatest(F.lit(us(0.2)), F.col("e") - F.col("s")) / unit).alias("d"), (F.greatest(F.lit(0), F.col("f") - F.col("s")) / unit).alias("lead_s"), (F.greatest(F.lit(0), F.col("e") - F.col("l")) / unit).alias("trail_s"),
        F.coalesce("serve", F.lit(False)).alias("serve"), "ma", F.coalesce("decay", F.lit(0.5)).alias("decay"), clip01(zero("flying") / least.cast("double")).alias("flight"), clip01(zero("falling") / falls.cast("double")).alias("landing"),
        (zero("points") * unit / least).alias("track_rho"), (F.col("near") * unit / F.greatest(F.lit(us(0.2)), F.col("e") - F.col("s"))).alias("rho"),
    )
    x = x.select("*", F.expr(_START).alias("start"), F.expr(_END).alias("finish"), F.expr(_KEEP).alias("keep")).withColumn("confidence", F.expr(_CONF))
    short = lambda c: F.round(F.round(c, 9), 3)
    x = x.select(*keys, short("start").alias("score_start"), short("finish").alias("score_end"), short("keep").alias("score_keep"), "confidence", (F.col("confidence") < REVIEW).alias("needs_review"))
    return r.join(x, keys)


_PADDED = f"{_sql_islands('pulses', 'stream_id', us(1.85), extra=', event_id')}, pd AS (SELECT stream_id, any_value(court_id) AS court_id, min(ts) - {us(1.05)} AS s, max(ts) + {us(0.6)} AS e, min(ts) AS f, max(ts) AS l FROM isl GROUP BY stream_id, island)"


def _padded(p: DataFrame) -> DataFrame:
    return rallies(p).withColumn("s", F.col("f") - us(1.05)).withColumn("e", F.col("l") + us(0.6))


def _scored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pulses(spark, sf_dir)
    return scored(_padded(p), p, carriers.energy(spark, sf_dir), carriers.track(spark, sf_dir))


@query(f"{ctes('pulses', 'energy', 'track')}, {_PADDED}, {_STATS}, {_sql_scored('pd')} SELECT stream_id, f AS first_ts, score_start, score_end, score_keep, confidence FROM fs")
def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_spans(spark, sf_dir).select("stream_id", F.col("f").alias("first_ts"), "score_start", "score_end", "score_keep", "confidence")


@query(f"{ctes('pulses', 'energy', 'track')}, {_PADDED}, {_STATS}, {_sql_scored('pd')} SELECT stream_id, f AS first_ts, needs_review, CASE WHEN confidence < 0.72 THEN 'amber' ELSE 'plain' END AS band FROM fs")
def needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_spans(spark, sf_dir).select("stream_id", F.col("f").alias("first_ts"), "needs_review", F.when(F.col("confidence") < 0.72, "amber").otherwise("plain").alias("band"))


@query(f"{ctes('pulses', 'energy', 'track')}, {_PADDED}, {_sql_holes('pd', 'lo IS NOT NULL')} SELECT stream_id, lo AS last_ts, hi AS first_ts, has AS has_flight, round(score, 9) AS continue_score FROM co")
def continue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every hole between two spans."""
    p = _pulses(spark, sf_dir)
    ho = staged(with_holes(_padded(p)).where("lo is not null").select("court_id", "stream_id", "lo", "hi").distinct(), "scored-holes")
    x = continue_scores(ho, p, carriers.energy(spark, sf_dir), carriers.track(spark, sf_dir))
    return x.select("stream_id", F.col("lo").alias("last_ts"), F.col("hi").alias("first_ts"), F.col("has").alias("has_flight"), F.round("score", 9).alias("continue_score"))


_FIT = f"{_sql_tighten('sp', 'tj')}, {_sql_counted('tj')}, de AS (SELECT *, hits * {UNIT}.0 / greatest({us(0.25)}, l - f) AS density FROM ct), fi AS (SELECT * FROM de WHERE e - s >= {us(1.2)} AND hits >= 3 AND NOT (density < {DENSITY} AND hits < 5) AND NOT (e - s >= {us(10.0)} AND density < {DENSITY}))"


@query(f"{_ALL}, {_FIT}, {_sql_scored('fi')} SELECT {_SHOWN}, hits, {', '.join(_SCORES)} FROM fs")
def scorer_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes: widen, tighten, merge, split, tighten; spans that are short, or sparse in pulses, go; what is left is scored."""
    p, e, t = _pulses(spark, sf_dir), carriers.energy(spark, sf_dir), carriers.track(spark, sf_dir)
    return _shown(refine(rallies(p), p, e, t), "hits", *_SCORES)


def refine(r: DataFrame, p: DataFrame, e: DataFrame, t: DataFrame) -> DataFrame:
    """Every pass uses the spans before it more than once, so these are written between the passes."""
    x = staged(tighten(widen_by_track(r, t), p), "scorer-tight")
    x = staged(merge_by_score(x, p, e, t).select(*_COLUMNS), "scorer-merged")
    x = staged(split_long(x, p), "scorer-split")
    x = counted(staged(tighten(x, p), "scorer-spans"), p)
    density = F.col("hits") * float(UNIT) / F.greatest(F.lit(us(0.25)), F.col("l") - F.col("f"))
    long = F.col("e") - F.col("s")
    x = x.where((long >= us(1.2)) & (F.col("hits") >= 3) & ~((density < DENSITY) & (F.col("hits") < 5)) & ~((long >= us(10.0)) & (density < DENSITY)))
    return scored(staged(x, "scorer-kept"), p, e, t)


@query(f"{ctes('pulses')}, {_RL}, {_sql_counted('rl')} SELECT stream_id, f AS first_ts, hits FROM ct")
def hits_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pulses(spark, sf_dir)
    return counted(rallies(p), p).select("stream_id", F.col("f").alias("first_ts"), "hits")


@query(
    f"""{ctes('pulses', 'energy')}, {_RL}, x AS (SELECT r.stream_id, r.f, e.e5, row_number() OVER (PARTITION BY r.stream_id, r.f ORDER BY e.ts, e.e5) - 1 AS i, count(*) OVER (PARTITION BY r.stream_id, r.f) AS m FROM rl r JOIN energy e ON e.court_id = r.court_id AND e.ts BETWEEN r.s AND r.e),
    d AS (SELECT stream_id, f, any_value(m) AS m, sum(CASE WHEN i < greatest(1, m // 2) THEN e5 END) / (greatest(1, any_value(m) // 2) * 100000.0) AS head, sum(CASE WHEN i >= m // 2 THEN e5 END) / ((any_value(m) - any_value(m) // 2) * 100000.0) AS tail FROM x GROUP BY 1, 2)
    SELECT rl.stream_id, rl.f AS first_ts, coalesce(m, 0) AS n, round(CASE WHEN head > 1e-6 THEN {_C.format('1.0 - tail / head')} ELSE 0.5 END, 9) AS decay FROM rl LEFT JOIN d ON d.stream_id = rl.stream_id AND d.f = rl.f"""
)
def motion_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much weaker the second half of a span's samples is than the first; one half where nothing tells."""
    e = carriers.energy(spark, sf_dir)
    r = rallies(_pulses(spark, sf_dir))
    d = decays(r, e, ["stream_id", "f"])
    return r.join(d, ["stream_id", "f"], "left").select("stream_id", F.col("f").alias("first_ts"), F.coalesce("m", F.lit(0)).alias("n"), F.round(F.coalesce("decay", F.lit(0.5)), 9).alias("decay"))


def decays(r: DataFrame, e: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, m, decay`` of spans [s, e] that have samples."""
    x = halves(r.select(*dict.fromkeys([*keys, "court_id", "s", "e"])), e, keys)
    head, tail = F.col("head") / (F.greatest(F.lit(1), F.col("half")) * 100000.0), F.col("tail") / ((F.col("m") - F.col("half")) * 100000.0)
    return x.select(*keys, "m", F.when(head > 1e-6, clip01(1.0 - tail / head)).otherwise(0.5).alias("decay"))


def halves(r: DataFrame, e: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, m, half, head, tail`` of rows with samples in [s, e]: their number, half of it, and the sums of e5 of the first half (one sample at least) and of the rest."""
    index = level_index(e, small_side(court_stats(e).select("court_id"), "courts"), {})
    x = between(r, index, "court_id", "ts", ["court_id", *keys], {"span": (F.col("s"), F.col("e"))}, BUCKET)
    x = x.select("court_id", *keys, total("span", "n").alias("m"), F.col("span_0.n").alias("p0"), F.col("span_0.e5").alias("e0"), F.col("span_1.e5").alias("e1")).where("m > 0")
    half = F.floor(F.col("m") / 2)
    x = x.withColumn("half", half).withColumn("head_at", F.col("p0") + F.greatest(F.lit(1), half)).withColumn("tail_at", F.col("p0") + half)
    at = positions(e, "court_id", "ts", "e5", "e5", BUCKET)
    x = x.join(at.select("court_id", F.col("position").alias("head_at"), F.col("upto").alias("h")), ["court_id", "head_at"])
    x = x.join(at.select("court_id", F.col("position").alias("tail_at"), F.col("upto").alias("t")), ["court_id", "tail_at"], "left")
    return x.select(*keys, "m", "half", (F.col("h") - F.col("e0")).alias("head"), (F.col("e1") - F.when(F.col("half") == 0, F.col("e0")).otherwise(F.col("t"))).alias("tail"))


# --- expansion along motion ----------------------------------------------------------------------------------------------------------

_REACH = LOOKBACK + us(1.5)
_LATE = RESIDUAL_WINDOW + us(1.0)


@query(
    f"""{ctes('pulses', 'energy').replace('WITH', 'WITH RECURSIVE', 1)}, {_BASE}, b AS (SELECT *, f - {us(0.25)} AS s, l + {us(0.2)} AS e, row_number() OVER (PARTITION BY stream_id ORDER BY f) AS k FROM bs), b2 AS (SELECT *, lead(s) OVER (PARTITION BY stream_id ORDER BY k) AS nx FROM b),
    w0 AS (SELECT b.id, e.ts, row_number() OVER v AS j, e.energy >= b.onset AS act FROM b JOIN energy e ON e.court_id = b.court_id AND e.ts BETWEEN b.s - {_REACH} AND b.f + {us(0.1)} WINDOW v AS (PARTITION BY b.id ORDER BY e.ts DESC, e.e5 DESC)),
    w1 AS (SELECT id, ts, j - coalesce(lag(j) OVER (PARTITION BY id ORDER BY j), j) - 1 AS quiet, j FROM w0 WHERE act), w2 AS (SELECT *, max(CASE WHEN quiet > {QUIET_BACK} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING) AS over FROM w1),
    ru AS (SELECT id, list(ts) AS run FROM w2 WHERE over = 0 GROUP BY 1),
    lt AS (SELECT id, l, residual, court_id, least(l + {_LATE}, coalesce(nx - {us(0.35)}, l + {_LATE})) AS latest FROM b2),
    a0 AS (SELECT t.id, t.l, e.ts, e.energy >= t.residual AS act, row_number() OVER (PARTITION BY t.id ORDER BY e.ts, e.e5) AS j FROM lt t JOIN energy e ON e.court_id = t.court_id AND e.ts BETWEEN t.l AND t.latest),
    a1 AS (SELECT *, j - coalesce(max(CASE WHEN act THEN j END) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING), 0) AS quiet FROM a0), a2 AS (SELECT id, min(CASE WHEN quiet > {QUIET_AHEAD} AND ts >= l + {LANDING} THEN j END) AS stop FROM a1 GROUP BY 1),
    ac AS (SELECT a1.id, max(CASE WHEN act AND (stop IS NULL OR j < stop) THEN ts END) AS active_at FROM a1 JOIN a2 USING (id) GROUP BY 1),
    it AS (SELECT b2.*, run, CASE WHEN ac.id IS NULL THEN b2.e ELSE greatest(b2.e, least(latest, coalesce(active_at, b2.l) + {us(0.45)})) END AS ne FROM b2 LEFT JOIN ru USING (id) LEFT JOIN lt USING (id) LEFT JOIN ac USING (id)),
    st AS (SELECT stream_id, k, f, greatest({us(0.35)}, s - {_REACH}) AS early, s, ne, run FROM it WHERE k = 1 UNION ALL SELECT i.stream_id, i.k, i.f, greatest(t.ne + {us(0.35)}, i.s - {_REACH}), i.s, i.ne, i.run FROM st t JOIN it i ON i.stream_id = t.stream_id AND i.k = t.k + 1)
    SELECT stream_id, f AS first_ts, least(s, coalesce(greatest(early, list_min(list_filter(run, lambda x: x >= early)) - {SERVE_LEAD}), s)) AS start_at, ne AS end_at FROM st"""
)
def motion_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans widened along motion on both sides, without reaching the next start or the widened end before.

    Both walks are lookups in the runs of active samples.  How far back a span may go depends on the end before, and ends
    depend on the next start only, so ends come first and starts need the end of the span before: a window, no fold.
    """
    e = carriers.energy(spark, sf_dir)
    w = Window.partitionBy("stream_id").orderBy("f")
    b = fragments(spark, sf_dir).withColumn("s", F.col("f") - us(0.25)).withColumn("e", F.col("l") + us(0.2))
    latest = F.least(F.col("l") + _LATE, F.coalesce(F.lead("s").over(w) - us(0.35), F.col("l") + _LATE))
    b = staged(b.withColumn("latest", latest), "fragments")
    onset = small_side(thresholds(court_stats(e)).select("court_id", F.col("onset").alias("__o")), "court-onset")  # a row for each court
    runs = active_runs(e.join(onset, "court_id"), "court_id", "ts", "e5", F.col("energy") >= F.col("__o"), QUIET_BACK, BUCKET)
    ahead = _walk_ahead(b, e, F.col("latest")).select("id", "active_at", F.lit(True).alias("seen"))
    x = last_at_or_before(b.join(ahead, "id", "left"), F.col("f") + us(0.1), runs, "court_id", "ts", BUCKET, "anchor", "run_first")
    x = x.withColumn("ne", F.when(F.col("seen"), F.greatest("e", F.least("latest", F.coalesce("active_at", "l") + us(0.45)))).otherwise(F.col("e")))
    early = F.greatest(F.coalesce(F.lag("ne").over(w), F.lit(0)) + us(0.35), F.col("s") - _REACH)
    x = first_at_or_after(x.withColumn("early", early), F.greatest("early", F.coalesce("run_first", "early")), runs, "court_id", "ts", BUCKET, "edge")
    first = F.when((F.col("anchor") >= F.col("s") - _REACH) & (F.col("edge") <= F.col("anchor")), F.col("edge"))
    return x.select("stream_id", F.col("f").alias("first_ts"), F.least("s", F.coalesce(F.greatest(F.col("early"), first - SERVE_LEAD), "s")).alias("start_at"), F.col("ne").alias("end_at"))
