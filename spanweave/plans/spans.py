"""Interval algebra over the order spans (days)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import UNIT, us
from ..operators import folds, intervals
from ..operators.islands import with_island
from ..sources import carriers
from ..sources.carriers import ctes
from .registry import query
from .segments import _sql_islands

#: Days in a bucket of the overlap join.
IOU_BUCKET = 256
_VALID = "valid AS (SELECT * FROM spans WHERE start_at >= 0 AND end_at > start_at)"


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carriers.spans(spark, sf_dir).where("start >= 0 and end > start")


def _sql_merge(source: str, gap: int, keep: str = "min") -> str:
    return f"""mg_r AS (SELECT *, max(end_at) OVER (PARTITION BY stream_id ORDER BY start_at, end_at, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
    mg_g AS (SELECT *, sum(CASE WHEN start_at - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start_at, end_at, span_id ROWS UNBOUNDED PRECEDING) AS grp FROM mg_r),
    merged AS (SELECT stream_id, min(start_at) AS start_at, max(end_at) AS end_at, count(*) AS n, {keep}(confidence) AS confidence FROM mg_g GROUP BY stream_id, grp)"""


def _out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("stream_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), *more)


@query(f"{ctes('spans')}, {_VALID}, {_sql_merge('valid', 0)} SELECT stream_id, start_at, end_at, n, confidence FROM merged")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(intervals.merge(_valid(spark, sf_dir), 0, "confidence", tie="span_id"), "n", "confidence")


@query(
    f"""{ctes('spans')}, {_VALID}, {_sql_merge('valid', 30, 'max')}
    SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_at) AS number, start_at, end_at, end_at - start_at AS length, n, confidence FROM merged"""
)
def interval_merge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge with a gap, the greatest confidence, numbered by start."""
    m = intervals.merge(_valid(spark, sf_dir), 30, "confidence", keep="max", tie="span_id")
    m = m.withColumn("number", F.row_number().over(Window.partitionBy("stream_id").orderBy("start")).cast("long"))
    return _out(m, "number", (F.col("end") - F.col("start")).alias("length"), "n", "confidence")


_PADDED = "padded AS (SELECT stream_id, span_id, greatest(0, start_at - 10) AS start_at, least(end_at + 15, 12000) AS end_at, confidence FROM valid WHERE least(end_at + 15, 12000) > greatest(0, start_at - 10))"


@query(f"{ctes('spans')}, {_VALID}, {_PADDED}, {_sql_merge('padded', 0)} SELECT stream_id, start_at, end_at, n FROM merged")
def pad_clamp_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(intervals.merge(intervals.pad(_valid(spark, sf_dir), 10, 15, F.lit(12000)), 0, tie="span_id"), "n")


@query(
    f"""{ctes('spans')}, {_VALID}, nx AS (SELECT *, lead(start_at) OVER (PARTITION BY stream_id ORDER BY start_at, end_at, span_id) - 3 AS lim FROM valid)
    SELECT stream_id, span_id, start_at, CASE WHEN end_at > lim AND lim > start_at THEN lim ELSE end_at END AS end_at FROM nx"""
)
def clamp_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _valid(spark, sf_dir)
    nxt = F.lead("start").over(Window.partitionBy("stream_id").orderBy("start", "end", "span_id")) - 3
    s = s.withColumn("lim", nxt)
    touch = (F.col("end") > F.col("lim")) & (F.col("lim") > F.col("start"))
    return _out(s.withColumn("end", F.when(touch, F.col("lim")).otherwise(F.col("end"))), "span_id")


@query(
    f"""{ctes('spans')}, {_VALID}, {_sql_merge('valid', 0)}, g AS (SELECT stream_id, lag(end_at) OVER (PARTITION BY stream_id ORDER BY start_at) AS gap_start, start_at AS gap_end FROM merged)
    SELECT * FROM g WHERE gap_end - gap_start > 0"""
)
def dead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.dead_time(intervals.merge(_valid(spark, sf_dir), 0, tie="span_id"))


@query(
    f"""{ctes('spans')}, {_VALID}, {_PADDED}, {_sql_merge('padded', 0)}
    SELECT stream_id, row_number() OVER w AS number, printf('rally_%02d.mp4', row_number() OVER w) AS clip, start_at, end_at, CAST(sum(end_at - start_at) OVER (w ROWS UNBOUNDED PRECEDING) - (end_at - start_at) AS BIGINT) AS offset_at
    FROM merged WINDOW w AS (PARTITION BY stream_id ORDER BY start_at, end_at)"""
)
def edl_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edit decision list of an export: clip names and output offsets."""
    m = intervals.merge(intervals.pad(_valid(spark, sf_dir), 10, 15, F.lit(12000)), 0, tie="span_id")
    e = intervals.edit_list(m)
    return _out(e, F.col("number").cast("long").alias("number"), F.format_string("rally_%02d.mp4", "number").alias("clip"), F.col("offset").alias("offset_at"))


_MID = "CAST(floor((start_at + end_at) / 2.0) AS BIGINT)"


@query(
    f"""{ctes('spans')}, {_VALID}, m AS (SELECT *, {_MID} AS mid, (end_at - start_at > 900 AND {_MID} > start_at + 30 AND {_MID} < end_at - 30) AS cut FROM valid)
    SELECT span_id, stream_id, 1 AS part, start_at, CASE WHEN cut THEN mid ELSE end_at END AS end_at FROM m
    UNION ALL SELECT span_id, stream_id, 2, mid, end_at FROM m WHERE cut"""
)
def overlong_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(intervals.split_long(_valid(spark, sf_dir), 900, 30), "span_id", "part")


@query(
    f"""{ctes('spans')}, t AS (SELECT *, (span_id % 7) * 150 AS duration FROM spans), k AS (SELECT *, start_at - 8000 AS s0, end_at - 8000 AS e0, least(20, duration) AS short FROM t),
    c AS (SELECT *, CASE WHEN duration > 0 THEN greatest(0, least(s0, duration - short)) ELSE 0 END AS s FROM k)
    SELECT span_id, stream_id, s AS start_at, CASE WHEN duration > 0 THEN greatest(s + short, least(e0, duration)) ELSE 0 END AS end_at FROM c"""
)
def clamp_with_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamp into a stream's duration with a least length (0 where there is no duration)."""
    s = carriers.spans(spark, sf_dir).withColumn("start", F.col("start") - 8000).withColumn("end", F.col("end") - 8000)
    return _out(intervals.clamp_keep(s, (F.col("span_id") % 7) * 150, 20), "span_id")


@query(
    f"""{ctes('spans')}, {_VALID}, a AS (SELECT * FROM valid WHERE span_id % 2 = 0), b AS (SELECT * FROM valid WHERE span_id % 2 = 1),
    j AS (SELECT a.span_id, b.span_id AS other_id, least(a.end_at, b.end_at) - greatest(a.start_at, b.start_at) AS inter, a.end_at - a.start_at + b.end_at - b.start_at AS total FROM a JOIN b ON a.stream_id = b.stream_id AND a.start_at <= b.end_at AND b.start_at <= a.end_at)
    SELECT span_id, other_id, round(inter / (total - inter + 0.0), 12) AS iou FROM j WHERE inter / (total - inter + 0.0) >= 0.3"""
)
def interval_iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spans of one stream with an overlap of 0.3 or more.

    Both sides are copied to the buckets of time that they touch; a pair is made in the first bucket that both share.
    """
    v = _valid(spark, sf_dir).select("stream_id", "span_id", "start", "end")
    v = v.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / IOU_BUCKET), F.floor(F.col("end") / IOU_BUCKET))))
    a, b = v.where("span_id % 2 = 0"), v.where("span_id % 2 = 1").select("stream_id", "b", F.col("span_id").alias("other_id"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    j = a.join(b, ["stream_id", "b"]).where("start <= e2 and s2 <= end").where(F.col("b") == F.floor(F.greatest("start", "s2") / IOU_BUCKET))
    j = j.withColumn("iou", intervals.iou(F.col("start"), F.col("end"), F.col("s2"), F.col("e2")))
    return j.where("iou >= 0.3").select("span_id", "other_id", F.round("iou", 12).alias("iou"))


@query(
    f"""{ctes('spans')}, {_VALID}, {_sql_merge('valid', 0)}, probe AS (SELECT DISTINCT stream_id, span_id, start_at + 400 AS t FROM valid),
    inside AS (SELECT p.span_id, min(m.start_at) AS start_at, min(m.end_at) AS end_at FROM probe p JOIN merged m ON p.stream_id = m.stream_id AND p.t BETWEEN m.start_at AND m.end_at GROUP BY 1),
    nxt AS (SELECT p.span_id, m.start_at, m.end_at FROM probe p ASOF LEFT JOIN merged m ON p.stream_id = m.stream_id AND p.t <= m.start_at)
    SELECT p.span_id, p.t, coalesce(i.start_at, n.start_at) AS start_at, coalesce(i.end_at, n.end_at) AS end_at, i.start_at IS NOT NULL AS inside FROM probe p LEFT JOIN inside i USING (span_id) LEFT JOIN nxt n USING (span_id)"""
)
def playhead_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged span around a time, else the next one.

    One pass of window functions: merged spans do not overlap, so the span around a time is the last that began before it.
    """
    v = _valid(spark, sf_dir)
    m = intervals.merge(v, 0, tie="span_id")
    probe = v.select("stream_id", (F.col("start") + 400).alias("t"), "span_id", F.lit(None).cast("struct<s:bigint,e:bigint>").alias("m"), F.lit(1).alias("o"))
    rows = probe.unionByName(m.select("stream_id", F.col("start").alias("t"), F.lit(None).cast("long").alias("span_id"), F.struct(F.col("start").alias("s"), F.col("end").alias("e")).alias("m"), F.lit(0).alias("o")))
    w, back = Window.partitionBy("stream_id").orderBy("t", "o"), Window.partitionBy("stream_id").orderBy(F.desc("t"), F.desc("o"))
    last = F.last("m", ignorenulls=True)  # over a growing frame in both directions; the span at a probe's own time lies in the first
    rows = rows.withColumn("b", last.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("f", last.over(back.rowsBetween(Window.unboundedPreceding, 0)))
    inside = F.coalesce(F.col("b.e") >= F.col("t"), F.lit(False))
    pick = F.when(inside, F.col("b")).otherwise(F.col("f"))
    return rows.where("span_id is not null").select("span_id", "t", pick.s.alias("start_at"), pick.e.alias("end_at"), inside.alias("inside"))


# --- folds -----------------------------------------------------------------------------------------------------

_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_at, end_at, span_id) AS k FROM (SELECT stream_id, span_id, start_at, end_at, start_at + 1 AS f, end_at - 1 AS l, confidence AS conf FROM valid))"


def _with_pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _valid(spark, sf_dir)
    return s.select("stream_id", "span_id", "start", "end", (F.col("start") + 1).alias("first"), (F.col("end") - 1).alias("last"), F.col("confidence").alias("conf"))


@query(
    f"""WITH RECURSIVE {carriers.SQL['spans']}, {_VALID}, {_ORDERED}, r AS (
      SELECT stream_id, k, start_at AS s, end_at AS e, f, l, conf, 1 AS n, 1 AS grp FROM o WHERE k = 1
      UNION ALL SELECT o.stream_id, o.k, CASE WHEN j THEN s ELSE start_at END, CASE WHEN j THEN greatest(e, end_at) ELSE end_at END, CASE WHEN j THEN q.f ELSE o.f END, CASE WHEN j THEN greatest(q.l, o.l) ELSE o.l END,
        CASE WHEN j THEN least(q.conf, o.conf) ELSE o.conf END, CASE WHEN j THEN n + 1 ELSE 1 END, CASE WHEN j THEN grp ELSE grp + 1 END
      FROM (SELECT r.*, (((o2.start_at - r.e <= 4 AND o2.f - r.l <= 22) OR o2.f - r.l <= 12) AND NOT (greatest(r.e, o2.end_at) - r.s > 200 AND o2.f - r.l > 16)) AS j FROM r JOIN o o2 ON o2.stream_id = r.stream_id AND o2.k = r.k + 1) q
      JOIN o ON o.stream_id = q.stream_id AND o.k = q.k + 1)
    SELECT stream_id, s AS start_at, max(e) AS end_at, arg_max(n, k) AS n, arg_max(conf, k) AS conf FROM r GROUP BY stream_id, grp, s"""
)
def capped_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge of linked spans with a cap on the accumulated length."""
    s = folds.chains(_with_pulses(spark, sf_dir), "stream_id", "start", "end", 40)
    out = folds.capped_merge(s, ["stream_id", "chain"], 4, 22, 12, 200, 16)
    return _out(folds.spans_of(out, "stream_id"), "n", "conf")


@query(
    f"""WITH RECURSIVE {carriers.SQL['spans']}, {_VALID}, {_ORDERED}, r AS (
      SELECT stream_id, k, start_at AS s, end_at AS e, l - f AS len, 1 AS grp FROM o WHERE k = 1
      UNION ALL SELECT o.stream_id, o.k, CASE WHEN o.start_at > r.e + 1 OR o.l - o.f > r.len THEN o.start_at ELSE r.s END, CASE WHEN o.start_at > r.e + 1 OR o.l - o.f > r.len THEN o.end_at ELSE r.e END,
        CASE WHEN o.start_at > r.e + 1 OR o.l - o.f > r.len THEN o.l - o.f ELSE r.len END, CASE WHEN o.start_at > r.e + 1 THEN grp + 1 ELSE grp END
      FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1)
    SELECT stream_id, arg_max(s, k) AS start_at, arg_max(e, k) AS end_at FROM r GROUP BY stream_id, grp"""
)
def dedupe_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = folds.chains(_with_pulses(spark, sf_dir), "stream_id", "start", "end", 40)
    return _out(folds.spans_of(folds.dedupe_overlaps(s, ["stream_id", "chain"], 1), "stream_id"))


@query(
    f"""WITH RECURSIVE {carriers.SQL['spans']}, {_VALID}, {_ORDERED}, x AS (SELECT *, lead(start_at) OVER (PARTITION BY stream_id ORDER BY k) AS nx FROM o), r AS (
      SELECT stream_id, span_id, k, least(start_at, greatest(0, start_at - 9)) AS s, greatest(end_at, least(end_at + 12, coalesce(nx - 2, end_at + 12))) AS e FROM x WHERE k = 1
      UNION ALL SELECT x.stream_id, x.span_id, x.k, least(x.start_at, greatest(r.e + 2, x.start_at - 9)), greatest(x.end_at, least(x.end_at + 12, coalesce(x.nx - 2, x.end_at + 12))) FROM r JOIN x ON x.stream_id = r.stream_id AND x.k = r.k + 1)
    SELECT stream_id, s AS start_at, e AS end_at FROM r"""
)
def expand_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion that respects the already expanded span before; folded within stretches that no expansion crosses."""
    s = folds.chains(_with_pulses(spark, sf_dir), "stream_id", "start", "end", 9 + 12 + 2)
    return _out(folds.spans_of(folds.expand(s, ["stream_id", "chain"], 9, 12, 2), "stream_id"))


@query(
    f"""WITH RECURSIVE {carriers.SQL['pulses']}, o AS (SELECT stream_id, ts, row_number() OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS k FROM pulses), r AS (
      SELECT stream_id, k, ts AS kept, true AS took FROM o WHERE k = 1
      UNION ALL SELECT o.stream_id, o.k, CASE WHEN o.ts - r.kept >= {us(0.8)} THEN o.ts ELSE r.kept END, o.ts - r.kept >= {us(0.8)} FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1)
    SELECT stream_id, kept AS ts FROM r WHERE took"""
)
def refractory_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks with a rest of 0.8 units after each, left to right; folded within stretches that no rest can cross."""
    p = with_island(carriers.pulses(spark, sf_dir).select("stream_id", "ts", "event_id"), ["stream_id"], "ts", us(0.8), tie="event_id")
    return folds.refractory(p, ["stream_id", "island"], "ts", us(0.8)).select("stream_id", "ts")


@query(
    f"""WITH RECURSIVE {carriers.SQL['pulses']}, o AS (SELECT stream_id, ts, row_number() OVER (PARTITION BY stream_id ORDER BY height DESC, ts DESC) AS k FROM pulses), r AS (
      SELECT stream_id, k, [ts] AS kept FROM o WHERE k = 1
      UNION ALL SELECT o.stream_id, o.k, CASE WHEN len(list_filter(r.kept, lambda x: abs(x - o.ts) < {us(0.8)})) = 0 THEN list_append(r.kept, o.ts) ELSE r.kept END FROM r JOIN o ON o.stream_id = r.stream_id AND o.k = r.k + 1)
    SELECT stream_id, unnest(arg_max(kept, k)) AS ts FROM r GROUP BY stream_id"""
)
def tallest_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks with a least distance, the tallest first."""
    p = with_island(carriers.pulses(spark, sf_dir).select("stream_id", "ts", "height", "event_id"), ["stream_id"], "ts", us(0.8), tie="event_id")
    return folds.tallest_first(p, ["stream_id", "island"], "ts", "height", us(0.8)).select("stream_id", "ts")


@query(
    f"""{ctes('pulses')}, {_sql_islands('pulses', 'stream_id', us(3.2), extra=', event_id')},
    z AS (SELECT stream_id, island, ts, event_id, height, count(*) OVER (PARTITION BY stream_id, island) AS n, row_number() OVER (PARTITION BY stream_id, island ORDER BY ts, event_id) AS i,
      coalesce(ts - lag(ts) OVER (PARTITION BY stream_id, island ORDER BY ts, event_id) > {us(1.35)} AND height < 30, false) AS weak FROM isl),
    b AS (SELECT *, max(CASE WHEN NOT weak OR i <= 3 THEN i ELSE 0 END) OVER (PARTITION BY stream_id, island) AS stop_at FROM z)
    SELECT stream_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_pulses, any_value(n) - count(*) AS n_cut FROM b WHERE n < 5 OR i <= stop_at GROUP BY stream_id, island"""
)
def tail_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak pulses after long holes are stripped from the tail while four or more remain: the last row that holds ends the group."""
    p = with_island(carriers.pulses(spark, sf_dir), ["stream_id"], "ts", us(3.2), tie="event_id")
    w = Window.partitionBy("stream_id", "island")
    o = w.orderBy("ts", "event_id")
    p = p.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(o))
    weak = F.coalesce((F.col("ts") - F.lag("ts").over(o) > us(1.35)) & (F.col("height") < 30), F.lit(False))
    p = p.withColumn("weak", weak)
    p = p.withColumn("stop_at", F.max(F.when(~F.col("weak") | (F.col("i") <= 3), F.col("i")).otherwise(0)).over(w))
    out = p.where((F.col("n") < 5) | (F.col("i") <= F.col("stop_at"))).groupBy("stream_id", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_pulses"), F.first("n").alias("n"))
    return out.select("stream_id", "first_ts", "last_ts", "n_pulses", (F.col("n") - F.col("n_pulses")).alias("n_cut"))
