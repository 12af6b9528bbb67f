"""Edits of a stream's list of spans (days), for all streams at once: the edit of each stream is derived from its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals
from ..sources.carriers import ctes, table
from .registry import query
from .spans import _VALID, _sql_merge, _valid

#: The length of every recording, and the least length of a span after an edit.
DURATION, SHORT = 12_000, 20
#: Snapshots that the undo stack holds.
STACK = 40
_LISTED = "li AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_at, end_at, span_id) - 1 AS idx, count(*) OVER (PARTITION BY stream_id) AS n FROM valid)"
_S = f"greatest(0, least({{0}}, {DURATION - SHORT}))"
_E = f"greatest({_S} + {SHORT}, least({{1}}, {DURATION}))"


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stream's spans with their place in the list and the list's length."""
    w = Window.partitionBy("stream_id")
    v = _valid(spark, sf_dir)
    return v.withColumn("idx", F.row_number().over(w.orderBy("start", "end", "span_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))


def clamped(start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds moved into the recording, with the least length."""
    s = F.greatest(F.lit(0), F.least(start, F.lit(DURATION - SHORT)))
    return s, F.greatest(s + SHORT, F.least(end, F.lit(DURATION)))


@query(
    f"""{ctes('spans')}, {_VALID}, {_LISTED}, u AS (SELECT *, idx = stream_id % n AS hit FROM li),
    e AS (SELECT stream_id, span_id, idx, hit, CASE WHEN hit THEN {_S.format('start_at + 137')} ELSE start_at END AS start_at, CASE WHEN hit THEN {_E.format('start_at + 137', 'end_at + 11')} ELSE end_at END AS end_at FROM u)
    SELECT stream_id, span_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_at, idx) - 1 AS place, start_at, end_at, hit AS selected FROM e"""
)
def editor_update_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span of each stream gets new bounds; the list is sorted again and the selection follows the span."""
    u = listed(spark, sf_dir).withColumn("hit", F.col("idx") == F.col("stream_id") % F.col("n"))
    s, e = clamped(F.col("start") + 137, F.col("end") + 11)
    u = u.select("stream_id", "span_id", "idx", "hit", F.when(F.col("hit"), s).otherwise(F.col("start")).alias("start_at"), F.when(F.col("hit"), e).otherwise(F.col("end")).alias("end_at"))
    place = F.row_number().over(Window.partitionBy("stream_id").orderBy("start_at", "idx")) - 1
    return u.select("stream_id", "span_id", place.cast("long").alias("place"), "start_at", "end_at", F.col("hit").alias("selected"))


@query(
    f"""{ctes('spans')}, {_VALID}, {_LISTED}, k AS (SELECT *, stream_id % n AS gone, (stream_id * 7) % n AS sel FROM li),
    r AS (SELECT *, idx - CASE WHEN idx > gone THEN 1 ELSE 0 END AS place FROM k WHERE idx <> gone)
    SELECT stream_id, span_id, place, start_at, end_at, place = least(sel, n - 2) AS selected FROM r"""
)
def editor_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span of each stream goes; a selection beyond the end moves to the last span."""
    k = listed(spark, sf_dir).withColumn("gone", F.col("stream_id") % F.col("n")).withColumn("sel", (F.col("stream_id") * 7) % F.col("n"))
    place = (F.col("idx") - (F.col("idx") > F.col("gone")).cast("int")).cast("long")
    r = k.where("idx <> gone").withColumn("place", place)
    return r.select("stream_id", "span_id", "place", F.col("start").alias("start_at"), F.col("end").alias("end_at"), (F.col("place") == F.least("sel", F.col("n") - 2)).alias("selected"))


@query(
    f"""{ctes('spans')}, {_VALID}, t AS (SELECT DISTINCT stream_id, greatest(0, least(8000 + (stream_id * 37) % 5000, {DURATION - 1})) AS t0 FROM valid),
    everything AS (SELECT stream_id, span_id, start_at, end_at, confidence FROM valid UNION ALL SELECT stream_id, -1, t0, least(t0 + 4, {DURATION}), 1.0 FROM t), {_sql_merge('everything', 0)}
    SELECT stream_id, start_at, end_at, n, confidence FROM merged"""
)
def editor_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short span at each stream's playhead, merged with what it touches."""
    v = _valid(spark, sf_dir).select("stream_id", "span_id", "start", "end", "confidence")
    at = F.greatest(F.lit(0), F.least(8000 + (F.col("stream_id") * 37) % 5000, F.lit(DURATION - 1)))
    new = v.select("stream_id").distinct().select("stream_id", F.lit(-1).cast("long").alias("span_id"), at.alias("start"), F.least(at + 4, F.lit(DURATION)).alias("end"), F.lit(1.0).alias("confidence"))
    m = intervals.merge(v.unionByName(new), 0, "confidence", tie="span_id")
    return m.select("stream_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "n", "confidence")


@query(
    f"""{ctes('spans')}, {_VALID}, p AS (SELECT *, start_at + (span_id % 200) - 50 AS t FROM valid)
    SELECT span_id, t, CASE WHEN t < end_at - 1 THEN {_S.format('t')} ELSE start_at END AS start_from, CASE WHEN t < end_at - 1 THEN {_E.format('t', 'end_at')} ELSE end_at END AS start_from_end,
      CASE WHEN t > start_at + 1 THEN {_S.format('start_at')} ELSE start_at END AS end_from_start, CASE WHEN t > start_at + 1 THEN {_E.format('start_at', 't')} ELSE end_at END AS end_from FROM p"""
)
def editor_playhead_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start or end set at the playhead, where that leaves a span."""
    p = _valid(spark, sf_dir).withColumn("t", F.col("start") + (F.col("span_id") % 200) - 50)
    s1, e1 = clamped(F.col("t"), F.col("end"))
    s2, e2 = clamped(F.col("start"), F.col("t"))
    first, last = F.col("t") < F.col("end") - 1, F.col("t") > F.col("start") + 1
    return p.select(
        "span_id", "t", F.when(first, s1).otherwise(F.col("start")).alias("start_from"), F.when(first, e1).otherwise(F.col("end")).alias("start_from_end"),
        F.when(last, s2).otherwise(F.col("start")).alias("end_from_start"), F.when(last, e2).otherwise(F.col("end")).alias("end_from"),
    )


@query(
    f"""{ctes('spans')}, {_VALID}, {_LISTED}
    SELECT stream_id, span_id, CASE WHEN idx = stream_id % (n + 2) THEN ['kept', 'rejected', 'pending'][1 + CAST(stream_id % 3 AS INT)] ELSE 'pending' END AS status, idx = stream_id % (n + 2) AS edited FROM li"""
)
def editor_review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review status of one place of each list; a place beyond the list changes nothing."""
    hit = F.col("idx") == F.col("stream_id") % (F.col("n") + 2)
    status = F.element_at(F.array(F.lit("kept"), F.lit("rejected"), F.lit("pending")), (F.col("stream_id") % 3 + 1).cast("int"))
    return listed(spark, sf_dir).select("stream_id", "span_id", F.when(hit, status).otherwise("pending").alias("status"), hit.alias("edited"))


@query(
    f"""{ctes('spans')}, {_VALID}, k AS (SELECT *, ['direct', 'whole', 'clear', 'keep'][1 + CAST(stream_id % 4 AS INT)] AS mode FROM valid)
    SELECT stream_id, mode, 0 AS start_at, {DURATION} AS end_at, 1.0 AS confidence FROM (SELECT DISTINCT stream_id, mode FROM k WHERE mode = 'whole') UNION ALL SELECT stream_id, mode, start_at, end_at, confidence FROM k WHERE mode = 'keep'"""
)
def editor_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists emptied (direct edit, clear), replaced by one span of the whole recording, or left."""
    mode = F.element_at(F.array(*map(F.lit, ("direct", "whole", "clear", "keep"))), (F.col("stream_id") % 4 + 1).cast("int"))
    k = _valid(spark, sf_dir).select("stream_id", mode.alias("mode"), F.col("start").alias("start_at"), F.col("end").alias("end_at"), "confidence")
    whole = k.where("mode = 'whole'").select("stream_id", "mode").distinct().select("stream_id", "mode", F.lit(0).cast("long").alias("start_at"), F.lit(DURATION).cast("long").alias("end_at"), F.lit(1.0).alias("confidence"))
    return whole.unionByName(k.where("mode = 'keep'"))


@query(
    f"""{ctes('spans')}, {_VALID}, c AS (SELECT stream_id, count(*) AS pushed FROM valid GROUP BY 1), u AS (SELECT *, least(pushed, {STACK}) AS held, least(stream_id % 50, least(pushed, {STACK})) AS undone FROM c),
    li AS (SELECT stream_id, start_at, end_at, row_number() OVER (PARTITION BY stream_id ORDER BY span_id) AS version FROM valid)
    SELECT stream_id, pushed, held, undone, pushed - undone AS version, held - undone > 0 AS can_undo, coalesce(sum(CASE WHEN li.version <= pushed - undone THEN end_at - start_at END), 0)::BIGINT AS length FROM u JOIN li USING (stream_id) GROUP BY ALL"""
)
def editor_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned snapshots: each span's insertion pushes one, the last 40 are held, and some are undone.

    A version is the set of the rows inserted up to it, so no snapshot is copied.
    """
    w = Window.partitionBy("stream_id")
    v = _valid(spark, sf_dir).withColumn("version", F.row_number().over(w.orderBy("span_id"))).withColumn("pushed", F.count(F.lit(1)).over(w))
    v = v.withColumn("held", F.least("pushed", F.lit(STACK))).withColumn("undone", F.least(F.col("stream_id") % 50, F.col("held")))
    state = F.sum(F.when(F.col("version") <= F.col("pushed") - F.col("undone"), F.col("end") - F.col("start")))
    out = v.groupBy("stream_id", "pushed", "held", "undone").agg(F.coalesce(state, F.lit(0)).cast("long").alias("length"))
    return out.select("stream_id", "pushed", "held", "undone", (F.col("pushed") - F.col("undone")).alias("version"), (F.col("held") > F.col("undone")).alias("can_undo"), "length")


_CORNERS = ((0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9))
_X, _Y = "(c_custkey % 171) / 100.0 - 0.35", "(c_custkey % 137) / 100.0 - 0.15"


@query(
    "SELECT c_custkey, " + ", ".join(
        f"CASE WHEN c_custkey % 6 = {i} THEN least(1.0, greatest(0.0, {_X})) ELSE {x} END AS x{i}, CASE WHEN c_custkey % 6 = {i} THEN least(1.0, greatest(0.0, {_Y})) ELSE {y} END AS y{i}" for i, (x, y) in enumerate(_CORNERS)
    ) + " FROM customer"
)
def editor_roi_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corner of a task's region moved, kept in the picture; an index beyond the corners changes nothing."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 6).alias("i"), F.expr(f"cast({_X} as double)").alias("x"), F.expr(f"cast({_Y} as double)").alias("y"))
    moved = F.struct(*[F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(k))).alias(k) for k in ("x", "y")])
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _CORNERS])
    points = F.transform(corners, lambda p, k: F.when(k == F.col("i"), moved).otherwise(p))
    c = c.withColumn("p", points)
    return c.select("c_custkey", *[F.col("p")[i][k].alias(f"{k}{i}") for i in range(4) for k in ("x", "y")])
