"""What an export needs to know: which spans, whether they may go out, and where they stand on the output's timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import us
from ..operators.islands import with_island
from ..operators.lookup import asof
from ..operators.motion_index import between, running, total
from ..operators.staging import staged
from ..sources import carriers
from ..sources.carriers import ctes, table
from .editor import _E, _S, clamped
from .registry import query
from .segments import BUCKET, _sql_islands
from .spans import _VALID, _valid

#: Microseconds of one output frame, and of the least step between two stamps of video and of sound.
FRAME, VIDEO_STEP, SOUND_STEP = 33_333, 1_000, 500


@query(
    f"""{ctes('spans')}, k AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_at, end_at, span_id) - 1 AS idx, greatest(0, start_at - 8100) AS s0, least(12000, end_at - 8100) AS e0, least(1.0, greatest(0.0, confidence * 1.2)) AS confidence FROM spans),
    c AS (SELECT stream_id, stream_id * 1000 + idx AS id, {_S.format('s0')} AS start_at, {_E.format('s0', 'e0')} AS end_at, confidence FROM k) SELECT * FROM c WHERE end_at - start_at >= 40"""
)
def duration_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered by start, clamped into the recording, and without what is too short after that (numbers are given before)."""
    w = Window.partitionBy("stream_id").orderBy("start", "end", "span_id")
    k = carriers.spans(spark, sf_dir).withColumn("idx", F.row_number().over(w) - 1)
    s, e = clamped(F.greatest(F.lit(0), F.col("start") - 8100), F.least(F.lit(12000), F.col("end") - 8100))
    out = k.select("stream_id", (F.col("stream_id") * 1000 + F.col("idx")).alias("id"), s.alias("start_at"), e.alias("end_at"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence") * 1.2)).alias("confidence"))
    return out.where("end_at - start_at >= 40")


_SHAPES = """CASE span_id % 4 WHEN 0 THEN concat('{"start":', start_at, ',"end":', end_at, '}') WHEN 1 THEN concat('{"start_time":', start_at, ',"end_time":', end_at, '}')
    WHEN 2 THEN concat('[', start_at, ',', end_at, ']') ELSE concat('{"end":', end_at, '}') END"""


@query(
    f"""{ctes('spans')}, {_VALID}, j AS (SELECT span_id, {_SHAPES} AS body FROM valid)
    SELECT span_id, CAST(coalesce(json_extract_string(body, '$.start'), json_extract_string(body, '$.start_time'), json_extract_string(body, '$[0]'), '0') AS DOUBLE) AS start_at,
      CAST(coalesce(json_extract_string(body, '$.end'), json_extract_string(body, '$.end_time'), json_extract_string(body, '$[1]'), '0') AS DOUBLE) AS end_at FROM j"""
)
def polymorphic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that come as objects of either naming or as pairs; what is missing is 0."""
    j = _valid(spark, sf_dir).select("span_id", F.col("start").alias("start_at"), F.col("end").alias("end_at")).select("span_id", F.expr(_SHAPES).alias("body"))
    pick = lambda *paths: F.coalesce(*[F.get_json_object("body", p) for p in paths], F.lit("0")).cast("double")
    return j.select("span_id", pick("$.start", "$.start_time", "$[0]").alias("start_at"), pick("$.end", "$.end_time", "$[1]").alias("end_at"))


@query(
    """WITH stored AS (SELECT l_orderkey AS task_id, count(*) AS n_stored FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    t AS (SELECT o_orderkey AS task_id, o_orderkey % 11 = 0 AS missing, o_orderstatus = 'F' AS completed, coalesce(n_stored, 0) AS n_stored, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 ELSE 0 END AS n_asked FROM orders LEFT JOIN stored ON task_id = o_orderkey)
    SELECT task_id, CASE WHEN missing THEN 404 WHEN NOT completed AND n_stored = 0 AND n_asked = 0 THEN 400 WHEN n_asked = 0 AND n_stored = 0 THEN 400 ELSE 200 END AS code,
      CASE WHEN missing OR (n_asked = 0 AND n_stored = 0) THEN NULL WHEN n_asked > 0 THEN 'request' ELSE 'stored' END AS source, CASE WHEN missing THEN 0 WHEN n_asked > 0 THEN n_asked ELSE n_stored END AS n FROM t"""
)
def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a task may be exported, and with which spans: those of the request win over the stored ones."""
    stored = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.count(F.lit(1)).alias("n_stored"))
    asked = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5).otherwise(F.lit(0))
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_orderkey") % 11 == 0).alias("missing"), asked.alias("n_asked")).join(stored, "task_id", "left").fillna(0, ["n_stored"])
    none = (F.col("n_asked") == 0) & (F.col("n_stored") == 0)  # not ready, or completed without a span: both are refused
    return t.select(
        "task_id", F.when(F.col("missing"), 404).when(none, 400).otherwise(200).alias("code"),
        F.when(F.col("missing") | none, None).when(F.col("n_asked") > 0, "request").otherwise("stored").alias("source"),
        F.when(F.col("missing"), 0).when(F.col("n_asked") > 0, F.col("n_asked")).otherwise(F.col("n_stored")).cast("long").alias("n"),
    )


@query(
    """SELECT o_orderkey, concat('rally_', o_orderkey, '.mp4') AS filename, CAST(o_totalprice * 1000 AS BIGINT) AS size_bytes, round(CAST(o_totalprice * 1000 AS BIGINT) / 1048576.0, 2) AS size_mb, 'no-store' AS cache_control FROM orders"""
)
def file_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, size in bytes and megabytes (two places) and caching of a file that is handed out once."""
    size = F.round(F.col("o_totalprice") * 1000).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("rally_"), "o_orderkey", F.lit(".mp4")).alias("filename"), size.alias("size_bytes"), F.round(size / F.lit(1048576.0), 2).alias("size_mb"), F.lit("no-store").alias("cache_control"))


_CUT = f"""isl_spans AS (SELECT stream_id, any_value(court_id) AS court_id, min(ts) AS f, max(ts) AS l FROM isl GROUP BY stream_id, island),
    keyframes AS (SELECT DISTINCT court_id, ts FROM energy WHERE e5 % 8 = 0),
    based AS (SELECT s.*, coalesce(k.ts, f) AS base FROM isl_spans s ASOF LEFT JOIN keyframes k ON s.court_id = k.court_id AND s.f >= k.ts)"""


@query(
    f"""{ctes('pulses', 'energy')}, {_sql_islands('pulses', 'stream_id', us(1.85), extra=', event_id')}, {_CUT},
    seen AS (SELECT b.stream_id, b.f, b.l, b.base, count(e.ts) AS n_frames, max(e.ts) AS last_frame FROM based b LEFT JOIN energy e ON e.court_id = b.court_id AND e.ts BETWEEN b.base AND b.l GROUP BY ALL),
    len AS (SELECT *, greatest(coalesce(last_frame - base, 0), least(l - f, {us(0.2)})) + {FRAME} AS step FROM seen)
    SELECT stream_id, f AS first_ts, base, n_frames, CAST(sum(step) OVER (PARTITION BY stream_id ORDER BY f ROWS UNBOUNDED PRECEDING) - step AS BIGINT) AS offset_at FROM len"""
)
def export_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans copied without coding: each begins at the last keyframe before it, and where it lands in the output.

    Its frames are counted by lookups in running totals, so that no row is made for each frame of each span.
    """
    p = with_island(carriers.pulses(spark, sf_dir), ["stream_id"], "ts", us(1.85), tie="event_id")
    s = staged(p.groupBy("stream_id", "island").agg(F.first("court_id").alias("court_id"), F.min("ts").alias("ts"), F.max("ts").alias("l")), "copied-spans")
    e = carriers.energy(spark, sf_dir).select("court_id", "ts", "e5").where("court_id is not null and ts is not null")
    based = asof(s, e.where("e5 % 8 = 0").select("court_id", "ts"), "court_id", "ts", [], BUCKET, prefix="key_")
    based = based.select("stream_id", "court_id", F.col("ts").alias("f"), "l", F.coalesce("key_ts", "ts").alias("base"))
    frames = running(e, "court_id", "ts", {"n": F.lit(1)}, BUCKET).withColumn("last", F.col("ts"))
    seen = between(based, frames, "court_id", "ts", ["stream_id", "f", "l", "base"], {"seen": (F.col("base"), F.col("l"))}, BUCKET)
    out = seen.withColumn("n_frames", total("seen", "n")).withColumn("last_frame", F.when(F.col("n_frames") > 0, F.col("seen_1.last")))
    step = F.greatest(F.coalesce(F.col("last_frame") - F.col("base"), F.lit(0)), F.least(F.col("l") - F.col("f"), F.lit(us(0.2)))) + FRAME
    w = Window.partitionBy("stream_id").orderBy("f")
    out = out.withColumn("step", step)
    return out.select("stream_id", F.col("f").alias("first_ts"), "base", "n_frames", (F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("step")).alias("offset_at"))


@query(
    f"""{ctes('track')}, two AS (SELECT stream_id, ts, CASE WHEN CAST(round(y * 100) AS BIGINT) % 2 = 0 THEN 'video' ELSE 'sound' END AS kind, ts // 5000000000 * 5000000000 AS target, CAST(round(y * 100) AS BIGINT) AS k, x FROM track),
    n AS (SELECT *, row_number() OVER (PARTITION BY stream_id, kind ORDER BY ts, k, x) AS i, CASE kind WHEN 'video' THEN {VIDEO_STEP} ELSE {SOUND_STEP} END AS step FROM two),
    s AS (SELECT stream_id, kind, ts, i, max(target - i * step) OVER (PARTITION BY stream_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) + i * step AS pts FROM n)
    SELECT stream_id, kind, i, pts, row_number() OVER (PARTITION BY stream_id ORDER BY pts, kind, i) AS place FROM s"""
)
def monotonic_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of two tracks that never fall or stand still, and the order in which both are written.

    "At least one step after the one before" has a closed form: the running maximum of (target - i step), plus i step.
    """
    k = F.round(F.col("y") * 100).cast("long")
    two = carriers.track(spark, sf_dir).select("stream_id", "ts", "x", k.alias("k"), F.when(k % 2 == 0, "video").otherwise("sound").alias("kind"), (F.floor(F.col("ts") / 5_000_000_000) * 5_000_000_000).alias("target"))
    mine = Window.partitionBy("stream_id", "kind")
    n = two.withColumn("i", F.row_number().over(mine.orderBy("ts", "k", "x")).cast("long")).withColumn("step", F.when(F.col("kind") == "video", VIDEO_STEP).otherwise(SOUND_STEP))
    pts = F.max(F.col("target") - F.col("i") * F.col("step")).over(mine.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) + F.col("i") * F.col("step")
    s = n.withColumn("pts", pts)
    return s.select("stream_id", "kind", "i", "pts", F.row_number().over(Window.partitionBy("stream_id").orderBy("pts", "kind", "i")).cast("long").alias("place"))


_BASE_NAME = r"regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1)"
_SUFFIX = r"lower(regexp_extract({}, '(\.[A-Za-z0-9]+)$', 1))"


@query(
    f"""WITH u AS (SELECT page_id, coalesce(nullif({_BASE_NAME}, ''), 'video.mp4') AS name, CASE WHEN page_id % 9 = 0 THEN 0 ELSE length(coalesce(html, '')) END AS size FROM pages),
    n AS (SELECT *, CASE WHEN {_SUFFIX.format('name')} = '' THEN concat(name, ['.MP4', '.mkv', '.txt', '.zip'][1 + CAST(page_id % 4 AS INT)]) ELSE name END AS filename FROM u), s AS (SELECT *, {_SUFFIX.format('filename')} AS suffix FROM n)
    SELECT page_id, filename, CASE WHEN suffix NOT IN ('.mp4', '.mov', '.mkv', '.m4v', '.avi', '.webm') THEN 415 WHEN size = 0 THEN 400 ELSE 201 END AS code, CASE suffix WHEN '.mp4' THEN 'video/mp4' WHEN '.zip' THEN 'application/zip' ELSE 'application/octet-stream' END AS media_type,
      CASE WHEN suffix IN ('.mp4', '.mov', '.mkv', '.m4v', '.avi', '.webm') AND size > 0 THEN concat(substr(md5(CAST(page_id AS VARCHAR)), 1, 8), '_', filename) END AS stored_as FROM s"""
)
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of an uploaded file: refused by its suffix, refused as empty, or stored under its task's id; and its media type."""
    base = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)$", 1)
    name = F.when(base == "", "video.mp4").otherwise(F.coalesce(base, F.lit("video.mp4")))
    ending = lambda c: F.lower(F.regexp_extract(c, r"(\.[A-Za-z0-9]+)$", 1))
    u = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.when(F.col("page_id") % 9 == 0, 0).otherwise(F.length(F.coalesce("html", F.lit("")))).alias("size"))
    added = F.element_at(F.array(*map(F.lit, (".MP4", ".mkv", ".txt", ".zip"))), (F.col("page_id") % 4 + 1).cast("int"))
    n = u.withColumn("filename", F.when(ending(F.col("name")) == "", F.concat("name", added)).otherwise(F.col("name"))).withColumn("suffix", ending(F.col("filename")))
    video = F.col("suffix").isin(".mp4", ".mov", ".mkv", ".m4v", ".avi", ".webm")
    kind = F.when(F.col("suffix") == ".mp4", "video/mp4").when(F.col("suffix") == ".zip", "application/zip").otherwise("application/octet-stream")
    stored = F.when(video & (F.col("size") > 0), F.concat(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), F.lit("_"), "filename"))
    return n.select("page_id", "filename", F.when(~video, 415).when(F.col("size") == 0, 400).otherwise(201).alias("code"), kind.alias("media_type"), stored.alias("stored_as"))


@query(f"{ctes('spans')} SELECT span_id, CASE WHEN confidence < 0.72 THEN 'amber' ELSE 'plain' END AS timeline, CASE WHEN confidence >= 0.7 THEN 'green' ELSE 'plain' END AS strip FROM spans")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour of a span in the timeline and in the strip."""
    c = F.round("confidence", 9)
    return carriers.spans(spark, sf_dir).select("span_id", F.when(c < 0.72, "amber").otherwise("plain").alias("timeline"), F.when(c >= 0.7, "green").otherwise("plain").alias("strip"))
