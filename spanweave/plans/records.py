"""Stored tables: summaries, integrity, validation, editor operations, sampling plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals
from ..sources import carriers
from ..sources.carriers import ctes, table
from .registry import query
from .spans import _VALID, _out, _sql_merge, _valid


@query(
    f"""{ctes('spans')} SELECT c_custkey AS task_id, count(span_id) AS n_spans, coalesce(round(sum(end_at - start_at), 2), 0) AS total_duration FROM customer LEFT JOIN spans ON c_custkey = stream_id GROUP BY 1"""
)
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and total length of every task; tasks without spans count 0."""
    s = carriers.spans(spark, sf_dir).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("t"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"))
    out = c.join(s, c["task_id"] == s["stream_id"], "left")
    return out.select("task_id", F.coalesce("n", F.lit(0)).alias("n_spans"), F.coalesce("t", F.lit(0)).alias("total_duration"))


@query(
    f"""{ctes('spans')}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_at, end_at, span_id) AS k FROM spans)
    SELECT stream_id AS task_id, string_agg(k || ':' || start_at || '-' || end_at, ',' ORDER BY k) AS items, count(*) AS n_items FROM r GROUP BY 1"""
)
def nested_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of a task: its spans, numbered and in order."""
    w = Window.partitionBy("stream_id").orderBy("start", "end", "span_id")
    s = carriers.spans(spark, sf_dir).withColumn("k", F.row_number().over(w))
    items = F.array_sort(F.collect_list(F.struct("k", "start", "end")))
    out = s.groupBy("stream_id").agg(items.alias("x"), F.count(F.lit(1)).alias("n_items"))
    text = F.array_join(F.transform("x", lambda r: F.concat_ws("", r.k, F.lit(":"), r.start, F.lit("-"), r.end)), ",")
    return out.select(F.col("stream_id").alias("task_id"), text.alias("items"), "n_items")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 50 <> 0)")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children without a parent.  The tables have none, so the fixture deletes the parents whose key is divisible by 50."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 50 <> 0").select("o_orderkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@query("SELECT l_orderkey, count(*) AS n_left FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3) GROUP BY 1")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that stay after their parents of some customers are deleted."""
    gone = table(spark, sf_dir, "orders").where("o_custkey % 10 = 3").select("o_orderkey")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return line.join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_left"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    """WITH h AS (SELECT o_custkey AS task_id, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'uploaded' WHEN 'P' THEN 'processing' ELSE 'completed' END AS status FROM orders),
    p AS (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY o_orderkey) AS prev FROM h)
    SELECT coalesce(prev, 'new') AS prev, status, coalesce((prev IS NULL AND status = 'uploaded') OR (prev = 'uploaded' AND status = 'processing') OR (prev = 'processing' AND status IN ('completed', 'failed')) OR (prev IN ('completed', 'failed') AND status = 'processing'), false) AS allowed, count(*) AS n FROM p GROUP BY 1, 2, 3"""
)
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which changes of a task's status its history holds, and whether the state machine allows them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "O", "uploaded").when(F.col("o_orderstatus") == "P", "processing").otherwise("completed").alias("status"))
    o = o.withColumn("prev", F.coalesce(F.lag("status").over(Window.partitionBy("task_id").orderBy("o_orderkey")), F.lit("new")))
    ok = (
        (F.col("prev") == "new") & (F.col("status") == "uploaded")
        | (F.col("prev") == "uploaded") & (F.col("status") == "processing")
        | (F.col("prev") == "processing") & F.col("status").isin("completed", "failed")
        | F.col("prev").isin("completed", "failed") & (F.col("status") == "processing")
    )
    return o.select("prev", "status", ok.alias("allowed")).groupBy("prev", "status", "allowed").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{ctes('spans')} SELECT CASE WHEN start_at < 0 THEN 'negative' WHEN end_at <= start_at THEN 'not ordered' WHEN confidence < 0 OR confidence > 0.95 THEN 'confidence' WHEN isnan(confidence) OR isinf(confidence) THEN 'not finite' ELSE 'ok' END AS verdict, count(*) AS n FROM spans GROUP BY 1"""
)
def span_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = carriers.spans(spark, sf_dir)
    v = F.when(F.col("start") < 0, "negative").when(F.col("end") <= F.col("start"), "not ordered").when((F.col("confidence") < 0) | (F.col("confidence") > 0.95), "confidence").when(F.isnan("confidence"), "not finite").otherwise("ok")
    return s.groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_REQ = "SELECT p_partkey, lower(split_part(p_type, ' ', 1)) AS kind, p_size AS crf, length(p_name) * 40 AS n_spans FROM part"


@query(f"WITH r AS ({_REQ}) SELECT p_partkey, CASE WHEN kind NOT IN ('economy', 'standard', 'promo') THEN 'kind' WHEN crf NOT BETWEEN 16 AND 35 THEN 'crf' WHEN n_spans > 500 THEN 'spans' ELSE 'ok' END AS verdict FROM r")
def export_request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a kind (any case), a quality from 16 to 35 and at most 500 spans."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("kind"), "p_size", (F.length("p_name") * 40).alias("n_spans"))
    v = F.when(~F.col("kind").isin("economy", "standard", "promo"), "kind").when(~F.col("p_size").between(16, 35), "crf").when(F.col("n_spans") > 500, "spans").otherwise("ok")
    return p.select("p_partkey", v.alias("verdict"))


@query(
    r"""WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path, url FROM pages)
    SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS base, lower(regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1)) AS suffix, contains(url, '..') AS traverses, lower(regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1)) IN ('.mp4', '.mov', '.mkv', '.m4v', '.avi', '.webm') AS allowed FROM u"""
)
def path_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base name, suffix, allow-list and traversal test of a path."""
    u = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    suffix = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    return u.select("page_id", F.regexp_extract("path", r"([^/]*)$", 1).alias("base"), suffix.alias("suffix"), F.col("url").contains("..").alias("traverses"), suffix.isin(".mp4", ".mov", ".mkv", ".m4v", ".avi", ".webm").alias("allowed"))


# --- editor operations -------------------------------------------------------------------------------------------------

@query(
    f"""{ctes('spans')}, {_VALID}, q AS (SELECT *, start_at + 365 AS t FROM valid)
    SELECT span_id, stream_id, 1 AS part, start_at, CASE WHEN t > start_at + 3 AND t < end_at - 3 THEN t ELSE end_at END AS end_at FROM q UNION ALL SELECT span_id, stream_id, 2, t, end_at FROM q WHERE t > start_at + 3 AND t < end_at - 3"""
)
def editor_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split at a playhead that is more than a margin from both edges."""
    s = _valid(spark, sf_dir)
    t = F.col("start") + 365
    cut = (t > F.col("start") + 3) & (t < F.col("end") - 3)
    one = F.struct(F.lit(1).alias("part"), F.col("start").alias("s"), F.when(cut, t).otherwise(F.col("end")).alias("e"))
    two = F.struct(F.lit(2).alias("part"), t.alias("s"), F.col("end").alias("e"))
    x = s.select("span_id", "stream_id", F.explode(F.when(cut, F.array(one, two)).otherwise(F.array(one))).alias("x"))
    return x.select("span_id", "stream_id", "x.part", F.col("x.s").alias("start_at"), F.col("x.e").alias("end_at"))


@query(
    f"""{ctes('spans')}, {_VALID}, nudged AS (SELECT stream_id, span_id, confidence, greatest(0, start_at - CASE WHEN span_id % 3 = 0 THEN 20 ELSE 0 END) AS start_at, greatest(start_at + 2, end_at + CASE WHEN span_id % 3 = 0 THEN -5 ELSE 0 END) AS end_at FROM valid), {_sql_merge('nudged', 1, 'max')}
    SELECT stream_id, start_at, end_at, n, confidence FROM merged"""
)
def editor_nudge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nudge some spans' edges with a least length, then merge (greatest confidence)."""
    s = _valid(spark, sf_dir)
    some = F.col("span_id") % 3 == 0
    end = F.greatest(F.col("start") + 2, F.col("end") + F.when(some, -5).otherwise(0))
    s = s.withColumn("end", end).withColumn("start", F.greatest(F.lit(0), F.col("start") - F.when(some, 20).otherwise(0)))
    return _out(intervals.merge(s, 1, "confidence", keep="max", tie="span_id"), "n", "confidence")


@query(f"{ctes('spans')}, {_VALID}, {_sql_merge('valid', 100)} SELECT stream_id, start_at, end_at, n, confidence FROM merged")
def editor_merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(intervals.merge(_valid(spark, sf_dir), 100, "confidence", tie="span_id"), "n", "confidence")


@query(
    f"""{ctes('spans')}, {_VALID}, r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY start_at, end_at, span_id) AS k FROM valid)
    SELECT stream_id, min(start_at) AS start_at, max(end_at) AS end_at, min(confidence) AS confidence, count(*) AS n FROM r GROUP BY stream_id, CASE WHEN k <= 2 THEN 1 ELSE k END"""
)
def editor_merge_with_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first span of each stream joined with the next."""
    s = _valid(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("stream_id").orderBy("start", "end", "span_id")))
    s = s.withColumn("g", F.when(F.col("k") <= 2, 1).otherwise(F.col("k")))
    out = s.groupBy("stream_id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    return _out(out, "confidence", "n")


@query(
    f"""{ctes('spans')}, {_VALID}, m AS (SELECT stream_id, span_id, CASE WHEN span_id % 2 = 0 THEN start_at END AS mark_in, end_at AS mark_out FROM valid)
    SELECT stream_id, span_id, coalesce(mark_in, greatest(0, mark_out - 40)) AS start_at, mark_out AS end_at FROM m WHERE mark_out - coalesce(mark_in, greatest(0, mark_out - 40)) >= 3"""
)
def editor_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from in and out marks; an out mark alone takes the stretch before it."""
    s = _valid(spark, sf_dir)
    mark = F.when(F.col("span_id") % 2 == 0, F.col("start"))
    start = F.coalesce(mark, F.greatest(F.lit(0), F.col("end") - 40))
    return s.select("stream_id", "span_id", start.alias("start_at"), F.col("end").alias("end_at")).where("end_at - start_at >= 3")


@query(
    f"""{ctes('spans')}, {_VALID}, {_sql_merge('valid', 0)}, t AS (SELECT stream_id, sum(end_at - start_at) AS selected, max(end_at) - min(start_at) + 100 AS total FROM merged GROUP BY 1)
    SELECT stream_id, CAST(selected AS BIGINT) AS selected, CAST(greatest(0, least(100, trunc((1 - selected / CAST(total AS DOUBLE)) * 100))) AS INT) AS reduction FROM t"""
)
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected length and how much shorter it makes the whole, in whole percent."""
    m = intervals.merge(_valid(spark, sf_dir), 0, tie="span_id")
    t = m.groupBy("stream_id").agg(F.sum(F.col("end") - F.col("start")).alias("selected"), (F.max("end") - F.min("start") + 100).alias("total"))
    return t.select("stream_id", "selected", F.greatest(F.lit(0), F.least(F.lit(100), ((1 - F.col("selected") / F.col("total")) * 100).cast("int"))).alias("reduction"))


def merged_status(have: Column, add: Column) -> Column:
    """Review status of two merged spans: approved, then flagged, then rejected if both are; else what was there, or of a rejected one the other's."""
    return (
        F.when((have == "approved") | (add == "approved"), "approved").when((have == "flagged") | (add == "flagged"), "flagged")
        .when((have == "rejected") & (add == "rejected"), "rejected").when(have == "rejected", add).otherwise(have)
    )


@query(
    f"""{ctes('spans').replace('WITH', 'WITH RECURSIVE', 1)}, {_VALID}, a AS (SELECT *, ['normal', 'approved', 'flagged', 'rejected'][1 + CAST(span_id % 4 AS INT)] AS status, max(end_at) OVER (PARTITION BY stream_id ORDER BY start_at, end_at, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM valid),
    b AS (SELECT *, sum(CASE WHEN start_at > reach THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY start_at, end_at, span_id ROWS UNBOUNDED PRECEDING) AS g FROM a), o AS (SELECT *, row_number() OVER (PARTITION BY stream_id, g ORDER BY start_at, end_at, span_id) AS k FROM b),
    r AS (SELECT stream_id, g, k, start_at AS s, end_at AS e, status FROM o WHERE k = 1
      UNION ALL SELECT o.stream_id, o.g, o.k, r.s, greatest(r.e, o.end_at), CASE WHEN r.status = 'approved' OR o.status = 'approved' THEN 'approved' WHEN r.status = 'flagged' OR o.status = 'flagged' THEN 'flagged' WHEN r.status = 'rejected' AND o.status = 'rejected' THEN 'rejected' WHEN r.status = 'rejected' THEN o.status ELSE r.status END
      FROM r JOIN o ON o.stream_id = r.stream_id AND o.g = r.g AND o.k = r.k + 1)
    SELECT stream_id, s AS start_at, arg_max(e, k) AS end_at, arg_max(status, k) AS status FROM r GROUP BY stream_id, g, s"""
)
def review_status_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of merged spans, folded left to right."""
    s = _valid(spark, sf_dir)
    names = F.array(*[F.lit(x) for x in ("normal", "approved", "flagged", "rejected")])
    s = s.withColumn("status", F.element_at(names, (F.col("span_id") % 4 + 1).cast("int")))
    w = Window.partitionBy("stream_id").orderBy("start", "end", "span_id")
    s = s.withColumn("new", F.coalesce((F.col("start") - F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) > 0).cast("int"), F.lit(0)))
    s = s.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("stream_id", "g").agg(F.array_sort(F.collect_list(F.struct("start", "end", "span_id", "status"))).alias("x"), F.max("end").alias("end"))
    rest = F.transform(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(1))), lambda r: r.status)
    status = F.when(F.size("x") == 1, F.get("x", F.lit(0)).status).otherwise(F.aggregate(rest, F.get("x", F.lit(0)).status, merged_status))
    return g.select("stream_id", F.get("x", F.lit(0)).start.alias("start_at"), F.col("end").alias("end_at"), status.alias("status"))


# --- sampling plans and device scores ------------------------------------------------------------------------------------

@query(
    """WITH t AS (SELECT c_custkey, (c_custkey * 37) % 1800 AS dur, CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 5 END AS fps, CASE c_custkey % 3 WHEN 0 THEN 900 WHEN 1 THEN 1200 ELSE 1800 END AS most FROM customer)
    SELECT c_custkey, CASE WHEN dur > 900 THEN 2 WHEN dur > 480 THEN 3 WHEN dur > 240 THEN least(4, fps) WHEN dur > 120 THEN greatest(3, fps - 1) ELSE fps END AS fps,
           greatest(400, least(most, CASE WHEN dur > 900 THEN 1000 WHEN dur > 480 THEN 1200 WHEN dur > 240 THEN 1400 ELSE most END)) AS samples FROM t"""
)
def sampling_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames a second and sample cap by length and tier."""
    c = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") * 37) % 1800).alias("dur"), (F.col("c_custkey") % 3).alias("tier"))
    fps = F.when(F.col("tier") == 0, 3).when(F.col("tier") == 1, 4).otherwise(5)
    most = F.when(F.col("tier") == 0, 900).when(F.col("tier") == 1, 1200).otherwise(1800)
    d = F.col("dur")
    rate = F.when(d > 900, 2).when(d > 480, 3).when(d > 240, F.least(F.lit(4), fps)).when(d > 120, F.greatest(F.lit(3), fps - 1)).otherwise(fps)
    cap = F.when(d > 900, 1000).when(d > 480, 1200).when(d > 240, 1400).otherwise(most)
    return c.select("c_custkey", rate.alias("fps"), F.greatest(F.lit(400), F.least(most, cap)).alias("samples"))


@query(
    """WITH d AS (SELECT p_partkey, p_size * 256 AS ram, p_size % 9 AS cores, 24 + p_size % 12 AS sdk, p_size % 7 = 0 AS emulator FROM part),
    s AS (SELECT *, (CASE WHEN ram >= 11000 THEN 50 WHEN ram >= 7500 THEN 40 WHEN ram >= 5500 THEN 28 WHEN ram >= 3500 THEN 18 ELSE 8 END + CASE WHEN cores >= 8 THEN 30 WHEN cores >= 6 THEN 24 WHEN cores >= 4 THEN 16 ELSE 8 END + CASE WHEN sdk >= 33 THEN 10 WHEN sdk >= 29 THEN 8 ELSE 4 END) AS raw FROM d),
    t AS (SELECT *, CAST(floor(CASE WHEN emulator THEN raw * 0.85 ELSE raw END) AS INT) AS score FROM s)
    SELECT p_partkey, score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'mid' ELSE 'low' END AS class, score >= 45 AS recommended, CASE WHEN ram < 2048 THEN 'fast' WHEN ram < 3072 THEN 'standard' ELSE 'precise' END AS tier FROM t"""
)
def device_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, class and best tier of a device by memory, cores and system version."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 256).alias("ram"), (F.col("p_size") % 9).alias("cores"), (24 + F.col("p_size") % 12).alias("sdk"), (F.col("p_size") % 7 == 0).alias("emulator"))
    ram, cores, sdk = F.col("ram"), F.col("cores"), F.col("sdk")
    raw = (
        F.when(ram >= 11000, 50).when(ram >= 7500, 40).when(ram >= 5500, 28).when(ram >= 3500, 18).otherwise(8)
        + F.when(cores >= 8, 30).when(cores >= 6, 24).when(cores >= 4, 16).otherwise(8)
        + F.when(sdk >= 33, 10).when(sdk >= 29, 8).otherwise(4)
    )
    p = p.withColumn("score", F.floor(F.when(F.col("emulator"), raw * 0.85).otherwise(raw)).cast("int"))
    s = F.col("score")
    tier = F.when(ram < 2048, "fast").when(ram < 3072, "standard").otherwise("precise")
    return p.select("p_partkey", "score", F.when(s >= 75, "high").when(s >= 50, "mid").otherwise("low").alias("class"), (s >= 45).alias("recommended"), tier.alias("tier"))


# --- regions ----------------------------------------------------------------------------------------------------------------

#: The default court region in unit coordinates (fixed values).
COURT = ((0.20, 0.34), (0.82, 0.34), (0.98, 0.96), (0.02, 0.96))


def polygon_area(points: Column) -> Column:
    """Area by the shoelace sum over each point and the next."""
    nxt = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    cross = F.zip_with(points, nxt, lambda a, b: a.x * b.y - b.x * a.y)
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v)) / 2


def court() -> Column:
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in COURT])


def inside_polygon(x: Column, y: Column, corners: tuple[tuple[float, float], ...] = COURT) -> Column:
    """Even-odd test: an odd number of edges crosses the ray to the right."""
    odd = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        crosses = (F.lit(y1) > y) != (F.lit(y2) > y)
        hit = crosses & (x < (x2 - x1) * (y - y1) / ((y2 - y1) or 1e-12) + x1)
        odd = odd + hit.cast("int")
    return odd % 2 == 1


_EDGES = " + ".join(f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < ({x2 - x1!r}) * (y - {y1}) / ({(y2 - y1) or 1e-12!r}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in zip(COURT, COURT[1:] + COURT[:1], strict=True))
_SHOE = " + ".join(f"(({x1}) * ({y2}) - ({x2}) * ({y1}))" for (x1, y1), (x2, y2) in (((f"({a[0]} + s)", a[1]), (f"({b[0]} + s)", b[1])) for a, b in zip(COURT, COURT[1:] + COURT[:1], strict=True)))


@query(f"WITH c AS (SELECT c_custkey, (c_custkey % 5) / 100.0 AS s FROM customer) SELECT c_custkey, round(abs({_SHOE}) / 2, 9) AS area, round(abs({_SHOE}) / 2, 9) >= 0.02 AS valid FROM c")
def roi_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and validity of a region (shifted a little for each task)."""
    s = (F.col("c_custkey") % 5) / 100.0
    points = F.transform(court(), lambda p: F.struct((p.x + s).alias("x"), p.y.alias("y")))
    area = F.round(polygon_area(points), 9)
    return table(spark, sf_dir, "customer").select("c_custkey", area.alias("area"), (area >= 0.02).alias("valid"))


@query(f"{ctes('track')} SELECT stream_id, ts, ({_EDGES}) % 2 = 1 AS in_court, x BETWEEN {0.02 - 0.08!r} AND {0.98 + 0.08!r} AND y BETWEEN 0.02 AND {0.96 + 0.08!r} AS in_reach FROM track")
def point_in_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a track point is in the court, and in the wider box around it."""
    reach = F.col("x").between(0.02 - 0.08, 0.98 + 0.08) & F.col("y").between(0.02, 0.96 + 0.08)
    return carriers.track(spark, sf_dir).select("stream_id", "ts", inside_polygon(F.col("x"), F.col("y")).alias("in_court"), reach.alias("in_reach"))


# --- signals and axis helpers --------------------------------------------------------------------------------------------------

_ENERGY_K = "e AS (SELECT court_id, ts, e5, row_number() OVER (PARTITION BY court_id ORDER BY ts) AS k FROM energy)"


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Window]:
    return carriers.energy(spark, sf_dir), Window.partitionBy("court_id").orderBy("ts")


@query(f"{ctes('energy')}, {_ENERGY_K} SELECT court_id, ts, CAST(sum(e5) OVER (PARTITION BY court_id ORDER BY ts ROWS BETWEEN 40 PRECEDING AND 39 FOLLOWING) AS BIGINT) / 80.0 AS smooth FROM e")
def moving_average_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred mean over 80 samples with a constant divisor (zero beyond the ends)."""
    e, w = _series(spark, sf_dir)
    return e.select("court_id", "ts", (F.sum("e5").over(w.rowsBetween(-40, 39)) / 80.0).alias("smooth"))


@query(f"{ctes('energy')}, {_ENERGY_K} SELECT court_id, ts, CAST(sum(e5) OVER w AS BIGINT) / CAST(count(*) OVER w AS DOUBLE) AS smooth FROM e WINDOW w AS (PARTITION BY court_id ORDER BY ts ROWS BETWEEN 79 PRECEDING AND CURRENT ROW)")
def moving_average_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing mean over up to 80 samples."""
    e, w = _series(spark, sf_dir)
    w = w.rowsBetween(-79, 0)
    return e.select("court_id", "ts", (F.sum("e5").over(w) / F.count(F.lit(1)).over(w).cast("double")).alias("smooth"))


@query(f"{ctes('energy')}, z AS (SELECT court_id, ts, e5, lag(e5) OVER w AS a, lead(e5) OVER w AS b FROM energy WINDOW w AS (PARTITION BY court_id ORDER BY ts)) SELECT court_id, ts, e5 FROM z WHERE e5 >= a AND e5 >= b AND e5 > 5000")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples over a level that are no smaller than both neighbours."""
    e, w = _series(spark, sf_dir)
    z = e.select("court_id", "ts", "e5", F.lag("e5").over(w).alias("a"), F.lead("e5").over(w).alias("b"))
    return z.where("e5 >= a and e5 >= b and e5 > 5000").select("court_id", "ts", "e5")


@query("SELECT c_custkey, printf('%02d:%02d', (c_custkey * 7) // 60, (c_custkey * 7) % 60) AS clock, CASE WHEN c_custkey * 7 / 8.0 <= 1 THEN 1 WHEN c_custkey * 7 / 8.0 <= 2 THEN 2 WHEN c_custkey * 7 / 8.0 <= 5 THEN 5 WHEN c_custkey * 7 / 8.0 <= 10 THEN 10 WHEN c_custkey * 7 / 8.0 <= 15 THEN 15 WHEN c_custkey * 7 / 8.0 <= 30 THEN 30 WHEN c_custkey * 7 / 8.0 <= 60 THEN 60 WHEN c_custkey * 7 / 8.0 <= 120 THEN 120 WHEN c_custkey * 7 / 8.0 <= 300 THEN 300 ELSE 600 END AS tick FROM customer")
def axis_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock text of a length and the first step that keeps eight labels."""
    d = F.col("c_custkey") * 7
    steps = F.array(*[F.lit(x) for x in (1, 2, 5, 10, 15, 30, 60, 120, 300, 600)])
    tick = F.coalesce(F.get(F.filter(steps, lambda s: s >= d / 8.0), F.lit(0)), F.lit(600))
    return table(spark, sf_dir, "customer").select("c_custkey", F.format_string("%02d:%02d", F.floor(d / 60), d % 60).alias("clock"), tick.alias("tick"))
