"""Highlight features, rules and trims over pulse islands with the motion of their court.

The event carrier has one sample for each event of a court, so a stream's time begins half a unit before its first pulse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import UNIT, micros, us
from ..operators import rules
from ..operators.highlight import filter_streams
from ..operators.islands import with_island
from ..operators.lookup import small_side
from ..operators.motion_index import active_runs, between, first_at_or_after, last_at_or_before, running, total, with_triples
from ..operators.staging import staged
from ..sources import carriers
from ..sources.carriers import ctes
from .registry import query
from .segments import _STATS, BUCKET, _sql_islands, court_stats, mean_between

SERVE_PAD, LAND_PAD = 1.05, 0.60
_U = f"{UNIT}.0"


def pulse_spans(spark: SparkSession, sf_dir: str, silence: float = 1.85) -> DataFrame:
    """One row for each island with its shape: counts, bounds, distances inside and around."""
    p = with_island(carriers.pulses(spark, sf_dir), ["stream_id"], "ts", us(silence), tie="event_id")
    o = Window.partitionBy("stream_id").orderBy("ts", "event_id")
    i = Window.partitionBy("stream_id", "island").orderBy("ts", "event_id")
    p = p.withColumn("t0", F.min("ts").over(Window.partitionBy("stream_id")) - us(0.5))
    p = p.withColumn("isi", F.col("ts") - F.lag("ts").over(i)).withColumn("k", F.row_number().over(i)).withColumn("back", F.row_number().over(Window.partitionBy("stream_id", "island").orderBy(F.col("ts").desc(), F.col("event_id").desc())))
    p = p.withColumn("before", F.lag("ts").over(o)).withColumn("after", F.lead("ts").over(o))
    first, last = F.min("ts"), F.max("ts")
    g = p.groupBy("stream_id", "island", "court_id", "t0").agg(
        F.count(F.lit(1)).cast("int").alias("n"), first.alias("first"), last.alias("last"),
        F.max(F.when(F.col("k") == 1, F.col("before"))).alias("prev"), F.max(F.when(F.col("back") == 1, F.col("after"))).alias("next"),
        F.max(F.when(F.col("k") == 2, F.col("isi"))).alias("fi_us"), F.max(F.when(F.col("back") == 1, F.col("isi"))).alias("li_us"),
        F.max(F.when(F.col("k") == 2, F.col("ts"))).alias("second"),
        F.min("isi").alias("lo_us"), F.max("isi").alias("hi_us"),
        F.coalesce(F.max(F.col("isi").between(us(1.45), us(1.80))), F.lit(False)).alias("mid_isi"),
    )
    s, e = F.col("first") - us(SERVE_PAD), F.col("last") + us(LAND_PAD)
    unit = lambda c: F.col(c) / float(UNIT)
    return g.select(
        "stream_id", "island", "court_id", "n", "first", "last", s.alias("start"), e.alias("end"), "mid_isi",
        ((e - s) / float(UNIT)).alias("d"), (F.col("n") / F.greatest(F.lit(0.25), (F.col("last") - F.col("first")) / float(UNIT))).alias("rho"),
        F.coalesce((F.col("first") - F.col("prev")) / float(UNIT), F.lit(99.0)).alias("iso"), F.coalesce((F.col("next") - F.col("last")) / float(UNIT), F.lit(99.0)).alias("nx"),
        F.coalesce(unit("fi_us"), F.lit(0.0)).alias("fi"), F.coalesce(unit("li_us"), F.lit(0.0)).alias("li"),
        F.coalesce(unit("lo_us"), F.lit(0.0)).alias("lo_isi"), F.coalesce(unit("hi_us"), F.lit(0.0)).alias("hi_isi"),
        F.coalesce((F.col("last") - F.col("second")) / float(UNIT), F.lit(0.0)).alias("tail_span"),
        ((F.col("first") - F.col("t0")) / float(UNIT)).alias("first_at"), ((F.col("last") - F.col("t0")) / float(UNIT)).alias("last_at"), ((s - F.col("t0")) / float(UNIT)).alias("start_at"),
    )


_PULSE_SPANS = f"""{_sql_islands('pulses', 'stream_id', us(1.85), extra=', event_id')},
  pz AS (SELECT *, min(ts) OVER (PARTITION BY stream_id) - {us(0.5)} AS t0, ts - lag(ts) OVER i AS isi, row_number() OVER i AS k, row_number() OVER (PARTITION BY stream_id, island ORDER BY ts DESC, event_id DESC) AS back,
    lag(ts) OVER o AS bef, lead(ts) OVER o AS aft FROM isl WINDOW o AS (PARTITION BY stream_id ORDER BY ts, event_id), i AS (PARTITION BY stream_id, island ORDER BY ts, event_id)),
  pg AS (SELECT stream_id, island, court_id, t0, CAST(count(*) AS INT) AS n, min(ts) AS f, max(ts) AS l, max(CASE WHEN k = 1 THEN bef END) AS prev, max(CASE WHEN back = 1 THEN aft END) AS nxt, max(CASE WHEN k = 2 THEN isi END) AS fi_us,
    max(CASE WHEN back = 1 THEN isi END) AS li_us, max(CASE WHEN k = 2 THEN ts END) AS sec, min(isi) AS lo_us, max(isi) AS hi_us, coalesce(bool_or(isi BETWEEN {us(1.45)} AND {us(1.80)}), false) AS mid_isi FROM pz GROUP BY 1, 2, 3, 4),
  ps AS (SELECT stream_id, island, court_id, n, f, l, f - {us(SERVE_PAD)} AS s, l + {us(LAND_PAD)} AS e, mid_isi, (l + {us(LAND_PAD)} - (f - {us(SERVE_PAD)})) / {_U} AS d, n / greatest(0.25, (l - f) / {_U}) AS rho,
    coalesce((f - prev) / {_U}, 99.0) AS iso, coalesce((nxt - l) / {_U}, 99.0) AS nx, coalesce(fi_us / {_U}, 0.0) AS fi, coalesce(li_us / {_U}, 0.0) AS li, coalesce(lo_us / {_U}, 0.0) AS lo_isi, coalesce(hi_us / {_U}, 0.0) AS hi_isi,
    coalesce((l - sec) / {_U}, 0.0) AS tail_span, (f - t0) / {_U} AS first_at, (l - t0) / {_U} AS last_at, (f - {us(SERVE_PAD)} - t0) / {_U} AS start_at FROM pg)"""


def motion_levels(e: DataFrame) -> DataFrame:
    """Of each court the levels that motion is measured against: active, burst peak, burst run, in court."""
    span = F.greatest(F.lit(0.0), F.col("a") - F.col("m"))
    return court_stats(e).select(
        "court_id", F.col("m").alias("base"), F.col("a").alias("p85"), (span < 1e-5).alias("flat"),
        F.when(span < 1e-5, F.greatest(F.col("m") + 0.004, F.lit(0.012))).otherwise(F.greatest(F.col("m") + 0.14 * span, F.lit(0.008))).alias("active_at"),
        F.greatest(F.lit(0.016), F.col("m") + 0.40 * span).alias("peak_at"), F.greatest(F.lit(0.014), F.col("m") + 0.28 * span).alias("run_at"), F.greatest(F.lit(0.008), F.col("m") + 0.10 * span).alias("court_at"),
    )


_R = "greatest(0.0, a - m)"
_LEVELS = f"""{_STATS}, lv AS (SELECT court_id, m AS base, a AS p85, {_R} < 0.00001 AS flat, CASE WHEN {_R} < 0.00001 THEN greatest(m + 0.004, 0.012) ELSE greatest(m + 0.14 * {_R}, 0.008) END AS active_at,
  greatest(0.016, m + 0.40 * {_R}) AS peak_at, greatest(0.014, m + 0.28 * {_R}) AS run_at, greatest(0.008, m + 0.10 * {_R}) AS court_at FROM stats)"""


def activity(name: str) -> Column:
    """Share of samples at the active level in a range of the index; 0 without samples; 1 on a flat series that is high all along (rows with the court's levels)."""
    n = total(name, "n")
    high = F.col("flat") & (F.col("base") >= 0.012) & (total(name, "e5") / (n * 100000.0) >= 0.85 * F.col("base"))
    return F.when(n == 0, 0.0).when(high, 1.0).otherwise(total(name, "active") / n.cast("double"))


def _sql_share(inside: str) -> str:
    n = f"sum(CASE WHEN {inside} THEN 1 ELSE 0 END)"
    return f"""CASE WHEN {n} = 0 THEN 0.0 WHEN any_value(flat) AND any_value(base) >= 0.012 AND sum(CASE WHEN {inside} THEN e5 END) / ({n} * 100000.0) >= 0.85 * any_value(base) THEN 1.0
      ELSE sum(CASE WHEN {inside} AND energy >= active_at THEN 1 ELSE 0 END) / CAST({n} AS DOUBLE) END"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulse spans with the motion features of the rules: lookups in running totals of each court's samples, whatever a span's length."""
    p, e = carriers.pulses(spark, sf_dir), carriers.energy(spark, sf_dir)
    lv = small_side(motion_levels(e), "court-levels")  # a row for each court
    index = motion_index(e, lv)
    s = pulse_spans(spark, sf_dir).join(lv, "court_id")
    wide = F.col("last") - F.col("first") >= us(0.4)
    s = s.withColumn("b0", F.when(wide, F.col("first")).otherwise(F.col("first") - us(0.4))).withColumn("b1", F.when(wide, F.col("last")).otherwise(F.col("last") + us(0.4)))
    s = staged(s, "pulse-spans")
    keys = ["stream_id", "island"]
    ranges = {"all": (F.col("first"), F.col("last")), "lead": (F.col("first") - us(2.2), F.col("first") - us(0.5)), "hot": (F.col("b0"), F.col("b1"))}
    three = F.col("hot_1.triple_ends") - F.col("hot_0.triple_starts") > 0  # a triple that ends in the range and does not begin before it
    m = s.join(between(s, index, "court_id", "ts", keys, ranges, BUCKET), keys)
    m = m.withColumns({"ac": activity("all"), "pre": activity("lead"), "burst": (total("hot", "peak") > 0) | three, "mean_e": mean_between("all")}).drop(*[f"{r}_{k}" for r in ranges for k in (0, 1)])
    lively = between(p.select("court_id", "event_id", "ts"), index.select("court_id", "ts", "court"), "court_id", "ts", ["event_id"], {"near": (F.col("ts") - us(0.4), F.col("ts") + us(0.4))}, BUCKET).select("event_id", (total("near", "court") > 0).alias("lively"))
    nin = with_island(p, ["stream_id"], "ts", us(1.85), tie="event_id").join(lively, "event_id").groupBy(*keys).agg(F.sum(F.col("lively").cast("int")).cast("int").alias("nin"))
    return m.join(nin, keys).withColumn("motion", F.lit(True)).withColumn("peeled", F.lit(False))


def motion_index(e: DataFrame, lv: DataFrame) -> DataFrame:
    """Running totals by court of what the rules ask of samples: active, burst peak, in court, three in a row of a burst."""
    x = with_triples(e.join(lv, "court_id"), "court_id", "ts", "e5", F.col("energy") >= F.col("run_at"), BUCKET)
    counts = {"active": F.col("energy") >= F.col("active_at"), "peak": F.col("energy") >= F.col("peak_at"), "court": F.col("energy") >= F.col("court_at")}
    return running(x, "court_id", "ts", {"n": F.lit(1), "e5": F.col("e5"), **{k: c.cast("int") for k, c in counts.items()}, "triple_ends": F.col("triple_ends"), "triple_starts": F.col("triple_starts")}, BUCKET)


_FEATURES = f"""{_PULSE_SPANS}, {_LEVELS},
  sx AS (SELECT ps.*, lv.base, lv.p85, lv.flat, lv.active_at, lv.peak_at, lv.run_at, lv.court_at, CASE WHEN l - f >= {us(0.4)} THEN f ELSE f - {us(0.4)} END AS b0, CASE WHEN l - f >= {us(0.4)} THEN l ELSE l + {us(0.4)} END AS b1 FROM ps JOIN lv USING (court_id)),
  nr AS (SELECT sx.*, e.ts, e.energy, e.e5, (e.ts BETWEEN b0 AND b1 AND e.energy >= run_at) AS hot FROM sx JOIN energy e ON e.court_id = sx.court_id AND e.ts BETWEEN f - {us(2.2)} AND greatest(l, b1)),
  n3 AS (SELECT *, hot AND coalesce(lag(hot, 1) OVER w, false) AND coalesce(lag(hot, 2) OVER w, false) AS three FROM nr WINDOW w AS (PARTITION BY stream_id, island ORDER BY ts)),
  mo AS (SELECT stream_id, island, {_sql_share('ts BETWEEN f AND l')} AS ac, {_sql_share(f'ts BETWEEN f - {us(2.2)} AND f - {us(0.5)}')} AS pre, bool_or((ts BETWEEN b0 AND b1 AND energy >= peak_at) OR three) AS burst,
    sum(CASE WHEN ts BETWEEN f AND l THEN e5 END) / (sum(CASE WHEN ts BETWEEN f AND l THEN 1 ELSE 0 END) * 100000.0) AS mean_e FROM n3 GROUP BY 1, 2),
  lm AS (SELECT p.stream_id, p.island, p.event_id, p.court_id, max(e.energy) AS near_max FROM isl p JOIN energy e ON e.court_id = p.court_id AND e.ts BETWEEN p.ts - {us(0.4)} AND p.ts + {us(0.4)} GROUP BY ALL),
  ni AS (SELECT stream_id, island, CAST(sum(CASE WHEN near_max >= court_at THEN 1 ELSE 0 END) AS INT) AS nin FROM lm JOIN lv USING (court_id) GROUP BY 1, 2),
  ft AS (SELECT sx.*, mo.ac, mo.pre, mo.burst, mo.mean_e, ni.nin, true AS motion, false AS peeled FROM sx JOIN mo USING (stream_id, island) JOIN ni USING (stream_id, island))"""


@query(f"{ctes('pulses', 'energy')}, {_FEATURES} SELECT stream_id, f AS first_ts, n, nin, burst, round(ac, 12) AS ac, round(pre, 12) AS pre, round(mean_e, 12) AS mean_e, round(iso, 6) AS iso, round(nx, 6) AS nx FROM ft")
def highlight_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c, k: F.round(c, k).alias(c)
    return features(spark, sf_dir).select("stream_id", F.col("first").alias("first_ts"), "n", "nin", "burst", r("ac", 12), r("pre", 12), r("mean_e", 12), r("iso", 6), r("nx", 6))


@query(f"{ctes('pulses', 'energy')}, {_FEATURES} SELECT stream_id, f AS first_ts, l AS last_ts, n, {rules.reject_rule()} AS reject_rule FROM ft")
def highlight_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span with the first rule that rejects it (null: a highlight)."""
    return features(spark, sf_dir).select("stream_id", F.col("first").alias("first_ts"), F.col("last").alias("last_ts"), "n", F.expr(rules.reject_rule()).alias("reject_rule"))


@query(f"{ctes('pulses', 'energy')}, {_FEATURES}, v AS (SELECT {rules.reject_rule()} AS reject_rule FROM ft) SELECT coalesce(reject_rule, 'kept') AS verdict, count(*) AS n FROM v GROUP BY 1")
def reject_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select(F.coalesce(F.expr(rules.reject_rule()), F.lit("kept")).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"{ctes('pulses', 'energy')}, {_FEATURES} SELECT stream_id, f AS first_ts, {rules.reject_rule(**rules.DEVICE)} AS reject_rule FROM ft")
def highlight_rules_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules with the on-device constants."""
    return features(spark, sf_dir).select("stream_id", F.col("first").alias("first_ts"), F.expr(rules.reject_rule(**rules.DEVICE)).alias("reject_rule"))


@query(f"{ctes('pulses', 'energy')}, {_FEATURES} SELECT stream_id, f AS first_ts, round(ac, 12) AS active FROM ft")
def active_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("stream_id", F.col("first").alias("first_ts"), F.round("ac", 12).alias("active"))


@query(f"{ctes('pulses', 'energy')}, {_FEATURES} SELECT stream_id, f AS first_ts, burst FROM ft")
def motion_burst_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("stream_id", F.col("first").alias("first_ts"), "burst")


@query(f"{ctes('pulses', 'energy')}, {_FEATURES} SELECT stream_id, f AS first_ts, n, nin FROM ft")
def in_court_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("stream_id", F.col("first").alias("first_ts"), "n", "nin")


@query(
    f"""{ctes('pulses')}, {_PULSE_SPANS} SELECT stream_id, f AS first_ts, {rules.SERVE_LIKE} AS serve_like, {rules.COMPACT_THREE} AS compact_three, {rules.WALK_IN} AS walk_in,
    CASE WHEN n = 1 AND iso >= 3.30 AND iso < 5.0 AND nx >= 3.60 THEN 'serve' WHEN n = 1 AND iso >= 9 AND nx BETWEEN 1.80 AND 3.50 THEN 'long' WHEN n = 1 THEN 'none' END AS one_pulse FROM ps"""
)
def one_pulse_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that let short spans in."""
    case = "CASE WHEN n = 1 AND iso >= 3.30 AND iso < 5.0 AND nx >= 3.60 THEN 'serve' WHEN n = 1 AND iso >= 9 AND nx BETWEEN 1.80 AND 3.50 THEN 'long' WHEN n = 1 THEN 'none' END"
    return pulse_spans(spark, sf_dir).select("stream_id", F.col("first").alias("first_ts"), F.expr(rules.SERVE_LIKE).alias("serve_like"), F.expr(rules.COMPACT_THREE).alias("compact_three"), F.expr(rules.WALK_IN).alias("walk_in"), F.expr(case).alias("one_pulse"))


# --- splits and trims: pairwise predicates over the pulses of wide islands -----------------------------------------

_WIDE = us(4.2)
_WIDE_P = f"""{_sql_islands('pulses', 'stream_id', _WIDE, out='wd', extra=', event_id')},
  wp AS (SELECT stream_id, island, ts, event_id, count(*) OVER g AS n, row_number() OVER o AS k, ts - lag(ts) OVER o AS isi, lead(ts) OVER o - ts AS nxt, max(ts) OVER g AS l, min(ts) OVER g AS f FROM wd
    WINDOW g AS (PARTITION BY stream_id, island), o AS (PARTITION BY stream_id, island ORDER BY ts, event_id))"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = with_island(carriers.pulses(spark, sf_dir).select("stream_id", "court_id", "ts", "event_id"), ["stream_id"], "ts", _WIDE, tie="event_id")
    g = Window.partitionBy("stream_id", "island")
    o = g.orderBy("ts", "event_id")
    return p.select("*", F.count(F.lit(1)).over(g).alias("n"), F.row_number().over(o).alias("k"), (F.col("ts") - F.lag("ts").over(o)).alias("isi"), (F.lead("ts").over(o) - F.col("ts")).alias("nxt"), F.max("ts").over(g).alias("l"), F.min("ts").over(g).alias("f"))


@query(
    f"""{ctes('pulses')}, {_WIDE_P}, c AS (SELECT *, sum(CASE WHEN isi > {us(1.85)} AND n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM wp)
    SELECT stream_id, min(ts) - {us(SERVE_PAD)} AS start_at, max(ts) + {us(LAND_PAD)} AS end_at, count(*) AS n_pulses FROM c GROUP BY stream_id, island, part"""
)
def silence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide islands cut at silences that no motion keeps live (here: without motion)."""
    p = _wide(spark, sf_dir)
    p = with_island(p, ["stream_id", "island"], "ts", breaks=(F.col("isi") > us(1.85)) & (F.col("n") >= 2), tie="event_id", name="part")
    out = p.groupBy("stream_id", "island", "part").agg((F.min("ts") - us(SERVE_PAD)).alias("start_at"), (F.max("ts") + us(LAND_PAD)).alias("end_at"), F.count(F.lit(1)).alias("n_pulses"))
    return out.drop("island", "part")


@query(
    f"""{ctes('pulses')}, {_WIDE_P}, q AS (SELECT *, row_number() OVER (PARTITION BY stream_id, island ORDER BY isi DESC NULLS LAST, k DESC) AS r FROM wp WHERE n >= 5 AND l - f > {us(10)}),
    b AS (SELECT stream_id, island, max(CASE WHEN r = 1 AND isi >= {us(1.40)} THEN k END) AS cut FROM q GROUP BY 1, 2), z AS (SELECT wp.*, CASE WHEN b.cut IS NOT NULL AND k >= b.cut THEN 1 ELSE 0 END AS part FROM wp LEFT JOIN b USING (stream_id, island))
    SELECT stream_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_pulses, part FROM z GROUP BY stream_id, island, part"""
)
def force_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cut of a long blob at its largest gap (ties: the later)."""
    p = _wide(spark, sf_dir)
    long = (F.col("n") >= 5) & (F.col("l") - F.col("f") > us(10))
    r = F.row_number().over(Window.partitionBy("stream_id", "island").orderBy(F.col("isi").desc_nulls_last(), F.col("k").desc()))
    p = p.withColumn("r", r)
    cut = F.max(F.when(long & (F.col("r") == 1) & (F.col("isi") >= us(1.40)), F.col("k"))).over(Window.partitionBy("stream_id", "island"))
    p = p.withColumn("cut", cut).withColumn("part", F.when(F.col("cut").isNotNull() & (F.col("k") >= F.col("cut")), 1).otherwise(0))
    return p.groupBy("stream_id", "island", "part").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_pulses")).drop("island")


def _sql_applause(middle: int, most: int) -> str:
    return f"""{ctes('pulses')}, {_WIDE_P}, s AS (SELECT *, lead(ts, 5) OVER o AS t6, list(nxt) OVER (PARTITION BY stream_id, island ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS five FROM wp WINDOW o AS (PARTITION BY stream_id, island ORDER BY ts, event_id)),
    c AS (SELECT stream_id, island, min(CASE WHEN n >= 7 AND t6 IS NOT NULL AND list_sort(five)[3] < {middle} AND list_max(five) < {most} AND k >= 3 AND (ts >= f + 0.55 * (l - f) OR t6 - ts >= {us(3)}) THEN ts END) AS cut FROM s GROUP BY 1, 2)
    SELECT stream_id, f AS first_ts, CASE WHEN cut > f + {us(0.4)} THEN cut ELSE l END AS last_ts, max(n) AS n FROM wp JOIN c USING (stream_id, island) GROUP BY stream_id, island, f, l, cut"""


def trim_applause(p: DataFrame, middle: int, most: int) -> DataFrame:
    """A run of six pulses with a middle gap below ``middle`` and none of ``most`` or more, late in a span, ends it at its first pulse."""
    o = Window.partitionBy("stream_id", "island").orderBy("ts", "event_id")
    p = p.withColumn("t6", F.lead("ts", 5).over(o)).withColumn("five", F.sort_array(F.collect_list("nxt").over(o.rowsBetween(0, 4))))
    dense = (F.get("five", F.lit(2)) < middle) & (F.array_max("five") < most)
    late = (F.col("ts") >= F.col("f") + 0.55 * (F.col("l") - F.col("f"))) | (F.col("t6") - F.col("ts") >= us(3))
    at = F.min(F.when((F.col("n") >= 7) & F.col("t6").isNotNull() & dense & (F.col("k") >= 3) & late, F.col("ts")))
    out = p.groupBy("stream_id", "island", "f", "l").agg(at.alias("cut"), F.max("n").alias("n"))
    return out.select("stream_id", F.col("f").alias("first_ts"), F.when(F.col("cut") > F.col("f") + us(0.4), F.col("cut")).otherwise(F.col("l")).alias("last_ts"), "n")


@query(_sql_applause(us(1.36), us(1.60)))
def applause_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense run of six pulses near the tail cuts the span at its first pulse (limits widened for the event carrier; ``applause_trim_exact`` has the filter's own)."""
    return trim_applause(_wide(spark, sf_dir), us(1.36), us(1.60))


@query(
    f"""{ctes('pulses')}, {_WIDE_P}, s AS (SELECT *, max(CASE WHEN k = n THEN isi END) OVER (PARTITION BY stream_id, island) AS li FROM wp),
    c AS (SELECT stream_id, island, min(CASE WHEN n >= 7 AND k - 1 >= greatest(3, (n * 2) // 5) AND k <= n - 3 AND nxt >= {us(1.32)} AND NOT (nxt < {us(1.55)} AND li <= {us(0.55)}) THEN k END) AS cut FROM s GROUP BY 1, 2)
    SELECT stream_id, min(ts) AS first_ts, max(CASE WHEN k <= coalesce(cut, n) THEN ts END) AS last_ts, CAST(max(coalesce(cut, n)) AS BIGINT) AS n_kept FROM wp JOIN c USING (stream_id, island) GROUP BY stream_id, island"""
)
def post_land_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three and more pulses after a long hole in the later part of a span are cut off, unless a compact pair ends them."""
    p = _wide(spark, sf_dir)
    g = Window.partitionBy("stream_id", "island")
    p = p.withColumn("li", F.max(F.when(F.col("k") == F.col("n"), F.col("isi"))).over(g))
    late = (F.col("n") >= 7) & (F.col("k") - 1 >= F.greatest(F.lit(3), F.expr("(n * 2) div 5"))) & (F.col("k") <= F.col("n") - 3)
    hole = (F.col("nxt") >= us(1.32)) & ~((F.col("nxt") < us(1.55)) & (F.col("li") <= us(0.55)))
    p = p.withColumn("cut", F.coalesce(F.min(F.when(late & hole, F.col("k"))).over(g), F.col("n")))
    return p.groupBy("stream_id", "island").agg(F.min("ts").alias("first_ts"), F.max(F.when(F.col("k") <= F.col("cut"), F.col("ts"))).alias("last_ts"), F.max("cut").cast("long").alias("n_kept")).drop("island")


@query(
    f"""{ctes('pulses')}, {_WIDE_P}, t AS (SELECT stream_id, island, min(CASE WHEN n BETWEEN 4 AND 6 AND nxt BETWEEN {us(1.55)} AND {us(2.15)} AND n - k BETWEEN 2 AND 3 AND l - (ts + nxt) BETWEEN {us(1.40)} AND {us(2.60)} THEN k END) AS cut FROM wp GROUP BY 1, 2)
    SELECT stream_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_pulses FROM wp JOIN t USING (stream_id, island) WHERE cut IS NOT NULL AND k > cut GROUP BY stream_id, island"""
)
def tail_peel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact far tail of a small group, after its first hole of the right length."""
    p = _wide(spark, sf_dir)
    tail = F.col("l") - (F.col("ts") + F.col("nxt"))
    ok = F.col("n").between(4, 6) & F.col("nxt").between(us(1.55), us(2.15)) & (F.col("n") - F.col("k")).between(2, 3) & tail.between(us(1.40), us(2.60))
    p = p.withColumn("cut", F.min(F.when(ok, F.col("k"))).over(Window.partitionBy("stream_id", "island"))).where("cut is not null and k > cut")
    return p.groupBy("stream_id", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_pulses")).drop("island")


# --- walk back to the serve -----------------------------------------------------------------------------------------

_QUIET = 3


@query(
    f"""{ctes('pulses', 'energy')}, {_PULSE_SPANS}, {_STATS}, on_at AS (SELECT court_id, greatest(0.008, m + 0.08 * {_R}) AS onset FROM stats),
    wn AS (SELECT p.stream_id, p.island, p.f, e.ts, row_number() OVER (PARTITION BY p.stream_id, p.island ORDER BY e.ts) AS i, e.energy >= o.onset AS act, max(CASE WHEN e.ts <= p.f AND e.energy >= o.onset THEN e.ts END) OVER (PARTITION BY p.stream_id, p.island) AS anchor
      FROM ps p JOIN on_at o USING (court_id) JOIN energy e ON e.court_id = p.court_id AND e.ts BETWEEN p.f - {us(2.0)} AND p.f + {us(0.15)}),
    ac AS (SELECT *, i - lag(i) OVER (PARTITION BY stream_id, island ORDER BY i) AS step FROM wn WHERE act AND ts <= anchor),
    ag AS (SELECT *, sum(CASE WHEN step > {_QUIET + 1} THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, island ORDER BY i ROWS UNBOUNDED PRECEDING) AS grp FROM ac),
    st AS (SELECT stream_id, island, min(ts) AS t FROM (SELECT *, max(grp) OVER (PARTITION BY stream_id, island) AS g FROM ag) WHERE grp = g GROUP BY 1, 2)
    SELECT stream_id, p.f AS first_ts, CASE WHEN s.t IS NULL THEN p.f - {us(0.35)} ELSE greatest(p.f - {us(2.0)}, s.t - {us(0.35)}) END AS start_at FROM ps p LEFT JOIN st s USING (stream_id, island)"""
)
def walk_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back along the motion before the first pulse, over quiet stretches of up to three samples.

    The last active sample before the pulse is one lookup; its run says how far back that goes, and where the run begins before the look back the first active sample in it does.
    """
    s = walked_starts(pulse_spans(spark, sf_dir).select("stream_id", "court_id", "first"), carriers.energy(spark, sf_dir))
    return s.select("stream_id", F.col("first").alias("first_ts"), "start_at")


def walked_starts(s: DataFrame, e: DataFrame) -> DataFrame:
    """Adds ``start_at`` to rows with ``court_id, first``."""
    span = F.greatest(F.lit(0.0), F.col("a") - F.col("m"))
    onset = court_stats(e).select("court_id", F.greatest(F.lit(0.008), F.col("m") + 0.08 * span).alias("onset"))
    runs = active_runs(e.join(small_side(onset, "court-onset"), "court_id"), "court_id", "ts", "e5", F.col("energy") >= F.col("onset"), _QUIET, BUCKET)
    early = F.col("first") - us(2.0)
    x = last_at_or_before(s, F.col("first"), runs, "court_id", "ts", BUCKET, "anchor", "run_first")
    x = first_at_or_after(x, early, runs, "court_id", "ts", BUCKET, "edge")
    at = F.when(F.col("anchor") >= early, F.greatest("run_first", "edge"))
    start = F.when(at.isNotNull(), F.greatest(early, at - us(0.35))).otherwise(F.col("first") - us(0.35))
    return x.withColumn("start_at", start).select(*s.columns, "start_at")


@query()
def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole highlight filter, each stream with its own samples as motion (tested on golden vectors)."""
    p = carriers.pulses(spark, sf_dir)
    t0 = p.groupBy("stream_id").agg((F.min("ts") - us(0.5)).alias("t0"))
    at = lambda c: (F.col(c) - F.col("t0")) / float(UNIT)
    s = pulse_spans(spark, sf_dir).join(t0, "stream_id")
    s = s.select("stream_id", F.greatest(F.lit(0.0), at("start")).alias("start"), at("end").alias("end"), at("first").alias("first"), at("last").alias("last"), F.lit(0.9).alias("confidence"))
    own = carriers.table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), micros("ts").alias("ts"), (F.col("value") / 1000.0).alias("energy")).join(t0, "stream_id")
    out = filter_streams(s, p.join(t0, "stream_id").select("stream_id", at("ts").alias("ts")), own.select("stream_id", at("ts").alias("ts"), "energy"))
    return out.select("stream_id", *[F.round(c, 6).alias(f"{c}_at") for c in ("start", "end", "first", "last")])
