"""The quiet pulse before a span that can be its serve.

A candidate is one as-of lookup (the last pulse far enough before the span's first one); whether it is alone, and calm until the span begins, are differences of running totals of pulses and of motion.
Both ranges of distance are asked at once, as two rows for each span.  Times are microseconds; a stream without an earlier pulse, or a span without a candidate, gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import us
from ..operators.lookup import asof
from ..operators.motion_index import between, running, total
from ..operators.staging import staged
from ..sources.carriers import ctes
from .highlights import _sql_share, activity
from .peels import _SPANS, _inputs, spans_of
from .registry import query
from .segments import BUCKET

# Fixed values (units): the ranges of distance in order of trial, the rest around a candidate, the calm after it.
RANGES = ((us(2.50), us(5.75)), (us(2.16), us(2.50)))
SLACK, AHEAD, BEHIND, SIDE = us(0.05), us(1.20), us(0.08), us(0.12)
HOT_LOW, HOT_HIGH, CALM = us(0.35), us(0.25), 0.42
REST_LOW, REST_HIGH = us(1.5), us(6.0)
LEAST_PULSES, LAST_STEP = 5, us(0.50)


def quiet_serves(rows: DataFrame, p: DataFrame, levels: DataFrame, index: DataFrame) -> DataFrame:
    """``event_id, serve_at`` of the rows (stream_id, court_id, event_id, f, t0) that have a quiet serve before ``f``: a lone pulse without a burst around it and with little motion up to ``f``."""
    tries = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, (lo, hi) in enumerate(RANGES)])).alias("r")
    x = rows.select("stream_id", "court_id", "event_id", "f", "t0", tries).select("stream_id", "court_id", "event_id", "f", "t0", "r.*")
    times = staged(p.select("stream_id", "ts"), "pulse-times")
    x = asof(staged(x.withColumn("ts", F.col("f") - F.col("lo")), "serve-ranges"), times, "stream_id", "ts", [], BUCKET, strict=True, prefix="c_").where(F.col("f") - F.col("c_ts") <= F.col("hi"))
    x = x.withColumn("ts", F.col("c_ts") - SIDE)
    x = asof(staged(x, "serve-candidates"), times, "stream_id", "ts", [], BUCKET, strict=True, prefix="b_")
    x = staged(x.where((F.col("c_ts") - F.col("b_ts")).between(REST_LOW, REST_HIGH)).drop("ts"), "rested-candidates")
    c, keys = F.col("c_ts"), ["event_id", "k"]
    counts = running(times, "stream_id", "ts", {"n": F.lit(1)}, BUCKET)
    sides = {"ahead": (c - AHEAD - SLACK, c - BEHIND + SLACK), "behind": (c + BEHIND - SLACK, F.least(c + AHEAD, F.col("f") - SIDE) + SLACK)}
    lonely = between(x, counts, "stream_id", "ts", keys, sides, BUCKET).where((total("ahead", "n") == 0) & (total("behind", "n") == 0)).select(*keys)
    motion = between(x, index, "court_id", "ts", ["court_id", *keys], {"hot": (F.greatest("t0", c - HOT_LOW), c + HOT_HIGH), "until": (c, F.col("f"))}, BUCKET).join(levels, "court_id")
    three = F.col("hot_1.triple_ends") - F.col("hot_0.triple_starts") > 0
    calm = motion.where((total("hot", "peak") == 0) & ~three & (activity("until") < CALM)).select(*keys)
    return x.join(lonely, keys).join(calm, keys).groupBy("event_id").agg(F.min(F.struct("k", "c_ts"))["c_ts"].alias("serve_at"))


_TRIES = " UNION ALL ".join(f"SELECT *, {k} AS k, (SELECT max(q.ts) FROM pulses q WHERE q.stream_id = sp.stream_id AND q.ts < sp.f - {lo} AND q.ts >= sp.f - {hi}) AS c FROM sp" for k, (lo, hi) in enumerate(RANGES))


def _sql_burst(a: str, b: str) -> str:
    return f"""(SELECT coalesce(bool_or(three OR peak), false) FROM (SELECT e.energy >= lv.peak_at AS peak, e.energy >= lv.run_at AND coalesce(lag(e.energy, 1) OVER w, 0) >= lv.run_at AND coalesce(lag(e.energy, 2) OVER w, 0) >= lv.run_at AS three
      FROM energy e JOIN lv USING (court_id) WHERE e.court_id = x.court_id AND e.ts BETWEEN {a} AND {b} WINDOW w AS (ORDER BY e.ts, e.e5)))"""


@query(
    f"""{ctes('pulses', 'energy')}, {_SPANS}, x0 AS (SELECT * FROM pb WHERE i = n - 1 AND n >= {LEAST_PULSES} AND gap >= {LAST_STEP}), sp AS (SELECT x.stream_id, x.court_id, x.event_id, x.f, x.l, x.t0 FROM x0 x WHERE {_sql_burst('x.f', 'x.l')}),
    ca AS ({_TRIES}), cb AS (SELECT ca.*, (SELECT max(q.ts) FROM pulses q WHERE q.stream_id = ca.stream_id AND q.ts < ca.c - {SIDE}) AS b FROM ca WHERE c IS NOT NULL),
    x AS (SELECT * FROM cb WHERE c - b BETWEEN {REST_LOW} AND {REST_HIGH} AND (SELECT count(*) FROM pulses q WHERE q.stream_id = cb.stream_id AND (q.ts BETWEEN cb.c - {AHEAD + SLACK} AND cb.c - {BEHIND - SLACK} OR q.ts BETWEEN cb.c + {BEHIND - SLACK} AND least(cb.c + {AHEAD}, cb.f - {SIDE}) + {SLACK})) = 0),
    ac AS (SELECT x.event_id, x.k, {_sql_share('true')} AS act FROM x JOIN lv USING (court_id) JOIN energy e ON e.court_id = x.court_id AND e.ts BETWEEN x.c AND x.f GROUP BY 1, 2)
    SELECT stream_id, f AS span_first, l AS last_at, arg_min(c, k) AS serve_at FROM x JOIN ac USING (event_id, k) WHERE act < {CALM} AND NOT {_sql_burst(f'greatest(x.t0, x.c - {HOT_LOW})', f'x.c + {HOT_HIGH}')} GROUP BY stream_id, f, l, event_id"""
)
def quiet_serve_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of five pulses and more with a burst and a slow last step, begun by a quiet serve before them."""
    p, _, levels, index = _inputs(spark, sf_dir)
    shape = (F.col("i") == F.col("n") - 1) & (F.col("n") >= LEAST_PULSES) & (F.col("gap") >= LAST_STEP)
    d = staged(spans_of(p).where(shape).select("stream_id", "court_id", "event_id", "f", "l", "t0"), "spans-to-pull")
    seen = between(d, index, "court_id", "ts", ["event_id"], {"hot": (F.col("f"), F.col("l"))}, BUCKET)
    hot = seen.where((total("hot", "peak") > 0) | (F.col("hot_1.triple_ends") - F.col("hot_0.triple_starts") > 0)).select("event_id")
    d = staged(d.join(hot, "event_id", "left_semi"), "spans-with-burst")
    return d.join(quiet_serves(d, p, levels, index), "event_id").select("stream_id", F.col("f").alias("span_first"), F.col("l").alias("last_at"), "serve_at")
