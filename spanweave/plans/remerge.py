"""Merging again: a fold over the spans of a stream whose state carries its place in the running totals of pulses and motion.

A span is joined to the one before by a closed list of branches, each with its own bounds on the hole between them, the joint length, the pulses on both sides and the share of active samples in the
hole.  What was joined so far decides (its last pulse, its pulses in all, its length), so this is a fold.  Every number that a branch asks for is a difference of two totals: the state keeps
those at its first and its last pulse, an item brings those at its own, and no sample is read in the fold.  Holes beyond ``FARTHEST`` are bridged by no branch and cut the chains.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.units import us
from ..operators import rules
from ..operators.islands import with_island
from ..operators.lookup import asof, small_side
from ..operators.motion_index import between, running
from ..operators.staging import staged
from ..sources import carriers
from ..sources.carriers import ctes
from .highlights import _LEVELS, LAND_PAD, SERVE_PAD, motion_index, motion_levels
from .registry import query
from .segments import BUCKET, _sql_islands

# Fixed values of the branches (units): silence and bridge, the nearness that lets motion decide, the longest span.
SILENCE, BRIDGE, NEAR, MOST = us(1.85), us(4.2), us(1.15), us(22.0)
FARTHEST = us(5.6)
SLACK, SIDE = us(0.05), us(0.12)
_FAR = us(99.0)
#: Spans in this query are islands of pulses at most so far apart.
ISLAND = us(0.8)

_WALK_IN = rules.WALK_IN
for _name, _to in (("start_at", "v.start_at"), ("first_at", "v.first_at"), ("last_at", "v.last_at"), ("d <=", "v.d <="), ("n >=", "v.na >=")):
    _WALK_IN = _WALK_IN.replace(_name, _to)
_VETO = f"(v.na >= 4 AND v.wide >= {us(4)} AND v.hole >= {us(1.5)} AND v.act >= 0.48 OR v.joint > {MOST + us(2)})"
_BY_MOTION = f"(v.gap <= {NEAR} AND v.hole <= {BRIDGE})"
_LIVE = f"(v.hole <= {SILENCE} OR v.act >= CASE WHEN v.hole <= {us(2.8)} THEN 0.55 ELSE 0.50 END)"
_LONE = f"(v.na = 1 AND v.iso >= {us(3.30)} AND v.iso < {us(5)} AND v.nx >= {us(3.60)})"
#: Which branch takes the item ``b`` after the span ``a``, of both engines; ``v`` has what is asked about the two.
BRANCH = f"""CASE
  WHEN v.gap < 0 AND v.hole >= {-us(0.05)} AND v.hole <= {us(0.20)} AND v.na >= 3 AND v.nb >= 4 AND NOT v.a_burst AND v.b_burst THEN 'M0'
  WHEN NOT {_VETO} AND {_BY_MOTION} AND ({_LIVE} OR v.gap <= {us(0.45)} AND v.hole <= {us(1.8)} AND v.act < 0.62) THEN 'M2'
  WHEN NOT {_VETO} AND {_BY_MOTION} AND v.gap <= {us(0.60)} AND v.hole > {SILENCE} AND v.hole <= {us(2.2)} AND v.act < 0.62 AND v.joint <= {us(12)} AND v.na >= 2 AND v.nb >= 3 AND NOT {_WALK_IN} THEN 'M3'
  WHEN NOT {_VETO} AND NOT {_BY_MOTION} AND v.hole <= {SILENCE} THEN 'M4'
  WHEN NOT {_VETO} AND NOT {_BY_MOTION} AND v.hole <= {us(4.8)} AND v.joint <= {MOST} AND v.nb <= 2 AND v.na >= 2 AND v.act < 0.45 AND NOT (v.nb = 1 AND v.hole >= {us(3.2)}) THEN 'M5'
  WHEN NOT {_VETO} AND NOT {_BY_MOTION} AND v.hole > {us(3.2)} AND v.hole <= {us(5.2)} AND v.joint <= {us(8.5)} AND v.na <= 2 AND v.nb <= 2 AND v.act < 0.90 AND NOT {_LONE} THEN 'M6'
  WHEN NOT {_VETO} AND NOT {_BY_MOTION} AND v.hole > {us(2.8)} AND v.hole <= {us(5.3)} AND v.joint <= {MOST} AND v.na <= 2 AND v.nb >= 3 AND v.act < 0.42 THEN 'M7'
  WHEN NOT {_VETO} AND NOT {_BY_MOTION} AND v.hole <= {us(2.2)} AND v.joint <= {us(12)} AND v.na >= 2 AND v.nb >= 3 AND v.act < 0.55 THEN 'M8'
  WHEN v.hole > {us(5.0)} AND v.hole <= {FARTHEST} AND v.na BETWEEN 2 AND 5 AND v.nb >= 4 AND v.act < 0.40 THEN 'M9'
  WHEN {_VETO} AND v.hole <= {FARTHEST} THEN 'M1' ELSE 'apart' END"""
JOINING = "('M2', 'M3', 'M4', 'M5', 'M6', 'M7', 'M8')"

_TOTALS = "struct<n:bigint,e5:bigint,active:bigint,peak:bigint,court:bigint,triple_ends:bigint,triple_starts:bigint>"
#: ``fE`` totals before the first pulse, ``lB`` and ``lE`` before and up to the last one, ``fP`` and ``lP`` pulses before and up to them, ``iso`` and ``nx`` the distances to the next pulses outside.
_STATE = f"struct<s:bigint,e:bigint,f:bigint,l:bigint,conf:double,n:int,how:string,fE:{_TOTALS},fP:bigint,iso:bigint,lB:{_TOTALS},lE:{_TOTALS},lP:bigint,nx:bigint>"


def items(spans: DataFrame, p: DataFrame, e: DataFrame) -> DataFrame:
    """Rows ``stream_id, court_id, s, e, f, l, conf`` with all that the fold asks of a span by itself, looked up in running totals."""
    lv = small_side(motion_levels(e), "court-levels")  # a row for each court
    motion = motion_index(e, lv)
    own = p.select("stream_id", "ts")
    counts = running(own, "stream_id", "ts", {"n": F.lit(1)}, BUCKET)
    keys = ["stream_id", "s", "e", "f", "l"]

    def nearest(rows: DataFrame, when, forward: bool, name: str) -> DataFrame:
        found = asof(staged(rows.withColumn("ts", when), "span-items"), own, "stream_id", "ts", [], BUCKET, forward=forward, prefix="x_")
        return found.withColumnRenamed("x_ts", name).drop("ts")

    x = nearest(spans, F.col("f") + SILENCE + 1, True, "r0")  # where a landing's leftover begins
    x = x.withColumn("r0", F.coalesce("r0", F.col("l")))
    for name, at in (("f", "f"), ("r", "r0")):
        x = nearest(x, F.col(at) - SIDE - 1, False, f"{name}_before")
    for name in ("f", "l"):
        x = nearest(x, F.col(name) + SIDE + 1, True, f"{name}_after")
    x = staged(x, "span-items")
    here = between(x, motion, "court_id", "ts", keys, {k: (F.col(c), F.col(c)) for k, c in (("first", "f"), ("last", "l"), ("rest", "r0"))}, BUCKET)
    near = between(x, counts, "stream_id", "ts", keys, {"pf": (F.col("f") - SLACK, F.col("f") + SLACK), "pl": (F.col("l") - SLACK, F.col("l") + SLACK), "pr": (F.col("r0") - SLACK, F.col("f") + SILENCE)}, BUCKET)
    x = x.join(here, keys).join(near, keys).join(lv.select("court_id", "flat", "base"), "court_id")
    distance = lambda a, b: F.coalesce(a - b, F.lit(_FAR))
    return x.select(
        "stream_id", "s", "e", "f", "l", "conf", "flat", "base", "r0", F.col("f_before").alias("pb"),
        F.col("first_0").alias("fE"), F.col("first_1").alias("fU"), F.col("last_0").alias("lB"), F.col("last_1").alias("lE"), F.col("rest_0").alias("rE"),
        F.col("pf_0.n").alias("fP"), F.col("pf_1.n").alias("fQ"), F.col("pl_1.n").alias("lP"), F.col("pr_0.n").alias("rP"), (F.col("pl_1.n") - F.col("pr_1.n")).alias("n_rest"),
        distance(F.col("f"), F.col("f_before")).alias("iso"), distance(F.col("r0"), F.col("r_before")).alias("r_iso"), distance(F.col("l_after"), F.col("l")).alias("nx"), distance(F.col("f_after"), F.col("f")).alias("f_nx"),
    )


def _burst(before: str, upto: str) -> str:
    return f"({upto}.peak > {before}.peak OR {upto}.triple_ends > {before}.triple_starts)"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _fold() -> str:
    """The fold as an expression over ``items`` (arrays sorted by start)."""
    unit = f"{us(1)}.0D"
    n = "(b.fU.n - a.lB.n)"
    act = f"CASE WHEN {n} <= 0 THEN 0.0D WHEN b.flat AND b.base >= 0.012 AND (b.fU.e5 - a.lB.e5) / ({n} * 100000.0D) >= 0.85 * b.base THEN 1.0D ELSE (b.fU.active - a.lB.active) / CAST({n} AS DOUBLE) END"
    pair = _struct(
        gap="b.s - a.e", hole="b.f - a.l", joint="b.e - a.s", wide="a.l - a.f", na="a.lP - a.fP", nb="b.lP - b.fP", act=f"round({act}, 9)", a_burst=_burst("a.fE", "a.lE"), b_burst=_burst("b.fE", "b.lE"), iso="a.iso", nx="a.nx",
        start_at=f"(a.s - t0) / {unit}", first_at=f"(a.f - t0) / {unit}", last_at=f"(a.l - t0) / {unit}", d=f"(a.e - a.s) / {unit}",
    )
    first = {"s": "b.s", "f": "b.f", "fE": "b.fE", "fP": "b.fP", "iso": "b.iso"}
    state = lambda **f: _struct(**{k: f[k] for k in ("s", "e", "f", "l", "conf", "n", "how", "fE", "fP", "iso", "lB", "lE", "lP", "nx")})
    old = {k: f"a.{k}" for k in ("s", "e", "f", "l", "conf", "n", "how", "fE", "fP", "iso", "lB", "lE", "lP", "nx")}
    new = {**first, "e": "b.e", "l": "b.l", "conf": "b.conf", "n": "1", "how": "m", "lB": "b.lB", "lE": "b.lE", "lP": "b.lP", "nx": "b.nx"}
    later = {k: f"CASE WHEN b.l > a.l THEN b.{k} ELSE a.{k} END" for k in ("lB", "lE", "lP", "nx")}
    joined = {**old, "e": "greatest(a.e, b.e)", "l": "greatest(a.l, b.l)", "conf": "least(a.conf, b.conf)", "n": "a.n + 1", "how": "concat(a.how, ',', m)", **later}
    shrunk = {**old, "l": "b.pb", "e": f"least(a.e, b.s - {us(0.35)}, b.pb + {us(LAND_PAD)})"}
    landed = {**old, "l": "b.f", "e": f"b.f + {us(LAND_PAD)}", "how": "concat(a.how, ',M9')", "lB": "b.fE", "lE": "b.fU", "lP": "b.fQ", "nx": "b.f_nx"}
    rest = {**new, "s": f"b.r0 - {us(SERVE_PAD)}", "f": "b.r0", "e": f"b.l + {us(LAND_PAD)}", "fE": "b.rE", "fP": "b.rP", "iso": "b.r_iso", "how": "'rest'"}
    shrinks = f"b.pb >= a.f - {SLACK} AND b.s - {us(0.35)} > a.s + {us(0.5)}"
    but = "slice(acc, 1, size(acc) - 1)"
    chosen = f"""CASE WHEN m IN {JOINING} THEN concat({but}, array({state(**joined)}))
      WHEN m = 'M0' AND {shrinks} THEN concat({but}, array({state(**shrunk)}, {state(**new)}))
      WHEN m = 'M9' AND b.n_rest >= 2 THEN concat({but}, array({state(**landed)}, {state(**rest)}))
      WHEN m = 'M9' THEN concat({but}, array({state(**landed)})) ELSE concat(acc, array({state(**new)})) END"""
    # one-element arrays give names to what is used several times
    step = f"transform(transform(array(element_at(acc, -1)), a -> {_struct(a='a', v=pair)}), x -> transform(transform(array({_struct(a='x.a', v='x.v')}), y -> {_struct(a='y.a', m=_branch('y.v'))}), z -> {_with(chosen)})[0])[0]"
    begun = state(**(new | {"how": "'apart'"}))
    return f"aggregate(items, CAST(array() AS array<{_STATE}>), (acc, b) -> CASE WHEN size(acc) = 0 THEN array({begun}) ELSE {step} END)"


def _branch(v: str) -> str:
    return BRANCH.replace("v.", f"{v}.")


def _with(text: str) -> str:
    """The choice over ``z.a`` and ``z.m``."""
    return re.sub(r"\bm\b(?!\w)", "z.m", re.sub(r"\ba\.", "z.a.", text))


def remerge(rows: DataFrame) -> DataFrame:
    """``stream_id, s, e, f, l, conf, n, how`` of rows made by ``items``: spans merged again; ``how`` tells the branches by which items came in.

    Rows need ``t0``, the begin of their stream's time.
    """
    w = Window.partitionBy("stream_id").orderBy("s", "e", "f", "l")
    reach = F.max("l").over(w.rowsBetween(Window.unboundedPreceding, -1))
    chained = with_island(rows.withColumn("__far", F.col("f") - reach > FARTHEST), ["stream_id"], "s", breaks=F.col("__far"), name="chain")
    names = [c for c in rows.columns if c not in ("stream_id", "t0")]
    order = ["s", "e", "f", "l", *(c for c in names if c not in ("s", "e", "f", "l"))]
    sets = chained.groupBy("stream_id", "t0", "chain").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("items"))
    out = sets.select("stream_id", F.explode(F.expr(_fold())).alias("x"))
    return out.select("stream_id", *[f"x.{c}" for c in ("s", "e", "f", "l", "conf", "n", "how")])


_AT = "(SELECT count(*) FROM energy3 q WHERE q.court_id = i.court_id AND q.ts {op} i.{c} AND {cond})"
_PULSES = "(SELECT count(*) FROM pulses q WHERE q.stream_id = i.stream_id AND q.ts {op})"


def _sql_items() -> str:
    hot = "energy >= run_at"
    count = lambda op, c, cond: _AT.format(op=op, c=c, cond=cond)
    pulses = lambda op: _PULSES.format(op=op)
    return f"""{_LEVELS}, {_sql_islands('pulses', 'stream_id', ISLAND, extra=', event_id')}, t0s AS (SELECT stream_id, min(ts) - {us(0.5)} AS t0 FROM pulses GROUP BY 1),
    energy3 AS (SELECT court_id, ts, e5, energy >= active_at AS act, energy >= peak_at AS peak, {hot} AND coalesce(lag({hot}, 1) OVER w, false) AND coalesce(lag({hot}, 2) OVER w, false) AS te, {hot} AND coalesce(lead({hot}, 1) OVER w, false) AND coalesce(lead({hot}, 2) OVER w, false) AS tb
      FROM energy JOIN lv USING (court_id) WINDOW w AS (PARTITION BY court_id ORDER BY ts, e5)),
    i0 AS (SELECT stream_id, any_value(court_id) AS court_id, min(ts) - {us(SERVE_PAD)} AS s, max(ts) + {us(LAND_PAD)} AS e, min(ts) AS f, max(ts) AS l, 0.5 + (island % 50) / 100.0 AS conf FROM isl GROUP BY stream_id, island),
    i AS (SELECT i0.*, coalesce((SELECT min(q.ts) FROM pulses q WHERE q.stream_id = i0.stream_id AND q.ts > i0.f + {SILENCE}), i0.l) AS r0 FROM i0),
    it AS (SELECT i.stream_id, i.court_id, i.s, i.e, i.f, i.l, i.conf, i.r0, row_number() OVER (PARTITION BY i.stream_id ORDER BY i.s, i.e, i.f, i.l) AS k,
      {count('<', 'f', 'peak')} AS f_peak, {count('<=', 'l', 'peak')} AS l_peak, {count('<', 'f', 'tb')} AS f_tb, {count('<=', 'l', 'te')} AS l_te, {count('<', 'r0', 'peak')} AS r_peak, {count('<', 'r0', 'tb')} AS r_tb, {count('<=', 'f', 'peak')} AS fu_peak, {count('<=', 'f', 'te')} AS fu_te,
      {pulses(f'< i.f - {SLACK}')} AS fp, {pulses(f'<= i.f + {SLACK}')} AS fq, {pulses(f'<= i.l + {SLACK}')} AS lp, {pulses(f'< i.r0 - {SLACK}')} AS rp, {pulses(f'<= i.f + {SILENCE}')} AS rq,
      (SELECT max(q.ts) FROM pulses q WHERE q.stream_id = i.stream_id AND q.ts < i.f - {SIDE}) AS pb, coalesce(i.f - (SELECT max(q.ts) FROM pulses q WHERE q.stream_id = i.stream_id AND q.ts < i.f - {SIDE}), {_FAR}) AS iso, coalesce(i.r0 - (SELECT max(q.ts) FROM pulses q WHERE q.stream_id = i.stream_id AND q.ts < i.r0 - {SIDE}), {_FAR}) AS r_iso,
      coalesce((SELECT min(q.ts) FROM pulses q WHERE q.stream_id = i.stream_id AND q.ts > i.l + {SIDE}) - i.l, {_FAR}) AS nx, coalesce((SELECT min(q.ts) FROM pulses q WHERE q.stream_id = i.stream_id AND q.ts > i.f + {SIDE}) - i.f, {_FAR}) AS f_nx FROM i),
    pt AS (SELECT DISTINCT stream_id, court_id, t FROM (SELECT stream_id, court_id, f AS t FROM it UNION ALL SELECT stream_id, court_id, l FROM it)),
    pa AS (SELECT p.stream_id, p.t AS t0, j.f AS t1, sum(CASE WHEN act THEN 1 ELSE 0 END) AS hits, count(*) AS n, sum(e5) AS e5, any_value(p.court_id) AS court_id FROM pt p JOIN (SELECT DISTINCT stream_id, f FROM it) j ON j.stream_id = p.stream_id AND j.f - p.t BETWEEN 0 AND {FARTHEST} JOIN energy3 q ON q.court_id = p.court_id AND q.ts BETWEEN p.t AND j.f GROUP BY 1, 2, 3),
    ac AS (SELECT stream_id, pa.t0, t1, round(CASE WHEN flat AND base >= 0.012 AND e5 / (n * 100000.0) >= 0.85 * base THEN 1.0 ELSE hits / CAST(n AS DOUBLE) END, 9) AS act FROM pa JOIN lv USING (court_id))"""


def _sql_fold() -> str:
    """One item a step; a step that changes the span before and opens another gives two rows, of which the later goes on."""
    unit = f"{us(1)}.0"
    pair = f"""SELECT r.*, b.k AS bk, b.s AS bs, b.e AS be, b.f AS bf, b.l AS bl, b.conf AS bconf, b.pb, b.r0, b.lp - b.rq AS n_rest, b.f_peak, b.f_tb, b.l_peak, b.l_te, b.r_peak, b.r_tb, b.fu_peak, b.fu_te, b.fp AS bfp, b.fq, b.lp AS blp, b.rp, b.iso AS biso, b.r_iso, b.nx AS bnx, b.f_nx,
      struct_pack(gap := b.s - r.e, hole := b.f - r.l, joint := b.e - r.s, wide := r.l - r.f, na := r.lp - r.fp, nb := b.lp - b.fp, act := coalesce(ac.act, 0.0), a_burst := r.lpeak > r.fpeak OR r.lte > r.ftb, b_burst := b.l_peak > b.f_peak OR b.l_te > b.f_tb, iso := r.iso, nx := r.nx,
        start_at := (r.s - t.t0) / {unit}, first_at := (r.f - t.t0) / {unit}, last_at := (r.l - t.t0) / {unit}, d := (r.e - r.s) / {unit}) AS v
      FROM (SELECT * FROM rm WHERE open) r JOIN it b ON b.stream_id = r.stream_id AND b.k = r.k + 1 JOIN t0s t ON t.stream_id = r.stream_id LEFT JOIN ac ON ac.stream_id = r.stream_id AND ac.t0 = r.l AND ac.t1 = b.f"""
    names = "stream_id, k, grp, open, s, e, f, l, conf, n, how, fpeak, ftb, fp, iso, lpeak, lte, lp, nx"
    kept = lambda cond, e="e", last="l", how="how", more="fpeak, ftb, fp, iso, lpeak, lte, lp, nx", opened="false": f"SELECT stream_id, bk, grp, {opened}, s, {e}, f, {last}, conf, n, {how}, {more} FROM q WHERE {cond}"
    fresh = lambda cond, how: f"SELECT stream_id, bk, grp + 1, true, bs, be, bf, bl, bconf, 1, {how}, f_peak, f_tb, bfp, biso, l_peak, l_te, blp, bnx FROM q WHERE {cond}"
    shrinks = f"(m = 'M0' AND pb >= f - {SLACK} AND bs - {us(0.35)} > s + {us(0.5)})"
    landed = "fpeak, ftb, fp, iso, fu_peak, fu_te, fq, f_nx"
    later = "fpeak, ftb, fp, iso, CASE WHEN bl > l THEN l_peak ELSE lpeak END, CASE WHEN bl > l THEN l_te ELSE lte END, CASE WHEN bl > l THEN blp ELSE lp END, CASE WHEN bl > l THEN bnx ELSE nx END"
    steps = " UNION ALL ".join((
        f"SELECT stream_id, bk, grp, true, s, greatest(e, be), f, greatest(l, bl), least(conf, bconf), n + 1, how || ',' || m, {later} FROM q WHERE m IN {JOINING}",
        kept(f"m NOT IN {JOINING} AND m <> 'M9' AND NOT {shrinks}"), kept(shrinks, e=f"least(e, bs - {us(0.35)}, pb + {us(LAND_PAD)})", last="pb"), fresh(f"m NOT IN {JOINING} AND m <> 'M9'", "m"),
        kept("m = 'M9'", e=f"bf + {us(LAND_PAD)}", last="bf", how="how || ',M9'", more=landed, opened="n_rest < 2"),
        f"SELECT stream_id, bk, grp + 1, true, r0 - {us(SERVE_PAD)}, bl + {us(LAND_PAD)}, r0, bl, bconf, 1, 'rest', r_peak, r_tb, rp, r_iso, l_peak, l_te, blp, bnx FROM q WHERE m = 'M9' AND n_rest >= 2",
    ))
    return f"""rm AS (SELECT stream_id, k, 1 AS grp, true AS open, s, e, f, l, conf, 1 AS n, 'apart' AS how, f_peak AS fpeak, f_tb AS ftb, fp, iso, l_peak AS lpeak, l_te AS lte, lp, nx FROM it WHERE k = 1
      UNION ALL (WITH q AS (SELECT *, {BRANCH} AS m FROM ({pair})) {steps})),
    ro AS (SELECT {names}, row_number() OVER (PARTITION BY stream_id, grp ORDER BY k DESC, open) AS last_of FROM rm)"""


@query(
    f"""{ctes('pulses', 'energy').replace('WITH', 'WITH RECURSIVE', 1)}, {_sql_items()}, {_sql_fold()}
    SELECT stream_id, s AS start_at, e AS end_at, f AS first_ts, l AS last_ts, round(conf, 6) AS conf, n, how FROM ro WHERE last_of = 1"""
)
def remerged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of pulses merged again by the branches, each by its name."""
    p, e = carriers.pulses(spark, sf_dir), carriers.energy(spark, sf_dir)
    t0 = p.groupBy("stream_id").agg((F.min("ts") - us(0.5)).alias("t0"))
    g = with_island(p, ["stream_id"], "ts", ISLAND, tie="event_id").groupBy("stream_id", "island").agg(F.first("court_id").alias("court_id"), F.min("ts").alias("f"), F.max("ts").alias("l"))
    s = g.select("stream_id", "court_id", (F.col("f") - us(SERVE_PAD)).alias("s"), (F.col("l") + us(LAND_PAD)).alias("e"), "f", "l", (0.5 + (F.col("island") % 50) / 100.0).alias("conf"))
    out = remerge(items(s, p, e).join(t0, "stream_id"))
    return out.select("stream_id", F.col("s").alias("start_at"), F.col("e").alias("end_at"), F.col("f").alias("first_ts"), F.col("l").alias("last_ts"), F.round("conf", 6).alias("conf"), "n", "how")
