"""Sequential folds over the spans or pulses of one stream, as ``aggregate()`` over a sorted array.

These are the operators whose next decision depends on what was decided before (accumulated bounds, refractory
times), which no window can say.  The arrays hold spans or pulses of one island or stream, never raw samples; a caller with streams of unbounded length
first cuts them at gaps that no rule can bridge (``chains``), which bounds each array by the activity between two such gaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chains(df: DataFrame, by: str, lo: str, hi: str, limit: float, name: str = "chain") -> DataFrame:
    """Numbers stretches whose rows come within ``limit`` of what came before; folds never look across them."""
    w = Window.partitionBy(by).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(lo) - reach > limit).cast("int"), F.lit(0))
    return df.withColumn("__n", new).withColumn(name, F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__n")


def fold(df: DataFrame, keys: list[str], item: Column, empty: str, step: Callable[[Column, Column], Column]) -> DataFrame:
    """``keys, out``: ``step(accumulated array, next item)`` over the sorted items of each key."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    return rows.select(*keys, F.aggregate("__items", F.array().cast(empty), step).alias("out"))


def refractory(df: DataFrame, keys: list[str], at: str, rest: int) -> DataFrame:
    """Times kept left to right with at least ``rest`` between two of them."""

    def step(acc: Column, t: Column) -> Column:
        return F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= rest), F.concat(acc, F.array(t))).otherwise(acc)

    return fold(df, keys, F.col(at), "array<bigint>", step).select(*keys, F.explode("out").alias(at))


def tallest_first(df: DataFrame, keys: list[str], at: str, height: str, rest: int) -> DataFrame:
    """Peaks kept from the tallest down (ties: the later first), each at least ``rest`` away from all kept before."""
    item = F.struct((-F.col(height)).alias("h"), (-F.col(at)).alias("t"))
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__items"))

    def step(acc: Column, x: Column) -> Column:
        t = -x.t
        return F.when(F.exists(acc, lambda k: F.abs(k - t) < rest), acc).otherwise(F.concat(acc, F.array(t)))

    return rows.select(*keys, F.explode(F.aggregate("__items", F.array().cast("array<bigint>"), step)).alias(at))


SPAN = "array<struct<s:bigint,e:bigint,first:bigint,last:bigint,conf:double,n:int>>"


def _replace_last(acc: Column, x: Column) -> Column:
    return F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(x))


def capped_merge(df: DataFrame, keys: list[str], near: int, near_hit: int, hit: int, most: int, veto: int, bridged: int | None = None) -> DataFrame:
    """Joins a span to the one before if they are linked and the joint length stays in bounds.

    Linked: (gap <= near and hit gap <= near_hit) or hit gap <= hit, or (with ``bridged``) hit gap <= bridged and the row's ``bridged`` holds.
    Vetoed: joint length > most and hit gap > veto.  Rows need ``start, end, first, last, conf``; pulses of later spans come later.
    """
    item = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("first"), F.col("last"), F.col("conf"), F.lit(1).alias("n"), (F.col("bridged") if bridged else F.lit(False)).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        p = F.element_at(acc, -1)
        gap, hits = x.s - p.e, x["first"] - p["last"]
        linked = ((gap <= near) & (hits <= near_hit)) | (hits <= hit)
        if bridged:
            linked = linked | ((hits <= bridged) & x.b)
        veto_it = (F.greatest(p.e, x.e) - p.s > most) & (hits > veto)
        joint = F.struct(p.s.alias("s"), F.greatest(p.e, x.e).alias("e"), p["first"].alias("first"), F.greatest(p["last"], x["last"]).alias("last"), F.least(p.conf, x.conf).alias("conf"), (p.n + 1).alias("n"))
        new = _span_of(x)
        return F.when(F.size(acc) == 0, F.array(new)).when(linked & ~veto_it, _replace_last(acc, joint)).otherwise(F.concat(acc, F.array(new)))

    return fold(df, keys, item, SPAN, step)


def _span_of(x: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in ("s", "e", "first", "last", "conf", "n")])


def device_merge(df: DataFrame, keys: list[str], most: int, near: int, near_hit: int, hit: int, far_hit: int, far: int) -> DataFrame:
    """Like ``capped_merge`` with other links: never beyond ``most``; (gap <= near and hit gap <= near_hit), hit gap <= hit, or (hit gap <= far_hit, gap <= far and the row's ``lively``)."""
    item = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("first"), F.col("last"), F.col("conf"), F.lit(1).alias("n"), F.col("lively").alias("b"))

    def step(acc: Column, x: Column) -> Column:
        p = F.element_at(acc, -1)
        gap, hits = x.s - p.e, x["first"] - p["last"]
        linked = ((gap <= near) & (hits <= near_hit)) | (hits <= hit) | ((hits <= far_hit) & (gap <= far) & x.b)
        joint = F.struct(p.s.alias("s"), F.greatest(p.e, x.e).alias("e"), p["first"].alias("first"), F.greatest(p["last"], x["last"]).alias("last"), F.least(p.conf, x.conf).alias("conf"), (p.n + 1).alias("n"))
        new = _span_of(x)
        return F.when(F.size(acc) == 0, F.array(new)).when((x.e - p.s <= most) & linked, _replace_last(acc, joint)).otherwise(F.concat(acc, F.array(new)))

    return fold(df, keys, item, SPAN, step)


def dedupe_overlaps(df: DataFrame, keys: list[str], slack: int) -> DataFrame:
    """Of two spans that overlap (start within ``slack`` of the kept end) the one with the longer pulse span stays; its end counts next."""
    item = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("first"), F.col("last"), F.col("conf"), F.lit(1).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        p = F.element_at(acc, -1)
        longer = (x["last"] - x["first"]) > (p["last"] - p["first"])
        return (
            F.when(F.size(acc) == 0, F.array(x))
            .when(x.s <= p.e + slack, F.when(longer, _replace_last(acc, x)).otherwise(acc))
            .otherwise(F.concat(acc, F.array(x)))
        )

    return fold(df, keys, item, SPAN, step)


def expand(df: DataFrame, keys: list[str], back: int, ahead: int, least_gap: int) -> DataFrame:
    """Widens spans by ``back`` and ``ahead`` but keeps ``least_gap`` to the already widened span before and to the next start."""
    nxt = F.lead("start").over(Window.partitionBy(*keys).orderBy("start", "end"))
    rows = df.withColumn("__next", nxt)
    item = F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.col("first"), F.col("last"), F.col("conf"), F.lit(1).alias("n"), F.col("__next").alias("nx"))
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__items"))

    def step(acc: Column, x: Column) -> Column:
        p = F.element_at(acc, -1)
        floor = F.when(F.size(acc) == 0, F.lit(0).cast("bigint")).otherwise(p.e + least_gap)
        start = F.least(x.s, F.greatest(floor, x.s - back))
        end = F.greatest(x.e, F.least(x.e + ahead, F.coalesce(x.nx - least_gap, x.e + ahead)))
        y = F.struct(start.alias("s"), end.alias("e"), x["first"].alias("first"), x["last"].alias("last"), x.conf.alias("conf"), x.n.alias("n"))
        return F.concat(acc, F.array(y))

    return grouped.select(*keys, F.aggregate("__items", F.array().cast(SPAN), step).alias("out"))


def spans_of(folded: DataFrame, *keys: str) -> DataFrame:
    x = folded.select(*keys, F.explode("out").alias("x"))
    return x.select(*keys, F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.first").alias("first"), F.col("x.last").alias("last"), F.col("x.conf").alias("conf"), F.col("x.n").alias("n"))
