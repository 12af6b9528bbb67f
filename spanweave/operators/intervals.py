"""Interval algebra on rows ``stream_id, start, end`` (any number type): merge, pad, clamp, complement, offsets, split, match.

All are window queries over one stream key, so a chain of them keeps one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "stream_id"


def merge(spans: DataFrame, gap: float = 0, confidence: str | None = None, keep: str = "min", tie: str | None = None) -> DataFrame:
    """Spans whose start is within ``gap`` of the greatest end before them become one: ``stream_id, start, end, n [, confidence]``.

    The running maximum of ends says where a group begins, so nested spans are handled; no row order is assumed.
    """
    w = Window.partitionBy(KEY).orderBy("start", "end", *([tie] if tie else []))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.coalesce((F.col("start") - reach > gap).cast("int"), F.lit(0)))
    marked = marked.withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    aggs = [F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")]
    if confidence:
        aggs.append((F.min if keep == "min" else F.max)(confidence).alias(confidence))
    return marked.groupBy(KEY, "__group").agg(*aggs).drop("__group")


def pad(spans: DataFrame, before: float, after: float, duration: Column | None = None) -> DataFrame:
    """Widens spans and clamps them to [0, duration] (no clamp at the end where it is null or not positive); empty ones go."""
    end = F.col("end") + after
    if duration is not None:
        end = F.when(duration > 0, F.least(end, duration)).otherwise(end)
    return spans.withColumn("start", F.greatest(F.lit(0), F.col("start") - before)).withColumn("end", end).where("end > start")


def clamp_keep(spans: DataFrame, duration: Column, least: float) -> DataFrame:
    """Moves bounds into [0, duration] with a least length of ``min(least, duration)``; without a duration both are 0."""
    short = F.least(F.lit(least), duration)
    start = F.greatest(F.lit(0), F.least(F.col("start"), duration - short))
    out = spans.withColumn("__s", F.when(duration > 0, start).otherwise(F.lit(0)))
    end = F.greatest(F.col("__s") + short, F.least(F.col("end"), duration))
    return out.withColumn("end", F.when(duration > 0, end).otherwise(F.lit(0))).withColumn("start", F.col("__s")).drop("__s")


def clamp_adjacent(spans: DataFrame, least_gap: float, last: str | None = None) -> DataFrame:
    """An end that comes nearer than ``least_gap`` to the next start moves back, not before ``last`` (the last pulse)."""
    nxt = F.lead("start").over(Window.partitionBy(KEY).orderBy("start", "end"))
    spans = spans.withColumn("__limit", nxt - least_gap)
    moved = F.greatest(F.col(last), F.col("__limit")) if last else F.col("__limit")
    touch = (F.col("end") > F.col("__limit")) & (F.col("__limit") > F.col("start"))
    return spans.withColumn("end", F.when(touch, moved).otherwise(F.col("end"))).drop("__limit")


def dead_time(merged: DataFrame, least: float = 0) -> DataFrame:
    """The gaps longer than ``least`` between merged spans."""
    w = Window.partitionBy(KEY).orderBy("start")
    out = merged.select(KEY, F.lag("end").over(w).alias("gap_start"), F.col("start").alias("gap_end"))
    return out.where(F.col("gap_end") - F.col("gap_start") > least)


def edit_list(merged: DataFrame) -> DataFrame:
    """Where each span goes in the output: number, length and running offset."""
    w = Window.partitionBy(KEY).orderBy("start", "end")
    out = merged.withColumn("number", F.row_number().over(w)).withColumn("length", F.col("end") - F.col("start"))
    return out.withColumn("offset", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))


def split_long(spans: DataFrame, most: int, margin: int) -> DataFrame:
    """Spans longer than ``most`` are cut in the middle, if both halves stay longer than ``margin``."""
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    cut = (F.col("end") - F.col("start") > most) & (mid > F.col("start") + margin) & (mid < F.col("end") - margin)
    whole = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e"), F.lit(1).alias("part")))
    halves = F.array(F.struct(F.col("start").alias("s"), mid.alias("e"), F.lit(1).alias("part")), F.struct(mid.alias("s"), F.col("end").alias("e"), F.lit(2).alias("part")))
    rest = [c for c in spans.columns if c not in ("start", "end")]
    out = spans.select(*rest, F.explode(F.when(cut, halves).otherwise(whole)).alias("x"))
    return out.select(*rest, F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.part").alias("part"))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    union = (a1 - a0) + (b1 - b0) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
