"""Mixing sources to target weights (native: DataFrame functions only).

``targets`` gives every source its share of the mix by water-filling in closed form; ``mix`` adds to every document the number of copies
that the mix takes of it: ``floor(rate)`` plus one more with the probability of the rate's fraction.

The extra copy is a hash-seeded Bernoulli draw: a document has one if its draw (30 bits of a hash) lies below its source's bar.  Independent draws
against the bare fraction would leave a source of few or long documents far from its target, so ``bars`` moves the bar to where the words
drawn come nearest to the words wanted: the running sum of words in order of draws, found in three rounds of 10 bits each from sums
for each source and slice of draws.  A source misses its target by half of the words of the draws at the bar at most (one document, or equal draws).

Defined results
* null or blank text: size 0, taken 0; null source: a source of its own, last in order;
* a source of size 0 has target 0; an empty table gives an empty mix;
* repeated rows: equal rows get equal draws (the draw depends on id, source and seed, and on the text where the id is null);
* extra columns of any name are kept as they are by ``emit``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, join_small, quoted

#: A source table of at most so many rows is broadcast; a larger one is joined by shuffle with salted keys.
BROADCAST_SOURCES = 100_000
#: Draws have ROUNDS times SLICE bits.
ROUNDS, SLICE = 3, 10
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from rows ``source, size``.

    Sources in code-point order (null last) have the weights in turn.  They share ``share`` times all sizes; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight.  The sources that are full at
    the water level are those with the smallest room per weight, so one running sum finds the level.
    The windows run over one row for each source, summed before.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("room", F.col("source_size") * F.lit(float(most)))
    by_room = Window.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    # the level if this source and all with more room per weight were not full
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    per = per.withColumn("place", F.row_number().over(by_room))
    per = per.withColumn("open", F.col("room") / F.col("w") > F.col("level"))
    water = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything)
    per = per.withColumn("water", water.getField("level"))
    target = F.when(F.col("water").isNull(), F.col("room")).otherwise(F.least("room", F.col("w") * F.col("water")))
    return per.select("source", "source_size", target.alias("target"))


def draw(seed: int, doc_id: Column, source: Column, text: Column) -> Column:
    """A whole number below 2 ** 30, from the first bits of an MD5; documents without an id draw by text."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))), source)
    return F.shiftrightunsigned(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), 32 - ROUNDS * SLICE)


def bars(sizes: DataFrame, shares: DataFrame, few: bool, stage=lambda df, name: df) -> DataFrame:
    """``source, target, source_size, whole, bar`` (one row for each source) from rows ``source, size, draw`` and the sources' targets.

    Every document has ``whole`` copies, and one more if its draw is below ``bar``.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = shares.withColumn("whole", F.floor(rate)).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    per = per.withColumn("bar", F.lit(0).cast("long"))
    rows, names = sizes.select("source", "draw", "size"), per.columns
    for k in range(ROUNDS):
        shift = SLICE * (ROUNDS - 1 - k)
        inside = join_small(rows, per.select("source", F.col("bar").alias("at")), "source", few, "inner", ("draw",))
        inside = inside.where(F.shiftrightunsigned("draw", shift + SLICE) == F.shiftrightunsigned("at", shift + SLICE))
        cells = inside.groupBy("source", F.shiftrightunsigned("draw", shift).alias("cell")).agg(F.sum("size").alias("words"))
        # at most 2 ** SLICE rows of a source; of equal runs of words the first cell
        cells = cells.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("cell")) - F.col("words"))
        met = join_small(cells, per.select("source", "left"), "source", few, "inner", ("cell",)).where("before <= left and left < before + words")
        met = met.groupBy("source").agg(F.min(F.struct("cell", "before", "words")).alias("x")).select("source", "x.*")
        step = per.join(met.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        if k < ROUNDS - 1:
            bar, left = F.shiftleft("cell", shift), F.col("left") - F.col("before")
        else:  # the draws at the bar are taken if that comes nearer
            bar, left = F.col("cell") + F.when(2 * (F.col("left") - F.col("before")) >= F.col("words"), 1).otherwise(0), F.col("left")
        # a source that wants nothing more has no cell and keeps the bar 0
        per = stage(step.select(*[c for c in names if c not in ("bar", "left")], F.coalesce(left, F.lit(-1.0)).alias("left"), F.coalesce(bar, F.col("bar")).alias("bar")), "mix-bars")
    return per.drop("left")


def _planned(docs: DataFrame, seed: int, stage, weights: dict) -> tuple[DataFrame, DataFrame, bool]:
    """The sizes and draws of all documents, each source's bar, and whether the sources are few."""
    sizes = stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw(seed, F.col("doc_id"), F.col("source"), F.col("text")).alias("draw")), "mix-sizes")
    shares = stage(targets(sizes.select("source", "size"), **weights), "mix-targets")
    few = shares.count() <= BROADCAST_SOURCES
    return sizes, bars(sizes, shares, few, stage), few


def mix(docs: DataFrame, seed: int = 42, stage=lambda df, name: df, **weights) -> DataFrame:
    """One row for each document: ``doc_id, source, size, source_size, target, copies, taken``; ``stage`` keeps small tables between their uses."""
    sizes, per, few = _planned(docs, seed, stage, weights)
    out = join_small(sizes, per, "source", few, "left", ("draw",))
    out = out.withColumn("copies", (F.col("whole") + (F.col("draw") < F.col("bar")).cast("long")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, seed: int = 42, stage=lambda df, name: df, **weights) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    _, per, few = _planned(docs, seed, stage, weights)
    whole, bar, copy = fresh(docs, "mix_whole", "mix_bar", "mix_copy")
    joined = join_small(docs, per.select("source", F.col("whole").alias(whole), F.col("bar").alias(bar)), "source", few, "left", ("doc_id", "text"))
    n = F.col(whole) + (draw(seed, F.col("doc_id"), F.col("source"), F.col("text")) < F.col(bar)).cast("long")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select(*[quoted(c) for c in docs.columns])
