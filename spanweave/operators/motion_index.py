"""A cumulative index over samples: sums, counts and maxima of any interval without a row for each sample in it.

``running`` gives each distinct time of a key the totals of all samples up to it, first inside buckets of time, then carried over
buckets in a table with one row for each key and bucket.  What an interval [lo, hi] holds is the difference of two as-of lookups (``between``), so the cost of an
interval does not depend on how many samples lie in it.  Conditions become counts of samples that meet them; "three in a row" becomes counts of
where such triples begin and end (``with_triples``).  A maximum within a fixed radius comes from prefix and suffix maxima of blocks as wide as the window, of which any window
touches two (``window_max``).

An as-of lookup reads its left side twice, so what is looked up is written before it; a chain of lookups would else be computed twice as often with each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import asof
from .staging import staged

_ALL_BEFORE = Window.unboundedPreceding


def running(samples: DataFrame, by: str, at: str, measures: dict[str, Column], bucket: int) -> DataFrame:
    """``by, at`` and for each measure (a long) its total over all samples of the key up to and at this time; written once."""
    names = list(measures)
    block = F.floor(F.col(at) / bucket).alias("__b")
    each = samples.select(by, at, block, *[m.cast("long").alias(n) for n, m in measures.items()])
    times = each.groupBy(by, "__b", at).agg(*[F.sum(n).alias(n) for n in names])
    inside = Window.partitionBy(by, "__b").orderBy(at).rowsBetween(_ALL_BEFORE, 0)
    carried = Window.partitionBy(by).orderBy("__b").rowsBetween(_ALL_BEFORE, -1)
    blocks = each.groupBy(by, "__b").agg(*[F.sum(n).alias(n) for n in names])
    before = blocks.select(by, "__b", *[F.coalesce(F.sum(n).over(carried), F.lit(0)).alias(f"__{n}") for n in names])
    here = times.select(by, "__b", at, *[F.sum(n).over(inside).alias(n) for n in names])
    return staged(here.join(before, [by, "__b"]).select(by, at, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in names]), "running-totals")


def between(rows: DataFrame, index: DataFrame, by: str, at: str, keys: list[str], ranges: dict[str, tuple[Column, Column]], bucket: int) -> DataFrame:
    """``keys`` (one row for each) and for each range two structs of totals: ``<name>_0`` before it, ``<name>_1`` up to its end; see ``total``."""
    names = [c for c in index.columns if c not in (by, at)]
    points = [p for lo, hi in ranges.values() for p in (lo - 1, hi)]
    asked = staged(rows.select(*dict.fromkeys([by, *keys]), F.array(*[p.cast("long") for p in points]).alias("__p")), "asked-intervals")
    probes = asked.select(*dict.fromkeys([by, *keys]), F.posexplode("__p").alias("__i", at))
    found = asof(probes, index, by, at, names, bucket, prefix="__at_")
    here = F.struct(*[F.coalesce(F.col(f"__at_{n}"), F.lit(0)).alias(n) for n in names])
    sides = [f"{name}_{side}" for name in ranges for side in (0, 1)]
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, here)).alias(side) for i, side in enumerate(sides)])


def total(name: str, measure: str) -> Column:
    """The measure over the samples of a range; 0 for an empty one."""
    return F.greatest(F.lit(0), F.col(f"{name}_1.{measure}") - F.col(f"{name}_0.{measure}"))


def with_triples(samples: DataFrame, by: str, at: str, tie: str, flag: Column, bucket: int) -> DataFrame:
    """Adds ``triple_ends`` and ``triple_starts``: whether the flag holds at a sample and the two before it (after it), in order of time and ``tie``.

    The samples next to a bucket's edges come from a table with one row for each key and bucket.
    """
    block = F.floor(F.col(at) / bucket)
    s = samples.withColumn("__f", flag.cast("int")).withColumn("__b", block)
    w = Window.partitionBy(by, "__b").orderBy(at, tie)
    s = s.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(by, "__b")))
    edges = s.where("__k <= 2 or __k > __n - 2").groupBy(by, "__b").agg(
        F.array_sort(F.collect_list(F.when(F.col("__k") <= 2, F.struct("__k", "__f")))).alias("__head"),
        F.array_sort(F.collect_list(F.when(F.col("__k") > F.col("__n") - 2, F.struct("__k", "__f")))).alias("__tail"),
    )
    over = Window.partitionBy(by).orderBy("__b")
    flags = lambda c: F.coalesce(F.transform(c, lambda x: x["__f"]), F.array().cast("array<int>"))
    joined = lambda c, *steps: F.concat(*[flags(F.lag(c, k).over(over) if k > 0 else F.lead(c, -k).over(over)) for k in steps])
    edges = edges.select(by, "__b", joined("__tail", 2, 1).alias("__before"), joined("__head", -1, -2).alias("__after"))
    s = s.join(edges, [by, "__b"])
    # the flags of the bucket's neighbours, as far as the bucket's own samples do not reach
    back = lambda k: F.coalesce(F.lag("__f", k).over(w), F.get("__before", F.size("__before") + F.col("__k") - 1 - k), F.lit(0))
    ahead = lambda k: F.coalesce(F.lead("__f", k).over(w), F.get("__after", F.col("__k") + k - F.col("__n") - 1), F.lit(0))
    s = s.withColumn("triple_ends", F.col("__f") * back(1) * back(2)).withColumn("triple_starts", F.col("__f") * ahead(1) * ahead(2))
    return s.drop("__f", "__b", "__k", "__n", "__before", "__after")


def window_max(points: DataFrame, samples: DataFrame, by: str, at: str, value: str, radius: int, bucket: int, name: str) -> DataFrame:
    """Adds to ``points`` the greatest ``value`` of their key's samples within ``radius``; null where there is none."""
    wide = 2 * radius + 1
    block = lambda c: F.floor(c / wide)
    s = samples.groupBy(by, at).agg(F.max(value).alias("__v")).withColumn("__w", block(F.col(at)))
    w = Window.partitionBy(by, "__w")
    upto = F.max("__v").over(w.orderBy(at).rowsBetween(_ALL_BEFORE, 0))
    down = F.max("__v").over(w.orderBy(F.desc(at)).rowsBetween(_ALL_BEFORE, 0))
    index = staged(s.select(by, at, upto.alias("upto"), down.alias("down")), "window-maxima")
    rows = points.withColumn("__own", F.col(at)).withColumn(at, F.col("__own") - radius)
    rows = staged(asof(rows, index, by, at, ["down"], bucket, forward=True, prefix="__f_").withColumn(at, F.col("__own") + radius), "window-points")
    rows = asof(rows, index, by, at, ["upto"], bucket, prefix="__p_").withColumn(at, F.col("__own"))
    first, last = F.col(f"__f_{at}"), F.col(f"__p_{at}")
    # the left block's part from the first sample on, the right block's part up to the last one
    left = F.when(block(first) == block(F.col(at) - radius), F.col("__f_down"))
    right = F.when(block(last) == block(F.col(at) + radius), F.col("__p_upto"))
    one = block(F.col(at) - radius) == block(F.col(at) + radius)  # the window is a block
    return rows.withColumn(name, F.when(one, left).otherwise(F.greatest(left, right))).drop("__own", f"__f_{at}", "__f_down", f"__p_{at}", "__p_upto")


def positions(samples: DataFrame, by: str, at: str, tie: str, measure: str, bucket: int) -> DataFrame:
    """``by, position`` (from 1, in order of time and ``tie``) and the measure's total up to that sample; written once."""
    each = samples.select(by, at, tie, F.col(measure).alias("__m"), F.floor(F.col(at) / bucket).alias("__b"))
    w = Window.partitionBy(by, "__b").orderBy(at, tie).rowsBetween(_ALL_BEFORE, 0)
    carried = Window.partitionBy(by).orderBy("__b").rowsBetween(_ALL_BEFORE, -1)
    blocks = each.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("n"), F.sum("__m").alias("m"))
    before = blocks.select(by, "__b", F.coalesce(F.sum("n").over(carried), F.lit(0)).alias("__n"), F.coalesce(F.sum("m").over(carried), F.lit(0)).alias("__s"))
    here = each.select(by, "__b", F.count(F.lit(1)).over(w).alias("k"), F.sum("__m").over(w).alias("s"))
    return staged(here.join(before, [by, "__b"]).select(by, (F.col("k") + F.col("__n")).alias("position"), (F.col("s") + F.col("__s")).alias("upto")), "positions")


def active_runs(samples: DataFrame, by: str, at: str, tie: str, flag: Column, quiet: int, bucket: int) -> DataFrame:
    """The samples that meet ``flag``, in runs with at most ``quiet`` others in a row between them; written once.

    Columns ``by, at, run_first`` (time of the run's first sample), ``opens`` (whether this is it) and ``ahead_of`` (time of the sample before the run's first).  A walk from a sample to the edge of its run is a lookup of one row.
    """
    s = samples.select(by, at, tie, flag.alias("__f"), F.floor(F.col(at) / bucket).alias("__b"))
    w = Window.partitionBy(by, "__b").orderBy(at, tie)
    s = s.withColumn("__k", F.row_number().over(w)).withColumn("__p", F.lag(at).over(w))
    carried = Window.partitionBy(by).orderBy("__b").rowsBetween(_ALL_BEFORE, -1)
    blocks = s.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("__f"), F.col("__k"))).alias("k"), F.max(at).alias("t"))
    blocks = blocks.withColumn("__n", F.coalesce(F.sum("n").over(carried), F.lit(0)))
    blocks = blocks.select(by, "__b", "__n", F.last(F.col("k") + F.col("__n"), ignorenulls=True).over(carried).alias("__last"), F.last("t").over(carried).alias("__edge"))
    a = s.where("__f").join(blocks, [by, "__b"]).withColumn("__pos", F.col("__k") + F.col("__n"))
    gap = F.col("__pos") - F.coalesce(F.lag("__pos").over(w), "__last")
    a = a.withColumn("opens", F.coalesce(gap > quiet + 1, F.lit(True)))
    own = F.struct(F.col(at).alias("first"), F.coalesce("__p", "__edge").alias("before"))
    a = a.withColumn("__own", F.when(F.col("opens"), own))
    a = staged(a.select(by, at, tie, "__b", "opens", "__own"), "run-starts")
    starts = a.groupBy(by, "__b").agg(F.max("__own").alias("o"))
    starts = starts.select(by, "__b", F.last("o", ignorenulls=True).over(carried).alias("__before"))
    run = F.coalesce(F.last("__own", ignorenulls=True).over(w.rowsBetween(_ALL_BEFORE, 0)), "__before")
    return staged(a.join(starts, [by, "__b"]).withColumn("__run", run).select(by, at, "opens", F.col("__run.first").alias("run_first"), F.col("__run.before").alias("ahead_of")), "active-runs")


def first_at_or_after(rows: DataFrame, when: Column, runs: DataFrame, by: str, at: str, bucket: int, name: str) -> DataFrame:
    """Adds the time of the first sample of ``runs`` at or after ``when``."""
    found = asof(staged(rows.withColumn(at, when), "walks"), runs.select(by, at), by, at, [], bucket, forward=True, prefix="__x_")
    return found.withColumnRenamed(f"__x_{at}", name).drop(at)


def last_at_or_before(rows: DataFrame, when: Column, runs: DataFrame, by: str, at: str, bucket: int, name: str, *more: str) -> DataFrame:
    """Adds the time of the last sample of ``runs`` at or before ``when``, and its columns ``more``."""
    found = asof(staged(rows.withColumn(at, when), "walks"), runs.select(by, at, *more), by, at, list(more), bucket, prefix="__x_")
    for c in more:
        found = found.withColumnRenamed(f"__x_{c}", c)
    return found.withColumnRenamed(f"__x_{at}", name).drop(at)
