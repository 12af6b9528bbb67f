"""As-of and band lookups between two ordered tables.

Both deal rows by key and a bucket of time, so that one key with a great part of the rows is spread over its buckets; the
as-of lookup carries the nearest sample across buckets in a table with one row for each key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: list[str], bucket: int, forward: bool = False, strict: bool = False, prefix: str = "r_") -> DataFrame:
    """Adds of the nearest ``right`` row at or before ``left.at`` (after, if ``forward``; not at it, if ``strict``) its ``at`` and ``value`` columns.

    Columns come with ``prefix`` and are null where there is none.  Rows of ``right`` with one key and time count as one.
    """
    payload = F.struct(F.col(at).alias(at), *[F.col(v) for v in value])
    names = left.columns
    keep = F.struct(*[F.col(c) for c in names])
    bucket_of = F.floor(F.col(at) / bucket).alias("__b")
    l = left.select(F.col(by).alias("__k"), bucket_of, F.col(at).alias("__t"), F.lit(1 if strict == forward else 0).alias("__o"), keep.alias("__l"), F.lit(None).cast(_type(right, payload)).alias("__r"))  # noqa: E741
    r = right.select(F.col(by).alias("__k"), bucket_of, F.col(at).alias("__t"), F.lit(0 if strict == forward else 1).alias("__o"), F.lit(None).cast(_type(left, keep)).alias("__l"), payload.alias("__r"))
    # Ties in time: a left row must see right rows of its own time, unless strict.  Forward looks run the same growing frame from the other
    # end; a frame that shrinks would be computed anew for each row.
    turn = (lambda c: F.col(c).desc()) if forward else F.col
    growing = Window.unboundedPreceding
    near = F.last("__r", ignorenulls=True).over(Window.partitionBy("__k", "__b").orderBy(turn("__t"), turn("__o")).rowsBetween(growing, 0))
    rows = l.unionByName(r)
    # the edge sample of every bucket, carried over empty ones
    sample = F.when(F.col("__r").isNotNull(), F.struct(F.col(f"__r.{at}").alias("t"), F.col("__r").alias("r")))
    edges = rows.groupBy("__k", "__b").agg((F.min if forward else F.max)(sample).alias("__e"))
    carried = F.last("__e", ignorenulls=True).over(Window.partitionBy("__k").orderBy(turn("__b")).rowsBetween(growing, -1))
    edges = edges.select("__k", "__b", carried.getField("r").alias("__c"))
    out = rows.withColumn("__n", near).where("__l is not null").join(edges, ["__k", "__b"], "left")
    found = F.coalesce("__n", "__c")
    return out.select(*[F.col("__l").getField(c).alias(c) for c in names], found.getField(at).alias(prefix + at), *[found.getField(v).alias(prefix + v) for v in value])


#: A table of at most so many rows is broadcast.
SMALL = 100_000


def small_side(df: DataFrame, name: str) -> DataFrame:
    """A summary table, written once, to be broadcast if it has few rows; a larger one is joined by its keys."""
    df = staged(df, name)
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _type(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("c")).schema["c"].dataType.simpleString()


def band(left: DataFrame, right: DataFrame, by: str, lo: Column, hi: Column, at: str, bucket: int) -> DataFrame:
    """Pairs of ``left`` rows with ``right`` rows of their key whose ``at`` lies in [lo, hi].

    A left row is copied to each bucket that its interval touches; the join is by key and bucket.
    """
    l = left.withColumn("__lo", lo).withColumn("__hi", hi).where("__hi >= __lo")  # noqa: E741
    l = l.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") / bucket), F.floor(F.col("__hi") / bucket))))  # noqa: E741
    names = [c for c in right.columns if c not in (by,)]
    r = right.select(F.col(by).alias("__rk"), F.floor(F.col(at) / bucket).alias("__rb"), *[F.col(c).alias(f"r_{c}") for c in names])
    on = (l[by] == r["__rk"]) & (l["__b"] == r["__rb"])
    return l.join(r, on).where(F.col(f"r_{at}").between(F.col("__lo"), F.col("__hi"))).drop("__rk", "__rb", "__b", "__lo", "__hi")
