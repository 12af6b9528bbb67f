"""Connected components of an edge table by alternating large and small stars, on DataFrames only.

Each round re-hangs edges on smaller ids (the two steps of Kiveris et al., 2014); the rounds end when the edge table
no longer changes.  No node's neighbours are ever collected: both steps take a minimum for each node (summed before the
shuffle) and join it back.  Every round's edges are a written table, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``u, v``, not null): the smallest id that can be reached.

    Self edges and repeated edges are allowed; an empty table gives an empty result.
    """
    e = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _sum(e)
    while seen[0]:
        # large star: all greater neighbours of a node hang on the smallest of the node and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = stage(small.where("u <> v").distinct(), "edges")
        now = _sum(e)
        if now == seen:
            break
        seen = now
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
