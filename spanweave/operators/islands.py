"""Gaps and islands: sessions of rows whose distance to the row before stays within a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_gap(df: DataFrame, by: list[str], at: str, tie: str | None = None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(at, *([tie] if tie else []))
    return df.withColumn("gap", F.col(at) - F.lag(at).over(w))


def with_island(df: DataFrame, by: list[str], at: str, limit: int | float | None = None, breaks: Column | None = None, tie: str | None = None, name: str = "island") -> DataFrame:
    """Adds the island's number (0, 1, ... in each group): a new one where the gap exceeds ``limit`` or ``breaks`` holds."""
    w = Window.partitionBy(*by).orderBy(at, *([tie] if tie else []))
    new = breaks if breaks is not None else (F.col(at) - F.lag(at).over(w)) > limit
    df = df.withColumn("__new", F.coalesce(new.cast("int"), F.lit(0)))
    return df.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def numbered(df: DataFrame, by: list[str], *order: str | Column, name: str = "span_no") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
