"""Joins by order: the latest earlier row, and overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], tie: str) -> DataFrame:
    """left with the values of the latest right row of its keys at or before it.

    One union and one window instead of a join on an inequality: each key's rows are sorted once, right rows first
    among equal times, and the last right row carries forward. A hot key's rows are sorted by one task, which spills.
    """
    found = F.struct(*values)
    a = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.select(found.alias("v")).schema["v"].dataType).alias("_v"))
    b = right.select(*[F.col(c) if c in (*keys, on) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), found.alias("_v"))
    w = Window.partitionBy(*keys).orderBy(on, "_side", tie).rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return carried.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def overlaps(left: DataFrame, right: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Pairs (a, b) of rows whose intervals [start, end] of numbers overlap: both sides are cut into cells of `width`, which makes it an equi-join, and a pair counts in the cell where the later one starts."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    a = left.select(F.struct("*").alias("a"), F.explode(F.sequence(cell(start), cell(end))).alias("_c"))
    b = right.select(F.struct("*").alias("b"), F.explode(F.sequence(cell(start), cell(end))).alias("_c"))
    at = F.floor(F.greatest(F.col(f"a.{start}"), F.col(f"b.{start}")) / width).cast("long")
    meets = (F.col(f"a.{start}") <= F.col(f"b.{end}")) & (F.col(f"b.{start}") <= F.col(f"a.{end}"))
    return a.join(b, "_c").where(meets & (at == F.col("_c"))).select("a", "b")
