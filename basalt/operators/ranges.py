"""Byte ranges: merging, complement, layout of objects behind each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Disjoint ranges that cover the same; ranges that touch merge too."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(start) <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = ranges.select(*keys, start, end).withColumn("reach", reach).withColumn("island", island)
    return marked.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def uncovered(ranges: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """The gaps between merged ranges of each key."""
    order = Window.partitionBy(*keys).orderBy(start)
    gaps = merged(ranges, keys, start, end).withColumn("gap", F.lead(start).over(order)).where("gap is not null")
    return gaps.select(*keys, F.col(end).alias("gap_start"), F.col("gap").alias("gap_end"))


def layout(objects: DataFrame, keys: list[str], ident: list[str], offset: str, size: str, header: int) -> DataFrame:
    """New offsets: by old offset, each at the larger of the cursor and its old offset.

    The cursor's recurrence has a closed form: sizes before it plus the largest of the header end
    and all (old offset - sizes before) so far.
    """
    order = Window.partitionBy(*keys).orderBy(offset, *ident)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slack = F.max(F.col(offset) - F.col("before")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return objects.withColumn("before", before).withColumn("new_offset", F.greatest(F.lit(header), slack) + F.col("before")).drop("before")
