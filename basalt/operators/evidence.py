"""Weighing evidence: votes for the byte at each slot of a period, candidates in order, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def period_votes(observations: DataFrame, periods: range) -> DataFrame:
    """One row per (period, slot): the winning value and how the others disagree.

    observations: offset, value, weight. The winner has most weight, then most votes, then the
    smallest value. Votes are summed by (period, slot, value) before they meet, so a hot slot is
    at most as many rows as it has values.
    """
    # Equal observations are summed before each period gets a copy of them.
    seen = observations.groupBy("offset", "value").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    each = seen.select(F.explode(F.sequence(F.lit(periods.start), F.lit(periods.stop - 1))).alias("period"), "offset", "value", "n", "w")
    votes = each.groupBy("period", F.pmod("offset", "period").alias("slot"), "value").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    best = F.max(F.struct("w", "n", (-F.col("value")).alias("order"))).alias("best")
    slots = votes.groupBy("period", "slot").agg(best, F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    return slots.select(
        "period",
        "slot",
        (-F.col("best.order")).alias("value"),
        (F.col("all_n") - F.col("best.n")).alias("conflicts"),
        (F.col("all_w") - F.col("best.w")).alias("conflict_weight"),
        (F.col("best.n") - 1).alias("agreements"),
        (F.col("best.w") * (F.col("best.n") - 1) / F.col("best.n")).alias("agreement_weight"),
    )


def ranked_periods(slots: DataFrame) -> DataFrame:
    """Periods in order: least conflict weight and conflicts, most agreement, then the shortest."""
    sums = slots.groupBy("period").agg(
        *[F.sum(c).alias(c) for c in ("conflicts", "conflict_weight", "agreements", "agreement_weight")], F.count("*").alias("known_slots")
    )
    order = Window.orderBy("conflict_weight", "conflicts", F.desc("agreement_weight"), F.desc("agreements"), "period")
    return sums.withColumn("rank", F.row_number().over(order))  # one row a period


def pruned(scores: DataFrame, keys: list[str], value: str, score: str, single: float, several: float, k: int) -> DataFrame:
    """Rows kept of each group: one if it leads by `single`, k if the k-th leads by `several`, else all."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), value)
    led = scores.withColumn("rank", F.row_number().over(order)).withColumn("next", F.lead(score).over(order)).withColumn("kth", F.lead(score, k).over(order))
    group = Window.partitionBy(*keys)
    first = F.max(F.when(F.col("rank") == 1, F.col(score))).over(group)
    gap1 = first - F.max(F.when(F.col("rank") == 1, F.col("next"))).over(group)
    gapk = first - F.max(F.when(F.col("rank") == 1, F.col("kth"))).over(group)
    limit = F.when(gap1 >= single, 1).when(gapk >= several, k)
    return led.withColumn("limit", limit).where(F.col("limit").isNull() | (F.col("rank") <= F.col("limit"))).drop("next", "kth", "limit")
