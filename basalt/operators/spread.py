"""Rows dealt out evenly before a step that makes much work of few bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed value: tasks a core, so that uneven ones even out.
TASKS_A_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """df in TASKS_A_CORE tasks a core: files are split by their bytes, so many short rows are else a few tasks."""
    return df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)
