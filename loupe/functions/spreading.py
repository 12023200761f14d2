"""Deals the rows of narrow tables over tasks before costly passes."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks for each core, so that uneven ones even out.
TASKS_PER_CORE = 4


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, dealt by their keys over several tasks for each core.

    A million numbers are a few megabytes of one file, and so one task, however long a pass works on what is made of
    each of them. Deal the numbers, not the texts: what is made of them stays in its task.
    """
    return df.repartition(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, *keys)
