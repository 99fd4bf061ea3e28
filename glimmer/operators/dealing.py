"""Rows dealt to as many tasks as their number asks for, so that what one task sorts or groups doesn't follow the input."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task, some; fewer where tasks would be fewer than cores.
ROWS, LEAST = 1 << 19, 1 << 15


def tasks_for(spark: SparkSession, rows: int) -> int:
    return max(1, math.ceil(rows / ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(rows / LEAST)))


def tasks_of(*tables: DataFrame) -> int:
    """For rows of all tables together. Tables are counted, which takes none of their columns where they are files."""
    return tasks_for(tables[0].sparkSession, sum(t.count() for t in tables))
