"""Tables that an operator writes midway, names that no caller's column has, and small batches for Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glimmer.shipping import ship
from glimmer.store import removed, shared_folder, written

__all__ = ["names", "removed", "shared_folder", "small_batches", "written"]


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python some megabytes at a time, so that a worker's memory doesn't follow their length; a smaller setting stays."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(1000, int(spark.conf.get(key)))))


def names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with so many underscores that df has no such column, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
