"""Tables in a folder: replaced by partitions, or in whole versions of which readers take the last complete one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.operators import sync


def _versions(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [x.getPath() for x in files.listStatus(root)]
    done = [p.getName() for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done if n.startswith("version="))


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")


def put(rows: DataFrame, path: str) -> None:
    """A new version of the table; rows may come from the one before. One writer at a time."""
    spark = rows.sparkSession
    rows.write.parquet(f"{path}/version={max(_versions(spark, path), default=0) + 1}")


def upsert(path: str, incoming: DataFrame, keys: list[str], update: dict[str, Column] | None = None) -> None:
    """Rows with known keys are updated, others inserted."""
    put(sync.upsert(current(incoming.sparkSession, path), incoming, keys, update), path)


def insert_absent(path: str, incoming: DataFrame, keys: list[str]) -> None:
    put(sync.insert_absent(current(incoming.sparkSession, path), incoming, keys), path)


def delete(path: str, ids: DataFrame, keys: list[str]) -> None:
    put(current(ids.sparkSession, path).join(ids.select(*keys).distinct(), keys, "left_anti"), path)


def replace_children(path: str, parents: DataFrame, children: DataFrame, key: str) -> None:
    """All children of the parents, which may have none now."""
    kept = current(parents.sparkSession, path).join(parents.select(key).distinct(), key, "left_anti")
    put(kept.unionByName(children), path)


def replace_partitions(path: str, rows: DataFrame, by: str) -> None:
    """The partitions that rows have a value of; others stay as they are, unread."""
    rows.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def outdated(rows: DataFrame, done: DataFrame, key: str, generation: int) -> DataFrame:
    """Rows that no run of this generation or a later one has done: the work of a rerun."""
    fresh = done.filter(F.col("generation") >= generation).select(key).distinct()
    return rows.join(fresh, key, "left_anti")


def stamp(path: str, rows: DataFrame, generation: int) -> None:
    """A generation's results, as a partition of their own, which a repeated run replaces."""
    replace_partitions(path, rows.withColumn("generation", F.lit(generation)), "generation")
