"""The list of queries: each with its SQL for an independent engine, and the operators that it shows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from glimmer.shipping import ship

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    sql: str | None
    operators: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of `t`, which reads a table by its name."""

    def register(f: Callable) -> Callable:
        def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = Query(f.__name__, plan, sql, tuple(operators.split()))
        return f

    return register
