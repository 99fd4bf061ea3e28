"""Operators on ordered rows: segments by gaps, runs, cut points, places in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def seconds(t: Column) -> Column:
    """Microsecond-exact seconds of a timestamp of either kind."""
    return F.unix_micros(t.cast("timestamp")) / 1_000_000


def gap_segments(rows: DataFrame, time: str, gap_seconds: float, keys: list[str], order: list[str] | None = None, name: str = "segment") -> DataFrame:
    """Numbers segments from 0 within keys: a new one where the gap to the row before is larger than gap_seconds.

    Rows without a time belong to no segment (null). The work is split by keys; use `global_gap_segments` without any.
    """
    w = Window.partitionBy(*keys, F.col(time).isNull()).orderBy(time, *(order or []))
    far = F.coalesce(seconds(F.col(time)) - seconds(F.lag(time).over(w)) > gap_seconds, F.lit(False))
    started = rows.withColumn("__new", far.cast("long"))
    number = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return started.withColumn(name, F.when(F.col(time).isNotNull(), number)).drop("__new")


def global_gap_segments(rows: DataFrame, time: str, gap_seconds: float, name: str = "segment") -> DataFrame:
    """gap_segments over all rows, without sorting them in one task.

    Rows are grouped by hours; only each hour's first and last time meet in one window, and hours are numbered there. A
    gap of an hour at least never falls inside an hour group, so segments that begin inside one exist for smaller gaps
    alone; these are counted per hour, and added up over hours.
    """
    hour = F.floor(seconds(F.col(time)) / 3600)
    timed = rows.withColumn("__hour", hour)
    w = Window.partitionBy("__hour").orderBy(time)
    inner = timed.filter(F.col(time).isNotNull()).withColumn("__new", F.coalesce(seconds(F.col(time)) - seconds(F.lag(time).over(w)) > gap_seconds, F.lit(False)).cast("long"))
    inner = inner.withColumn("__at", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    hours = inner.groupBy("__hour").agg(F.min(seconds(F.col(time))).alias("first"), F.max(seconds(F.col(time))).alias("last"), F.sum("__new").alias("n"))
    along = Window.orderBy("__hour")
    begins = F.coalesce(F.col("first") - F.lag("last").over(along) > gap_seconds, F.lit(False)).cast("long")
    base = hours.withColumn("b", begins).select("__hour", (F.sum("b").over(along) + F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__base"))
    numbered = inner.join(base, "__hour").withColumn(name, F.col("__base") + F.col("__at")).drop("__hour", "__new", "__at", "__base")
    return numbered.unionByName(rows.filter(F.col(time).isNull()).withColumn(name, F.lit(None).cast("long")))


def runs(rows: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Runs of consecutive rows that have the flag: keys, first and last value of order[0], length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("__flag", flag).withColumn("__breaks", F.sum(F.when(F.col("__flag"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.filter("__flag").groupBy(*keys, "__breaks").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length")).drop("__breaks")


def failures_since_success(rows: DataFrame, failed: Column, keys: list[str], order: list[str], name: str = "fail_count") -> DataFrame:
    """Failures in a row up to each row, 0 at a success."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("__f", failed.cast("int")).withColumn("__s", F.sum(1 - F.col("__f")).over(w))
    inside = Window.partitionBy(*keys, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn(name, F.sum("__f").over(inside)).drop("__f", "__s")


def rising_edges(rows: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Rows at which the flag turns from false to true; the first row counts as risen if it has the flag."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__f", flag).withColumn("__p", F.lag("__f", 1, False).over(w)).filter(F.col("__f") & ~F.col("__p")).drop("__f", "__p")


def score_cut(rows: DataFrame, score: str, keys: list[str], alpha: float = 0.7, order: list[str] | None = None) -> DataFrame:
    """Adds `position` (from 0, by score descending) and `below_cut`.

    The largest drop between neighbours (the first of equal ones) is the cut if it is at least 0.1 and twice the mean
    drop; else the first score under alpha times the best is. Fewer than three scores have no cut; one row stays above.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *(order or []))
    whole = Window.partitionBy(*keys)
    placed = rows.withColumn("position", F.row_number().over(w) - 1).withColumn("__drop", F.col(score) - F.lead(score).over(w))
    figures = (
        placed.withColumn("__n", F.count("*").over(whole))
        .withColumn("__best", F.max(score).over(whole))
        .withColumn("__most", F.max("__drop").over(whole))
        .withColumn("__mean", F.avg("__drop").over(whole))
    )
    cliff = F.min(F.when(F.col("__drop") == F.col("__most"), F.col("position") + 1)).over(whole)
    line = F.min(F.when((F.col("position") > 0) & (F.col(score) < alpha * F.col("__best")), F.col("position"))).over(whole)
    steep = F.col("__most") >= F.greatest(F.lit(0.1), 2 * F.col("__mean"))
    cut = F.when(F.col("__n") < 3, F.col("__n")).when(steep, cliff).otherwise(F.coalesce(line, F.col("__n")))
    return figures.withColumn("below_cut", F.col("position") >= F.greatest(F.lit(1), cut)).drop("__drop", "__n", "__best", "__most", "__mean")


def top_per_group(rows: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(rows, 1, keys, order).drop("rank")


def spread_positions(w: WindowSpec, whole: WindowSpec) -> Column:
    """Whether a row is the first, middle or last of its group."""
    place, n = F.row_number().over(w) - 1, F.count("*").over(whole)
    return (place == 0) | (place == F.floor(n / 2)) | (place == n - 1)


def in_order(chosen: Column, place: str, value: Column) -> Column:
    """Aggregate: the values of the chosen rows, few of a group, by their place."""
    return F.transform(F.sort_array(F.collect_list(F.when(chosen, F.struct(F.col(place).alias("o"), value.alias("v"))))), lambda s: s["v"])


def next_positions(new: DataFrame, existing: DataFrame, keys: list[str], member: str, order: list[str]) -> DataFrame:
    """Rows to append to ordered sets: those not members yet, at places after the last one."""
    fresh = new.join(existing.select(*keys, member), [*keys, member], "left_anti").dropDuplicates([*keys, member])
    last = existing.groupBy(*keys).agg(F.max("position").alias("__last"))
    place = F.coalesce(F.col("__last"), F.lit(-1)) + F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return fresh.join(last, keys, "left").withColumn("position", place).drop("__last")


def unique_names(rows: DataFrame, name: str, keys: list[str], order: list[str]) -> DataFrame:
    """rows with `entry`: "a.jpg", "a-2.jpg", "a-3.jpg" for equal names within keys, whatever names of that form there are."""
    from glimmer.operators.naming import DASHED, free_names

    return free_names(rows, name, keys, order, DASHED)


def quiet_periods(rows: DataFrame, keys: list[str], time: str, idle: str, pending: Column) -> DataFrame:
    """(keys, due, pending): when nothing had come for `idle`, and whether the last row left something pending."""
    runs_ = rows.withColumn("__p", pending).groupBy(*keys, F.session_window(time, idle).alias("w"))
    return runs_.agg(F.max_by("__p", time).alias("pending")).select(*keys, F.col("w.end").alias("due"), "pending")


def unplaced(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Groups of two rows at least whose places are all 0."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"))
    return sums.filter("n >= 2 AND low = 0 AND high = 0").select(*keys)
