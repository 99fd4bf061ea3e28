"""Standing views as tables: made, changed, copied and logged; their figures; albums from them and the other way round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.functions.predicates import clamp_threshold
from glimmer.operators.sequences import top_per_group
from glimmer.operators.sync import EXCLUDED, PINNED

BINS = 10


def created(views: DataFrame, new: list[tuple[int, str, int]]) -> DataFrame:
    """views (id, name, threshold, live) with new ones; thresholds outside 50 to 99 become 70."""
    rows = [(i, name.strip(), clamp_threshold(threshold)) for i, name, threshold in new if name.strip()]
    fresh = views.sparkSession.createDataFrame(rows, "id long, name string, threshold int")
    return views.unionByName(fresh.withColumn("live", F.lit(True)))


def changed(views: DataFrame, edits: DataFrame) -> DataFrame:
    """After edits (id, name, threshold, live), of which nulls change nothing."""
    own = edits.select("id", *[F.col(c).alias(f"new_{c}") for c in ("name", "threshold", "live")])
    valid = F.when(F.col("new_threshold").between(50, 99), F.col("new_threshold")).when(F.col("new_threshold").isNotNull(), 70)
    return views.join(own, "id", "left").select("id", F.coalesce("new_name", "name").alias("name"), F.coalesce(valid, "threshold").cast("int").alias("threshold"), F.coalesce("new_live", "live").alias("live"))


def duplicated(views: DataFrame, matches: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """views and matches (view_id, ...) with copies (id, copy_id): a view's copy has its settings, name and matches."""
    own = views.join(copies, "id").select(F.col("copy_id").alias("id"), F.concat("name", F.lit(" (copy)")).alias("name"), "threshold", "live")
    more = matches.join(copies.withColumnRenamed("id", "view_id"), "view_id").withColumn("view_id", F.col("copy_id")).drop("copy_id")
    return views.unionByName(own), matches.unionByName(more)


def deleted(views: DataFrame, matches: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the views, and without their matches."""
    return views.join(ids, "id", "left_anti"), matches.join(ids.withColumnRenamed("id", "view_id"), "view_id", "left_anti")


def activity(log: DataFrame, limit: int = 20) -> DataFrame:
    """The last entries of each view's log (view_id, at, action, id)."""
    return top_per_group(log, limit, ["view_id"], [F.desc("at"), F.desc("id")])


def stats(matches: DataFrame, assets: DataFrame, since: Column) -> DataFrame:
    """view_id, n, added (since then), bytes, median (of scores, in hundredths), bins (how many scores in each tenth)."""
    shown = matches.filter(F.col("origin") != EXCLUDED).join(assets.select(F.col("id").alias("asset_id"), "file_size"), "asset_id")
    tenth = F.least(F.floor(F.col("match_score") * BINS), F.lit(BINS - 1))
    bins = F.array(*[F.count(F.when(tenth == i, 1)) for i in range(BINS)])
    return shown.groupBy("view_id").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("matched_at") >= since, 1)).alias("added"),
        F.sum("file_size").alias("bytes"),
        F.floor(F.percentile("match_score", F.lit(0.5)) * 100 + 0.5).cast("long").alias("median"),
        bins.alias("bins"),
    )


def as_album(matches: DataFrame) -> DataFrame:
    """(album, asset_id, position): a view's matches in the order of their scores, the excluded ones left out; missing disks don't matter."""
    w = Window.partitionBy("view_id").orderBy(F.desc("match_score"), "asset_id")
    return matches.filter(F.col("origin") != EXCLUDED).select(F.col("view_id").alias("album"), "asset_id", (F.row_number().over(w) - 1).cast("long").alias("position"))


def from_album(members: DataFrame) -> DataFrame:
    """(view_id, asset_id, match_score, origin): an album's members, all pinned."""
    return members.select(F.col("album").alias("view_id"), "asset_id", F.lit(1.0).alias("match_score"), F.lit(PINNED).alias("origin"))
