"""Writing back: upserts, differences between states, set algebra on ids, edits replayed on derived sets.

Each function gives the new state, or the changes to make, as a DataFrame; a caller overwrites or merges with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.operators.naming import RESTORED, free_names

AUTO, PINNED, EXCLUDED = 0, 1, 2


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """current with incoming put over it by keys.

    `update` gives columns of rows in both, from `old.<c>` and `new.<c>`; others are taken from incoming. Rows of current
    alone stay. incoming has one row for each key.
    """
    old, new = current.withColumn("__o", F.lit(True)).alias("old"), incoming.withColumn("__n", F.lit(True)).alias("new")
    on = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
    both, fresh = F.col("__o") & F.col("__n"), F.col("__n")
    columns = []
    for c in current.columns:
        new_value = F.col(f"new.{c}") if c in incoming.columns else F.lit(None)
        changed = (update or {}).get(c, new_value if c in incoming.columns else F.col(f"old.{c}"))
        columns.append(F.when(both, changed).when(fresh, new_value).otherwise(F.col(f"old.{c}")).alias(c))
    return old.join(new, on, "full_outer").select(*columns)


def asset_upsert(assets: DataFrame, scanned: DataFrame) -> DataFrame:
    """Files scanned again, by path; what was derived from a file's content is reset only where its checksum changed."""
    same = F.col("old.checksum").eqNullSafe(F.col("new.checksum"))
    keep = lambda c, reset: F.when(same, F.col(f"old.{c}")).otherwise(reset)
    return upsert(
        assets,
        scanned,
        ["file_path"],
        {"id": F.col("old.id"), "face_scanned": keep("face_scanned", F.lit(False)), "caption_synced": keep("caption_synced", F.lit(False)), "aesthetic_score": keep("aesthetic_score", F.lit(None))},
    )


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(incoming.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def count_events(events: DataFrame, keys: list[str], time: str, n: str = "view_count", last: str = "last_viewed_at") -> DataFrame:
    """Counters as an aggregate of the log instead of one update each."""
    return events.groupBy(*keys).agg(F.count("*").alias(n), F.max(time).alias(last))


def merge_counters(current: DataFrame, fresh: DataFrame, keys: list[str], n: str = "view_count", last: str = "last_viewed_at") -> DataFrame:
    return current.unionByName(fresh).groupBy(*keys).agg(F.sum(n).alias(n), F.max(last).alias(last))


def orphans_removed(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def difference(old: DataFrame, new: DataFrame, key: str, value: str, least: float = 0.0) -> DataFrame:
    """(key, old, new, action) of two sets with values: insert, update, delete or keep."""
    a, b = old.select(F.col(key), F.col(value).alias("old")), new.select(F.col(key), F.col(value).alias("new"))
    joined = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), key, "full_outer")
    action = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "delete").when(F.abs(F.col("old") - F.col("new")) > least, "update").otherwise("keep")
    return joined.select(key, "old", "new", action.alias("action"))


def reconcile(stored: DataFrame, evaluated: DataFrame, key: str = "asset_id") -> DataFrame:
    """(key, match_score, origin, action): a standing view's matches after a new evaluation. Rows that a user pinned or excluded stay."""
    old = stored.select(key, F.col("match_score").alias("__old"), F.col("origin").alias("__origin"))
    joined = old.join(evaluated.select(key, F.col("match_score").alias("__new")), key, "full_outer")
    by_user = F.coalesce(F.col("__origin") != AUTO, F.lit(False))
    action = F.when(by_user, "keep").when(F.col("__origin").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(F.col("__new") != F.col("__old"), "update").otherwise("keep")
    score = F.when(by_user, F.col("__old")).otherwise(F.coalesce("__new", "__old"))
    return joined.select(key, score.alias("match_score"), F.coalesce("__origin", F.lit(AUTO)).alias("origin"), action.alias("action"))


def set_origin(stored: DataFrame, edits: DataFrame, key: str = "asset_id") -> DataFrame:
    """Matches after edits (key, op: pin, remove, restore): pinned rows are added with score 1, restored ones are automatic again."""
    joined = stored.join(edits, key, "full_outer")
    origin = F.when(F.col("op") == "pin", PINNED).when(F.col("op") == "remove", EXCLUDED).when(F.col("op") == "restore", AUTO).otherwise(F.col("origin"))
    known = F.col("origin").isNotNull() | (F.col("op") == "pin")
    return joined.filter(known).select(key, F.coalesce("match_score", F.lit(1.0)).alias("match_score"), origin.cast("int").alias("origin"))


def replay_edits(members: DataFrame, edits: DataFrame, alive: DataFrame, keys: list[str]) -> DataFrame:
    """Derived members after the user's edits (op: pin, exclude): excluded ones go, pinned ones come if they are alive."""
    excluded = edits.filter("op = 'exclude'").select(*keys)
    pinned = edits.filter("op = 'pin'").select(*keys).join(alive, keys[-1], "left_semi")
    left = members.join(excluded, keys, "left_anti").withColumn("manual", F.lit(False))
    marked = left.join(pinned.withColumn("__p", F.lit(True)), keys, "left").withColumn("manual", F.col("manual") | F.coalesce("__p", F.lit(False))).drop("__p")
    return marked.unionByName(pinned.join(members.select(*keys), keys, "left_anti").withColumn("manual", F.lit(True)), allowMissingColumns=True)


def sync_members(stored: DataFrame, drafted: DataFrame, keys: list[str]) -> DataFrame:
    """A set's rows after a recomputation: kept ones keep added_at, pinned ones stay although they are not drafted."""
    old = stored.select(*keys, F.col("added_at").alias("__added"), F.col("manual").alias("__manual"))
    joined = old.join(drafted.withColumn("__d", F.lit(True)), keys, "full_outer")
    return joined.filter(F.coalesce("__d", F.lit(False)) | F.coalesce("__manual", F.lit(False))).select(*keys, "score", F.col("__added").alias("added_at"), F.coalesce("__manual", F.lit(False)).alias("manual"))


def intersection(sets: list[DataFrame], key: str = "asset_id") -> DataFrame | None:
    """Ids that are in all sets; none without any set."""
    if not sets:
        return None
    return reduce(lambda a, b: a.join(b, key, "left_semi"), [s.select(key).distinct() for s in sets])


def ordered_union(first: DataFrame, second: DataFrame, key: str, place: str = "position") -> DataFrame:
    """first in its order, then what second has besides: key, source (0, 1), position."""
    all_rows = first.select(key, F.lit(0).alias("source"), F.col(place).alias("__p")).unionByName(second.select(key, F.lit(1).alias("source"), F.col(place).alias("__p")))
    best = all_rows.groupBy(key).agg(F.min(F.struct("source", "__p")).alias("m"))
    return best.select(key, F.col("m.source").alias("source"), F.col("m").getField("__p").alias("__p")).select(key, "source", (F.row_number().over(Window.orderBy("source", "__p", key)) - 1).alias("position"))


def is_permutation(order: DataFrame, members: DataFrame, key: str) -> bool:
    """Whether the rows of order are the members, each once. Only counts come to the driver."""
    given = order.groupBy(key).agg(F.count("*").alias("__n"))
    both = given.join(members.select(key).distinct().withColumn("__m", F.lit(True)), key, "full_outer")
    return not both.filter("__n IS NULL OR __n > 1 OR __m IS NULL").limit(1).count()


def reordered(members: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Members with the places that order (key, place) gives them; refuses anything but a permutation."""
    if not is_permutation(order, members, key):
        raise ValueError("the order is no permutation of the members")
    return members.join(order.select(key, F.col("place").alias("__place")), key).withColumn("position", F.col("__place")).drop("__place")


def expired(rows: DataFrame, deleted: str, now: Column, days: int) -> DataFrame:
    """Rows deleted longer ago than days (30 unless positive)."""
    return rows.filter(F.col(deleted) < now - F.make_dt_interval(F.lit(days if days > 0 else 30)))


def merged_person(mapping: DataFrame, source: str, into: str) -> DataFrame:
    return mapping.withColumn("person_id", F.when(F.col("person_id") == source, into).otherwise(F.col("person_id")))


def merge_target(name_a: Column, name_b: Column, a: Column, b: Column) -> Column:
    """Which of two people a merge keeps: a named one, else the one with the larger id."""
    has_a, has_b = F.coalesce(name_a, F.lit("")) != "", F.coalesce(name_b, F.lit("")) != ""
    return F.when(has_a & ~has_b, a).when(has_b & ~has_a, b).otherwise(F.greatest(a, b))


def restored_names(rows: DataFrame, taken: DataFrame, path: str = "file_path") -> DataFrame:
    """Paths for restored files, in order of id: their own if free, else the first free of "x (restored).jpg", "x (restored 2).jpg" ..."""
    return free_names(rows, path, [], ["id"], RESTORED, "restored_path", taken)


def edited_moments(moments: DataFrame, order: DataFrame, hidden: DataFrame, titles: DataFrame) -> DataFrame:
    """moments (id, sort_order, hidden, title) after a user's order (id, place from 1: sort_order by tens), hidden ids, and titles (blank ones change nothing)."""
    placed = moments.join(order.select("id", (F.col("place") * 10).cast("long").alias("__place")), "id", "left").join(hidden.select("id", F.lit(True).alias("__hide")), "id", "left")
    titled = placed.join(titles.filter(F.trim("title") != "").select("id", F.col("title").alias("__title")), "id", "left")
    return titled.select("id", F.coalesce("__place", "sort_order").alias("sort_order"), (F.col("hidden") | F.coalesce("__hide", F.lit(False))).alias("hidden"), F.coalesce("__title", "title").alias("title"))


#: Milliseconds that a planned purge waits.
GRACE_MS = 30_000


def purge_planned(people: DataFrame, now_ms: int) -> DataFrame:
    """People hidden at once, to be purged after the grace."""
    return people.select("id", F.lit(True).alias("hidden"), F.lit(now_ms + GRACE_MS).cast("long").alias("purge_at"))


def purged(people: DataFrame, now_ms: int) -> DataFrame:
    """Without those whose purge is due and who are hidden still."""
    return people.filter(~(F.col("hidden") & F.coalesce(F.col("purge_at") <= now_ms, F.lit(False))))


def detached(faces: DataFrame, out: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """faces without those of out (person_id, asset_id), and people without the unnamed ones that have no face left."""
    left = faces.join(out, ["person_id", "asset_id"], "left_anti")
    seen = left.select(F.col("person_id").alias("id")).distinct().withColumn("__seen", F.lit(True))
    return left, people.join(seen, "id", "left").filter(F.col("__seen") | (F.coalesce("name", F.lit("")) != "")).drop("__seen")


def pruned(cache: DataFrame, alive: DataFrame, key: str, written_at: str, before: Column) -> DataFrame:
    """Entries whose key lives, or that are younger than the time given."""
    known = alive.select(key).distinct().withColumn("__known", F.lit(True))
    return cache.join(known, key, "left").filter(F.col("__known") | (F.col(written_at) >= before)).drop("__known")
