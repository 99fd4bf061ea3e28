"""Moments: trips by gaps in time, themes by likeness and words, people that occur often and together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.predicates import has_word
from glimmer.functions.scalars import trip_id
from glimmer.operators.sequences import best_row, gap_segments, global_gap_segments
from glimmer.operators.sync import replay_edits

SECOND_PLACE = 0.3
#: A recipe's parameters where it gives none (or zero).
DEFAULTS = {"gap_days": 3, "min_assets": 8, "top_k": 200, "min_score": 0.35, "top_persons": 8, "min_person_photos": 10, "min_together_persons": 2}


def parameters(recipe: dict) -> dict:
    return {k: recipe.get(k) or v for k, v in DEFAULTS.items()}


def dominant_place(items: DataFrame, keys: list[str], place: str) -> DataFrame:
    """keys, place: the most frequent one, and " & " the second if it has more than 0.3 of all rows. Blank ones don't count."""
    totals = items.groupBy(*keys).agg(F.count("*").alias("__total"))
    counts = items.filter(F.trim(F.coalesce(F.col(place), F.lit(""))) != "").groupBy(*keys, F.trim(place).alias("__place")).agg(F.count("*").alias("__n"))
    ranked = counts.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__n"), "__place"))).filter("__r <= 2").join(totals, keys)
    first = F.max(F.when(F.col("__r") == 1, F.col("__place")))
    second = F.max(F.when((F.col("__r") == 2) & (F.col("__n") / F.col("__total") > SECOND_PLACE), F.col("__place")))
    return ranked.groupBy(*keys).agg(F.concat_ws(" & ", first, second).alias("place"))


def month_range(first: Column, last: Column) -> Column:
    month, year = (lambda c: F.date_format(c, "MMM yyyy")), F.year
    return F.when(month(first) == month(last), month(first)).when(year(first) == year(last), F.concat(F.date_format(first, "MMM"), F.lit(" – "), month(last))).otherwise(F.concat(month(first), F.lit(" – "), month(last)))


def visit_label(first: Column, last: Column) -> Column:
    day = lambda c: F.date_format(c, "MMM d, yyyy")
    return F.when(day(first) == day(last), day(first)).otherwise(F.concat(F.date_format(first, "MMM d"), F.lit(" – "), day(last)))


def trips(items: DataFrame, keys: list[str], gap_days: int, min_assets: int, recipe: str) -> DataFrame:
    """Trips of items (keys, id, taken_at, city): keys, id, title, subtitle, place, first, last, n. keys may be empty."""
    gap = gap_days * 86400
    parted = gap_segments(items, "taken_at", gap, keys, ["id"]) if keys else global_gap_segments(items, "taken_at", gap)
    within = [*keys, "segment"]
    spans = parted.filter("segment IS NOT NULL").groupBy(*within).agg(F.min("taken_at").alias("first"), F.max("taken_at").alias("last"), F.count("*").alias("n")).filter(F.col("n") >= min_assets)
    named = spans.join(dominant_place(parted, within, "city"), within, "left")
    title = F.when(F.coalesce("place", F.lit("")) == "", "Trip").otherwise(F.concat("place", F.lit(" Trip")))
    return named.select(*keys, trip_id(F.lit(recipe), F.col("first")).alias("id"), title.alias("title"), month_range(F.col("first"), F.col("last")).alias("subtitle"), "place", "first", "last", "n")


def theme(hits: list[DataFrame], texts: DataFrame, words: list[str], pool: DataFrame, min_score: float) -> DataFrame:
    """(asset_id, score): the best score of all prompts from min_score on; a word in a text counts as min_score. Only the pool's."""
    found = [h.select("asset_id", "score").filter(F.col("score") >= min_score) for h in hits]
    if words:
        any_word = reduce(lambda a, b: a | b, [has_word(F.col("text"), w) for w in words])
        found.append(texts.filter(any_word).select("asset_id", F.lit(min_score).alias("score")))
    return reduce(DataFrame.unionByName, found).groupBy("asset_id").agg(F.max("score").alias("score")).join(pool, "asset_id", "left_semi")


def frequent(occurrences: DataFrame, person: str, least: int, most: int) -> DataFrame:
    """The `most` people with the most assets, of those with `least` at least."""
    counts = occurrences.groupBy(person).agg(F.countDistinct("asset_id").alias("photos")).filter(F.col("photos") >= least)
    return counts.orderBy(F.desc("photos"), person).limit(most)


def together(occurrences: DataFrame, people: DataFrame, least: int) -> DataFrame:
    """Assets that show `least` of the people at least."""
    own = occurrences.join(people.select("person"), "person", "left_semi")
    return own.groupBy("asset_id").agg(F.countDistinct("person").alias("people")).filter(F.col("people") >= least)


def recurring(texts: DataFrame, terms: list[str], pins: DataFrame, excludes: DataFrame, least_months: int) -> DataFrame:
    """Terms that recur: term, photos, spread (months), from texts (asset_id, text, month), pinned and without excluded assets."""
    found = F.filter(F.array(*[F.when(has_word(F.col("text"), w), F.lit(w)) for w in terms]), lambda x: x.isNotNull())
    hits = texts.select(F.explode(found).alias("term"), "asset_id", "month").unionByName(pins.select("term", "asset_id", "month"))
    kept = hits.join(excludes.select("asset_id"), "asset_id", "left_anti")
    return kept.groupBy("term").agg(F.countDistinct("asset_id").alias("photos"), F.countDistinct("month").alias("spread")).filter(F.col("spread") >= least_months)


def featured(members: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n best members of each moment: by score, aesthetic, id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc_nulls_last("aesthetic_score"), "asset_id")
    return members.withColumn("featured", F.row_number().over(w) <= n)


def cover(members: DataFrame, keys: list[str], bright: str = "bright") -> DataFrame:
    """Each moment's cover: the best featured member that is bright enough; if none is, the best of all."""
    order = [F.desc(F.coalesce(F.col(bright), F.lit(False)) & F.col("featured")), F.desc("score"), F.desc_nulls_last("aesthetic_score"), F.asc("asset_id")]
    return best_row(members, keys, order).select(*keys, F.col("asset_id").alias("cover_asset_id"))


def with_edits(members: DataFrame, edits: DataFrame, alive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of moments after the users' edits, and what is derived from them: count and time span."""
    rows = replay_edits(members, edits, alive.select("asset_id"), ["moment_id", "asset_id"])
    derived = rows.join(alive, "asset_id").groupBy("moment_id").agg(F.count("*").alias("asset_count"), F.min("taken_at").alias("time_from"), F.max("taken_at").alias("time_to"))
    return rows, derived
