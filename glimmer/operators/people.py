"""People, albums and places: lists, guards, details, covers, queues and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.predicates import person_listable
from glimmer.functions.scalars import clamp
from glimmer.operators.dealing import tasks_of
from glimmer.operators.sequences import best_row, gap_segments, in_order, spread_positions, top_per_group
from glimmer.operators.vectors import centroids, cosine_distance

def listed(people: DataFrame, faces: DataFrame, floor: float) -> DataFrame:
    """People (id, name, favorite, relation, hidden, confidence) who are shown, in order, with the number of their pictures. faces: asset, person."""
    counts = faces.groupBy(F.col("person").alias("id")).agg(F.countDistinct("asset").alias("assets"))
    first = (F.coalesce("name", F.lit("")) != "") | F.col("favorite")
    return people.filter(person_listable(floor)).join(counts, "id").withColumn("first_block", first).orderBy(*order())


def order() -> list:
    """Named people and favourites, then the others; each by the number of pictures."""
    return [F.desc("first_block"), F.desc("assets"), F.asc("id")]


def shown(people: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ids that are people and not hidden."""
    return ids.join(people.filter(~F.col("hidden")).select("id"), "id", "left_semi")


def places(faces: DataFrame, geo: DataFrame) -> DataFrame:
    """person, city, assets of faces (asset, person) on pictures with a place (asset, city, lat, lon); (0, 0) is none."""
    own = geo.filter(~((F.col("lat") == 0) & (F.col("lon") == 0)))
    met = faces.repartition(tasks_of(faces), "asset").join(own, "asset").select("person", "city", "asset").distinct()
    return met.groupBy("person", "city").agg(F.count("*").alias("assets"))


def _listed(rows: DataFrame, value: str, place: str, name: str) -> DataFrame:
    items = F.transform(F.sort_array(F.collect_list(F.struct(place, F.col(value).cast("string").alias("x")))), lambda s: s["x"])
    return rows.groupBy("album").agg(items.alias(name))


def album_detail(members: DataFrame, faces: DataFrame) -> DataFrame:
    """album, assets, since, until, people (three), names (the first five), covers (first, middle, last) of members (album, asset, taken_at, file_name)."""
    n = tasks_of(members, faces)
    whole = Window.partitionBy("album")
    w = whole.orderBy("taken_at", "asset")
    placed = members.repartition(n, "album").withColumn("place", F.row_number().over(w)).withColumn("candidate", spread_positions(w, whole))
    sums = placed.groupBy("album").agg(F.count("*").alias("assets"), F.min("taken_at").alias("since"), F.max("taken_at").alias("until"), in_order(F.col("place") <= 5, "place", F.col("file_name")).alias("names"), in_order(F.col("candidate"), "place", F.col("asset").cast("string")).alias("covers"))
    met = faces.repartition(n, "asset").join(members.select("asset", "album"), "asset").select("album", "person", "asset").distinct()
    counts = met.repartition(n, "album").groupBy("album", "person").agg(F.count("*").alias("n"))
    top = _listed(top_per_group(counts, 3, ["album"], [F.desc("n"), F.asc("person")]), "person", "rank", "people")
    return sums.join(top, "album", "left").select("album", "assets", "since", "until", "people", "names", "covers")


def covers(rows: DataFrame, key: str, id_column: str, vector: str, score: str) -> DataFrame:
    """key, cover, by_centroid: the best-scored row (scores below 0 can't be compared), or else the one nearest to the centroid."""
    near = rows.join(centroids(rows, [key], vector).drop("n"), key).withColumn("far", F.round(cosine_distance(F.col(vector), F.col("centroid")), 9))
    ranked = best_row(near.withColumn("far", F.when(F.col(score) < 0, F.col("far")).otherwise(0.0)), [key], [F.desc(F.greatest(F.col(score), F.lit(-1.0))), F.asc("far"), F.asc(id_column)])
    return ranked.select(key, F.col(id_column).alias("cover"), (F.col(score) < 0).alias("by_centroid"))


def queues(assets: DataFrame, with_sprites: DataFrame) -> DataFrame:
    """queue, id of assets (id, status, face_scanned, caption_synced, video) that wait for work."""
    ready = assets.filter("status = 'indexed'")
    waiting = {
        "pending": assets.filter("status = 'pending'"),
        "faces": ready.filter(~F.col("face_scanned")),
        "sprites": ready.filter("video").join(with_sprites, "id", "left_anti"),
        "captions": ready.filter(~F.col("caption_synced")),
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("queue"), "id") for name, rows in waiting.items()])


def verdicts(layout: DataFrame, margins: DataFrame, generation: int, low: float, high: float, w_text: float = 0.65, w_lines: float = 0.35) -> DataFrame:
    """doc_id, score: of the margin to this generation's prompts and the lines' regularity; of these alone where there is no such margin."""
    own = margins.filter(F.col("generation") == generation).select("doc_id", "margin")
    lines, text = clamp(F.col("regularity")), clamp((F.col("margin") - low) / (high - low))
    return layout.join(own, "doc_id", "left").select("doc_id", F.when(F.col("margin").isNull(), lines).otherwise(w_text * text + w_lines * lines).alias("score"))


def place_details(photos: DataFrame, gap_days: float) -> DataFrame:
    """city, photos, visits, years, busiest (year with most photos, of equal ones the last), insight."""
    visits = gap_segments(photos, "taken_at", gap_days * 86_400, ["city"], ["taken_at", "id"], "visit").withColumn("year", F.year("taken_at"))
    years = visits.groupBy("city", "year").agg(F.count("*").alias("n")).groupBy("city").agg(F.max_by("year", F.struct("n", "year")).alias("busiest"), F.count("*").alias("years"))
    sums = visits.groupBy("city").agg(F.count("*").alias("photos"), (F.max("visit") + 1).cast("long").alias("visits"))
    said = F.when(F.col("visits") >= 5, "often").when(F.col("visits") > 1, "again").otherwise("once")
    return sums.join(years, "city").withColumn("insight", said)
