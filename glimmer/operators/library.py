"""Whole answers over a library's tables: an album's summary, covers' shapes, faces with their size, and what is pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.operators.dealing import tasks_of
from glimmer.operators.sequences import in_order, spread_positions, top_per_group

SAMPLE_CHARS = 80


def _listed(rows: DataFrame, keys: list[str], value: Column, order: str, out: str) -> DataFrame:
    """The values of each key's rows in order; rows are few by their making."""
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"]).alias(out))


def sampled(texts: DataFrame) -> DataFrame:
    """texts with their `chars` and a `sample` of 80 of these in place of the text, which may be long; those without text go."""
    others = [c for c in texts.columns if c != "text"]
    return texts.filter("text <> ''").select(*others, F.length("text").alias("chars"), F.substring("text", 1, SAMPLE_CHARS).alias("sample"))


def album_summary(members: DataFrame, places: DataFrame, faces: DataFrame, texts: DataFrame) -> DataFrame:
    """album, assets, photos, videos, since, until, places, people, samples, names, covers of members (album, asset, taken_at, mime_type,
    file_name) that are shown.

    places (asset, city, country), faces (asset, person, name), texts (asset, text, or asset, chars, sample of `sampled`): the three
    cities with most pictures, the three named people on most of them, the three longest recognized texts, 80 characters of each, the
    first five file names, and three photos for the cover (first, middle, last). Undated rows come last; lists are empty, not null.
    """
    n = tasks_of(members, faces)
    video = F.coalesce(F.col("mime_type"), F.lit("")).startswith("video/")
    by_time = [F.asc_nulls_last("taken_at"), F.asc("asset")]
    whole = Window.partitionBy("album")
    kind = Window.partitionBy("album", "video")
    placed = members.repartition(n, "album").withColumn("video", video).withColumns({"first": F.row_number().over(whole.orderBy(*by_time)), "place": F.row_number().over(kind.orderBy(*by_time)), "candidate": ~F.col("video") & spread_positions(kind.orderBy(*by_time), kind)})
    sums = placed.groupBy("album").agg(
        F.count("*").alias("assets"), F.count_if(~F.col("video")).alias("photos"), F.count_if("video").alias("videos"), F.min("taken_at").alias("since"), F.max("taken_at").alias("until"),
        in_order(F.col("first") <= 5, "first", F.regexp_extract("file_name", "([^/]*)$", 1)).alias("names"), in_order(F.col("candidate") & F.col("album").isNotNull(), "place", F.col("asset")).alias("covers"),
    )
    own = members.select("asset", "album").repartition(n, "asset")
    cities = own.join(places.filter("city <> ''"), "asset").select("album", "city", "country").repartition(n, "album").groupBy("album", "city", "country").agg(F.count("*").alias("n"))
    top_cities = top_per_group(cities, 3, ["album"], [F.desc("n"), F.asc("city"), F.asc("country")])
    met = own.join(faces.filter("name <> ''"), "asset").select("album", "person", "name", "asset").distinct()
    named = met.repartition(n, "album").groupBy("album", "person", "name").agg(F.count("*").alias("n"))
    top_people = top_per_group(named, 3, ["album"], [F.desc("n"), F.asc("name"), F.asc("person")])
    cut = texts if "sample" in texts.columns else sampled(texts)
    longest = top_per_group(own.join(cut, "asset").repartition(n, "album"), 3, ["album"], [F.desc("chars"), F.asc("asset")])
    parts = (
        _listed(top_cities, ["album"], F.struct("city", "country", "n"), "rank", "places"),
        _listed(top_people, ["album"], F.struct("name", "n"), "rank", "people"),
        _listed(longest, ["album"], F.col("sample"), "rank", "samples"),
    )
    out = sums
    for p in parts:
        out = out.join(p, "album", "left")
    lists = [F.coalesce(c, F.array().cast(p.schema[c].dataType)).alias(c) for p in parts for c in p.columns[1:]]
    return out.select(*sums.columns[:6], *lists, "names", "covers")


def cover_ratios(moments: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, ratio of moments (id, cover): width by height of the cover; moments whose cover has no valid size are absent."""
    valid = sizes.filter("width > 0 AND height > 0").select(F.col("asset").alias("cover"), (F.col("width") / F.col("height")).alias("ratio"))
    return moments.join(valid, "cover").select("id", "ratio")


def dangling_covers_cleared(people: DataFrame, faces: DataFrame) -> DataFrame:
    """people with a null cover where that face is gone."""
    there = faces.select(F.col("face").alias("__face")).distinct()
    joined = people.join(there, F.col("cover") == F.col("__face"), "left")
    return joined.withColumn("cover", F.col("__face")).select(*people.columns)


def sized_faces(faces: DataFrame, shown: DataFrame, sizes: DataFrame) -> DataFrame:
    """faces (face, asset, bbox as JSON, excluded) of known assets that are not excluded, with `ratio`: the shorter side of the box by
    that of the picture; null where either is unknown."""
    box = F.from_json("bbox", "x1 double, y1 double, x2 double, y2 double")
    sides = F.least(F.abs(F.col("__b.x2") - F.col("__b.x1")), F.abs(F.col("__b.y2") - F.col("__b.y1")))
    valid = sizes.filter("width > 0 AND height > 0").select("asset", F.least("width", "height").alias("__d"))
    kept = faces.filter("NOT excluded").join(shown.select("asset"), "asset", "left_semi").withColumn("__b", box)
    return kept.join(valid, "asset", "left").withColumn("ratio", sides / F.col("__d")).drop("__b", "__d")


def pruned_library(assets: DataFrame, vectors: DataFrame, texts: DataFrame, there: DataFrame, scanned: str, excluded: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """assets (asset, path, mime_type, deleted), vectors (asset) and texts (asset) after all prunings.

    Assets go whose file below `scanned` is not there any more (unless they are in the trash), which are in a `.snapshots` folder,
    or below an excluded mount; vectors and texts go with their asset, and videos have no texts.
    """
    known = there.select(F.col("path").alias("__p")).distinct()
    below = lambda root: F.col("path").startswith(root.rstrip("/") + "/")
    missing = below(scanned) & F.col("__p").isNull() & ~F.col("deleted")
    out = F.array_contains(F.split("path", "/"), ".snapshots")
    for root in excluded:
        out = out | below(root)
    kept = assets.join(known, F.col("path") == F.col("__p"), "left").filter(~missing & ~out).select(*assets.columns)
    pictures = kept.filter(~F.coalesce(F.col("mime_type"), F.lit("")).startswith("video/"))
    return kept, vectors.join(kept.select("asset"), "asset", "left_semi"), texts.join(pictures.select("asset"), "asset", "left_semi")
