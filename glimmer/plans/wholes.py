"""Summaries, covers, faces and prunings, each through one function over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.operators import library
from glimmer.operators.dealing import tasks_of
from glimmer.plans.registry import query

_MEMBERS = """m AS (SELECT o_custkey AS album, o_orderkey AS asset, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS taken, CASE WHEN o_orderkey % 5 = 0 THEN 'video/mp4' ELSE 'image/jpeg' END AS mime, '/lib/' || o_orderkey % 9 || '/IMG_' || o_orderkey || '.jpg' AS f FROM orders)"""


def _members(t):
    k = F.col("o_orderkey")
    return t("orders").select(
        F.col("o_custkey").alias("album"), k.alias("asset"), F.when(k % 13 != 0, F.col("o_orderdate")).alias("taken_at"), F.when(k % 5 == 0, "video/mp4").otherwise("image/jpeg").alias("mime_type"), F.concat(F.lit("/lib/"), k % 9, F.lit("/IMG_"), k, F.lit(".jpg")).alias("file_name")
    )


@query("AG-11 RM-02", f"""WITH {_MEMBERS},
places AS (SELECT album, string_agg(city || '/' || country || ':' || n, ',' ORDER BY r) AS x FROM (SELECT album, city, country, count(*) AS n, row_number() OVER (PARTITION BY album ORDER BY count(*) DESC, city, country) AS r FROM (SELECT album, 'c' || asset % 6 AS city, 'l' || asset % 2 AS country FROM m WHERE asset % 6 <> 0) GROUP BY 1, 2, 3) WHERE r <= 3 GROUP BY 1),
people AS (SELECT album, string_agg(name || ':' || n, ',' ORDER BY r) AS x FROM (SELECT album, name, count(DISTINCT asset) AS n, row_number() OVER (PARTITION BY album ORDER BY count(DISTINCT asset) DESC, name, person) AS r FROM (SELECT album, asset, l_suppkey AS person, 'n' || l_suppkey AS name FROM m JOIN lineitem ON l_orderkey = asset WHERE l_suppkey % 3 = 0) GROUP BY album, person, name) WHERE r <= 3 GROUP BY 1),
samples AS (SELECT album, string_agg(substr(text, 1, 80), '|' ORDER BY r) AS x FROM (SELECT album, text, row_number() OVER (PARTITION BY album ORDER BY length(text) DESC, asset) AS r FROM m JOIN documents ON doc_id = asset % (SELECT count(*) FROM documents) WHERE asset % 4 = 1 AND text <> '') WHERE r <= 3 GROUP BY 1),
t AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY taken NULLS LAST, asset) AS i FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY taken NULLS LAST, asset) AS i, count(*) OVER (PARTITION BY album) AS n FROM m WHERE mime NOT LIKE 'video/%'),
covers AS (SELECT album, string_agg(asset::VARCHAR, ',' ORDER BY i) AS x FROM p WHERE i IN (1, n // 2 + 1, n) GROUP BY 1)
SELECT t.album, count(*)::BIGINT AS assets, count(*) FILTER (mime NOT LIKE 'video/%')::BIGINT AS photos, count(*) FILTER (mime LIKE 'video/%')::BIGINT AS videos, strftime(min(taken), '%Y-%m-%d') AS since, strftime(max(taken), '%Y-%m-%d') AS until,
  coalesce(any_value(places.x), '') AS places, coalesce(any_value(people.x), '') AS people, coalesce(any_value(samples.x), '') AS samples, string_agg(regexp_extract(f, '([^/]*)$', 1), ',' ORDER BY i) FILTER (i <= 5) AS names, coalesce(any_value(covers.x), '') AS covers
FROM t LEFT JOIN places ON places.album = t.album LEFT JOIN people ON people.album = t.album LEFT JOIN samples ON samples.album = t.album LEFT JOIN covers ON covers.album = t.album GROUP BY 1""")
def album_summaries(t):
    """Albums in one: counts, span, cities, named people, longest texts, file names and covers."""
    own = _members(t)
    k = F.col("asset")
    places = own.select("asset", F.when(k % 6 != 0, F.concat(F.lit("c"), k % 6)).otherwise("").alias("city"), F.concat(F.lit("l"), k % 2).alias("country"))
    faces = t("lineitem").select(F.col("l_orderkey").alias("asset"), F.col("l_suppkey").alias("person"), F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("n"), "l_suppkey")).otherwise("").alias("name"))
    n = t("documents").count()
    asked = own.filter("asset % 4 = 1").select("asset", (k % n).alias("doc_id"))
    texts = asked.repartition(tasks_of(asked), "doc_id").join(library.sampled(t("documents").select("doc_id", "text")), "doc_id").select("asset", "chars", "sample")
    out = library.album_summary(own, places, faces, texts)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    joined = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return out.select(
        "album", "assets", "photos", "videos", day("since"), day("until"), joined("places", lambda p: F.concat(p["city"], F.lit("/"), p["country"], F.lit(":"), p["n"])), joined("people", lambda p: F.concat(p["name"], F.lit(":"), p["n"])),
        F.array_join("samples", "|").alias("samples"), F.array_join("names", ",").alias("names"), F.array_join("covers", ",").alias("covers"),
    )


_SIZES = "e AS (SELECT p_partkey AS asset, CASE WHEN p_size % 5 <> 0 THEN p_size * 100 END AS width, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 700 ELSE 0 END AS height FROM part WHERE p_partkey % 11 <> 0)"


def _sizes(t):
    k = F.col("p_partkey")
    return t("part").filter("p_partkey % 11 <> 0").select(k.alias("asset"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 100).alias("width"), F.when(k % 4 != 0, k % 700).otherwise(0).alias("height"))


@query("JN-25", f"WITH {_SIZES} SELECT o_orderkey AS id, round(width / height, 6) AS ratio FROM orders JOIN e ON asset = o_orderkey % 2500 WHERE width > 0 AND height > 0")
def cover_shapes(t):
    """Moments by the shape of their cover; those without a valid one are absent."""
    moments = t("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2500).alias("cover"))
    return library.cover_ratios(moments, _sizes(t)).select("id", F.round("ratio", 6).alias("ratio"))


@query("SNK-34", "SELECT s_suppkey AS person, CASE WHEN s_suppkey * 3 IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 4 <> 0) THEN s_suppkey * 3 END AS cover FROM supplier")
def covers_cleared(t):
    """Covers whose face vanished are cleared."""
    people = t("supplier").select(F.col("s_suppkey").alias("person"), (F.col("s_suppkey") * 3).alias("cover"))
    return library.dangling_covers_cleared(people, t("lineitem").filter("l_partkey % 4 <> 0").select(F.col("l_partkey").alias("face")))


@query("SRC-18", f"WITH {_SIZES} SELECT l_orderkey AS picture, l_linenumber AS face, round(least(abs(l_quantity), abs(l_quantity - l_tax * 100)) / CASE WHEN width > 0 AND height > 0 THEN least(width, height) END, 6) AS ratio FROM lineitem LEFT JOIN e ON asset = l_partkey WHERE l_suppkey % 7 <> 0 AND l_partkey % 9 <> 0")
def faces_read(t):
    """Faces of known pictures with the share of the shorter side that they take; boxes come as JSON, in either direction."""
    number = lambda c: F.format_string("%s", c)
    box = F.concat(F.lit('{"x1": '), number(F.lit(0.0)), F.lit(', "x2": '), number(F.col("l_quantity")), F.lit(', "y1": '), number(F.col("l_quantity")), F.lit(', "y2": '), number(F.col("l_tax") * 100), F.lit("}"))
    faces = t("lineitem").select(F.col("l_orderkey").alias("picture"), F.col("l_linenumber").alias("face"), F.col("l_partkey").alias("asset"), box.alias("bbox"), (F.col("l_suppkey") % 7 == 0).alias("excluded"))
    shown = t("part").filter("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("asset"))
    return library.sized_faces(faces, shown, _sizes(t)).select("picture", "face", F.round("ratio", 6).alias("ratio"))


@query("SNK-33", """WITH a AS (SELECT doc_id AS asset, CASE doc_id % 4 WHEN 0 THEN '/lib/.snapshots/' WHEN 1 THEN '/mnt/out/' ELSE '/lib/' END || doc_id AS path, doc_id % 6 = 0 AS video, doc_id % 15 = 0 AS deleted, lang FROM documents),
k AS (SELECT * FROM a WHERE asset % 4 > 1 AND (lang <> 'de' OR deleted))
SELECT 'asset' AS kind, asset FROM k UNION ALL SELECT 'vector', asset FROM k WHERE asset % 2 = 0 UNION ALL SELECT 'text', asset FROM k WHERE NOT video""")
def library_pruned(t):
    """All prunings: missing files, snapshots, an excluded mount, vectors without assets, and texts of videos."""
    k = F.col("doc_id")
    path = F.concat(F.when(k % 4 == 0, "/lib/.snapshots/").when(k % 4 == 1, "/mnt/out/").otherwise("/lib/"), k)
    rows = t("documents").select(k.alias("asset"), path.alias("path"), F.when(k % 6 == 0, "video/mp4").otherwise("image/png").alias("mime_type"), (k % 15 == 0).alias("deleted"), "lang")
    own, vectors, texts = library.pruned_library(rows.drop("lang"), rows.filter("asset % 2 = 0").select("asset"), rows.select("asset"), rows.filter("lang <> 'de'").select("path"), "/lib", ["/mnt/out"])
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "asset")
    return kind(own, "asset").unionByName(kind(vectors, "vector")).unionByName(kind(texts, "text"))
