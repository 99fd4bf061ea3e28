"""Details, guards, queues and small reports, each through the function that it shows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.functions import predicates
from glimmer.operators import clustering, geo, machines, people, sequences, sync, vectors
from glimmer.operators.naming import numbered
from glimmer.plans.places import _MEMBERS_OF_SPOTS, _SPOTS
from glimmer.plans.places import _SQL as _PLACES
from glimmer.plans.places import _cities, _photos, _points
from glimmer.plans.registry import query
from glimmer.plans.similarity import _COMPONENTS, _COS, _V
from glimmer.sources import files, walks
from glimmer.store import shared_folder, written

_TWINS = """WITH RECURSIVE v AS (SELECT vec_id, vec_id % 40 AS burst, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT vec_id + 1000000, vec_id % 40, list_concat((embedding::DOUBLE[])[1:60], [0.0, 0.0, 0.0, 0.0]) FROM embeddings WHERE vec_id % 3 = 0),"""


@query("VEC-16", f"""{_TWINS} links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.burst = y.burst AND x.vec_id <> y.vec_id WHERE 1 - ({_COS.format(a='x.e', b='y.e')}) > 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT vec_id, b FROM reach JOIN links ON r = a) SELECT vec_id AS id, min(r) AS "group" FROM reach GROUP BY 1""")
def burst_duplicates(t):
    """Pictures of a burst that are nearly alike; every third one has a twin with its last four dimensions at zero."""
    rows = t("embeddings").select("vec_id", (F.col("vec_id") % 40).alias("burst"), F.col("embedding").cast("array<double>").alias("e"))
    twins = rows.filter("vec_id % 3 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "burst", F.concat(F.slice("e", 1, 60), F.array(*[F.lit(0.0)] * 4)).alias("e"))
    return clustering.burst_groups(rows.unionByName(twins), "vec_id", "e", ["burst"], 0.95)


@query("AG-11 RM-02", """WITH m AS (SELECT o_custkey AS album, o_orderkey AS asset, o_orderdate AS taken, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
p AS (SELECT album, string_agg(person::VARCHAR, ',' ORDER BY r) AS people FROM (SELECT album, l_suppkey AS person, row_number() OVER (PARTITION BY album ORDER BY count(DISTINCT asset) DESC, l_suppkey) AS r FROM m JOIN lineitem ON l_orderkey = asset GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1)
SELECT album, count(*)::BIGINT AS assets, strftime(min(taken), '%Y-%m-%d') AS since, strftime(max(taken), '%Y-%m-%d') AS until, any_value(people) AS people,
  string_agg('IMG_' || asset || '.jpg', ',' ORDER BY i) FILTER (i <= 5) AS names, string_agg(asset::VARCHAR, ',' ORDER BY i) FILTER (i IN (1, n // 2 + 1, n)) AS covers FROM m LEFT JOIN p USING (album) GROUP BY 1""")
def album_detail(t):
    """Of each album: its span, the three people that are on most pictures, the first five file names, and candidates for the cover."""
    members = t("orders").select(F.col("o_custkey").alias("album"), F.col("o_orderkey").alias("asset"), F.col("o_orderdate").alias("taken_at"), F.concat(F.lit("IMG_"), "o_orderkey", F.lit(".jpg")).alias("file_name"))
    faces = t("lineitem").select(F.col("l_orderkey").alias("asset"), F.col("l_suppkey").alias("person"))
    out = people.album_detail(members, faces)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("album", "assets", day("since"), day("until"), F.array_join("people", ",").alias("people"), F.array_join("names", ",").alias("names"), F.array_join("covers", ",").alias("covers"))


_PEOPLE = "p AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'n' || s_suppkey ELSE '' END AS name, s_suppkey % 5 = 2 AS favorite, s_suppkey % 7 = 6 AS hidden, s_suppkey % 10 / 10.0 AS confidence FROM supplier), c AS (SELECT l_suppkey AS id, count(DISTINCT l_orderkey) AS assets FROM lineitem GROUP BY 1)"


def _people(t):
    k = F.col("s_suppkey")
    own = t("supplier").select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("n"), k)).otherwise("").alias("name"), (k % 5 == 2).alias("favorite"), (k % 7 == 6).alias("hidden"), (k % 10 / 10.0).alias("confidence"), F.lit(None).cast("string").alias("relation"))
    return own, t("lineitem").select(F.col("l_orderkey").alias("asset"), F.col("l_suppkey").alias("person"))


@query("SRT-09 Q-03 RM-03", f"""WITH {_PEOPLE} SELECT id, name, assets::BIGINT AS assets, row_number() OVER (ORDER BY (name <> '' OR favorite) DESC, assets DESC, id) AS place FROM p JOIN c USING (id) WHERE NOT hidden AND (name <> '' OR favorite OR confidence >= 0.4) ORDER BY place LIMIT 50""")
def people_in_blocks(t):
    """Named people and favourites come first, then by the number of pictures; hidden and doubtful ones are left out."""
    own, faces = _people(t)
    page = people.listed(own, faces, 0.4).limit(50)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*people.order())).cast("long")).select("id", "name", "assets", "place")


@query("FLT-14 Q-03", f"WITH {_PEOPLE} SELECT DISTINCT l_suppkey AS person, l_orderkey AS asset FROM lineitem JOIN p ON id = l_suppkey WHERE NOT hidden AND l_suppkey IN (3, 6, 13, 20, 27)")
def guarded_people(t):
    """Pictures of people that are asked for by id; hidden and unknown ones give none."""
    own, faces = _people(t)
    asked = own.sparkSession.createDataFrame([(i,) for i in (3, 6, 13, 20, 27, 999_999)], "id long")
    return people.shown(own, asked).join(faces, F.col("id") == F.col("person")).select("person", "asset").distinct()


@query("JN-08 Q-03", """WITH g AS (SELECT o_orderkey, c_nationkey AS city, o_orderkey % 10 AS lat, o_orderkey % 5 AS lon FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT l_suppkey AS person, city, count(DISTINCT o_orderkey)::BIGINT AS assets FROM lineitem JOIN g ON o_orderkey = l_orderkey WHERE NOT (lat = 0 AND lon = 0) GROUP BY 1, 2""")
def people_places(t):
    """Where people's pictures were taken; places at (0, 0) are none."""
    place = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("asset"), F.col("c_nationkey").alias("city"), (F.col("o_orderkey") % 10).alias("lat"), (F.col("o_orderkey") % 5).alias("lon"))
    return people.places(t("lineitem").select(F.col("l_orderkey").alias("asset"), F.col("l_suppkey").alias("person")), place)


@query("SRT-05", "SELECT user_id, item, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last DESC, item) AS r FROM (SELECT user_id, floor(value)::INT % 20 AS item, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY 1, 2)) WHERE r <= 5")
def most_viewed(t):
    views = t("events").filter("event_type = 'view'").select("user_id", (F.floor("value").cast("int") % 20).alias("item"), "ts")
    counts = sync.count_events(views, ["user_id", "item"], "ts", "n", "last")
    return sequences.top_per_group(counts, 5, ["user_id"], [F.desc("n"), F.desc("last"), F.asc("item")]).select("user_id", "item", "n")


@query("SRT-10", f"WITH {_V}, q AS (SELECT e AS qe FROM v WHERE vec_id = 0) SELECT vec_id FROM v, q WHERE label % 2 = 1 ORDER BY sqrt(list_sum(list_transform(list_zip(e, qe), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), vec_id LIMIT 30")
def nearest_filtered(t):
    """A full page of neighbours that meet a filter: it comes before the search, so nothing has to be fetched beyond the page."""
    rows = t("embeddings")
    asked = rows.filter("vec_id = 0").select(F.col("embedding").alias("asked"))
    odd = rows.filter("label % 2 = 1").crossJoin(F.broadcast(asked))
    return vectors.nearest(odd, "embedding", F.col("asked"), predicates.clamp_limit(30, 50, 2000), "vec_id").select("vec_id")


@query("FLT-15 SRT-12", "(SELECT 'page' AS part, o_orderkey AS id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate < TIMESTAMP '1996-07-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 500) UNION ALL (SELECT 'recent', s_suppkey FROM supplier WHERE s_suppkey % 7 = 6 ORDER BY s_acctbal DESC, s_suppkey LIMIT 50)")
def clamped_pages(t):
    """A month's page and the hidden people last changed, with limits and offsets out of range."""
    page = t("orders").filter((F.col("o_orderdate") >= F.lit("1996-06-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-07-01").cast("timestamp_ntz")))
    month = page.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(predicates.clamp_offset(-3)).limit(predicates.clamp_limit(9999, 500)).select(F.lit("page").alias("part"), F.col("o_orderkey").alias("id"))
    hidden = t("supplier").filter("s_suppkey % 7 = 6").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(predicates.clamp_limit(0, 50)).select(F.lit("recent").alias("part"), F.col("s_suppkey").alias("id"))
    return month.unionByName(hidden)


_SWEEP = _COMPONENTS.format(e="{e}") + """ , s AS (SELECT label, cluster, count(*) AS k FROM c JOIN v USING (vec_id) GROUP BY 1, 2),
l AS (SELECT label, max(k) * 1.0 / sum(k) AS recall, count(*) AS parts FROM s GROUP BY 1), g AS (SELECT cluster, max(k) * 1.0 / sum(k) AS purity, sum(k) AS size FROM s GROUP BY 1)
SELECT {e}::DOUBLE AS epsilon, (SELECT round(avg(recall), 6) FROM l) AS recall, (SELECT round(avg(parts), 6) FROM l) AS fragments, (SELECT round(avg(purity), 6) FROM g) AS purity,
  (SELECT count(*) FROM g)::BIGINT AS clusters, (SELECT max(size) FROM g)::BIGINT AS largest, coalesce((SELECT max(size) FILTER (r = 2) FROM (SELECT size, row_number() OVER (ORDER BY size DESC) AS r FROM g)), 0)::BIGINT AS second, (SELECT coalesce(sum(size) FILTER (size >= 3), 0) FROM g)::BIGINT AS gated"""


@query("AG-28 VEC-25 Q-12 RM-17", " UNION ALL ".join(f"SELECT * FROM ({_SWEEP.format(e=e)})" for e in (0.58, 0.62)))
def cluster_study(t):
    """For each radius: recall, fragments and purity against the labels, sizes of the largest two clusters, and rows in clusters of three at least."""
    rows = t("embeddings")
    radii, out = [0.58, 0.62], None
    links = written(vectors.similar_links(rows, "vec_id", "embedding", radii), "links")
    for k, e in enumerate(radii):
        labels = clustering.density_clusters(rows.select(F.col("vec_id").alias("id")), links.filter(F.col("radius") == k))
        row = clustering.evaluated(labels.join(rows.select(F.col("vec_id").alias("id"), "label"), "id"), "label", "cluster", 3).withColumn("epsilon", F.lit(e))
        out = row if out is None else out.unionByName(row)
    return out.select("epsilon", *[F.round(c, 6).alias(c) for c in ("recall", "fragments", "purity")], "clusters", "largest", "second", "gated")


@query("VEC-24", _COMPONENTS.format(e=0.62) + " SELECT cluster, n::BIGINT AS size FROM (SELECT cluster, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, cluster) AS r FROM c GROUP BY 1) WHERE r <= 2")
def largest_clusters(t):
    rows = t("embeddings")
    labels = clustering.density_clusters(rows.select(F.col("vec_id").alias("id")), vectors.similar_links(rows, "vec_id", "embedding", [0.62]))
    return labels.groupBy("cluster").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "cluster").limit(2)


@query("VEC-15", f"""WITH {_V}, dims AS (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v) GROUP BY 1, 2), k AS (SELECT label, list(m ORDER BY i) AS c FROM dims GROUP BY 1),
s AS (SELECT label, vec_id, CASE WHEN label % 2 = 0 AND vec_id % 5 = 0 THEN vec_id % 100 / 100.0 ELSE -1 END AS score, round({_COS.format(a='e', b='c')}, 9) AS d FROM v JOIN k USING (label))
SELECT label AS person, CASE WHEN max(score) >= 0 THEN arg_max(vec_id, [score, -vec_id]) ELSE arg_min(vec_id, [d, vec_id]) END AS cover, max(score) < 0 AS by_centroid FROM s GROUP BY 1""")
def covers_or_nearest(t):
    """The best-scored face of a person; where none can be scored, the one nearest to the person's centroid."""
    rows = t("embeddings").withColumn("score", F.when((F.col("label") % 2 == 0) & (F.col("vec_id") % 5 == 0), F.col("vec_id") % 100 / 100.0).otherwise(-1.0))
    return people.covers(rows, "label", "vec_id", "embedding", "score").select(F.col("label").alias("person"), "cover", "by_centroid")


@query("ST-01 SRC-09", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type IN ('purchase', 'error') AS ends, event_type = 'purchase' AS named, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, 0::BIGINT AS i, false AS busy, (-1)::BIGINT AS until, NULL::BIGINT AS event_id, false AS taken FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT w.user_id, e.i, NOT ends AND (busy OR t >= until), CASE WHEN ends AND busy THEN t + CASE WHEN named THEN 21600000000 ELSE 0 END ELSE until END, e.event_id, NOT ends AND NOT busy AND t >= until FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT event_id FROM w WHERE taken""")
def echoes_suppressed(t):
    """A user's requests while one is worked on are echoes, and for six hours after the end of work that a batch names (a purchase here); an error lets go at once."""
    kind = F.col("event_type")
    return machines.served(t("events"), "user_id", F.col("ts"), "event_id", ~kind.isin("purchase", "error"), kind == "purchase", 6 * 3600.0).select(F.col("id").alias("event_id"))


@query("ST-06", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS ran, NULL::BIGINT AS waits, 0::BIGINT AS merged, NULL::BIGINT AS fired, NULL::BIGINT AS fired_at, NULL::BIGINT AS fired_n, NULL::BIGINT AS own, NULL::BIGINT AS own_at FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT user_id, i, CASE WHEN now THEN t ELSE since END, CASE WHEN NOT now THEN event_id END, CASE WHEN now THEN 0 WHEN fire THEN 1 ELSE merged + 1 END, CASE WHEN fire THEN waits END, CASE WHEN fire THEN since END, CASE WHEN fire THEN merged END, CASE WHEN now THEN event_id END, CASE WHEN now THEN t END
  FROM (SELECT *, since IS NULL OR t >= since + 43200000000 AS now FROM (SELECT w.user_id, e.i, e.t, e.event_id, waits, merged, waits IS NOT NULL AND t >= ran + 43200000000 AS fire, CASE WHEN waits IS NOT NULL AND t >= ran + 43200000000 THEN ran + 43200000000 ELSE ran END AS since FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))),
runs AS (SELECT user_id, fired AS request, fired_at AS run_at, fired_n AS n FROM w UNION ALL SELECT user_id, own, own_at, 1 FROM w
  UNION ALL SELECT user_id, waits, ran + 43200000000, merged FROM w QUALIFY i = max(i) OVER (PARTITION BY user_id))
SELECT user_id AS chain, request, run_at, n AS coalesced FROM runs WHERE request IS NOT NULL""")
def runs_coalesced(t):
    """A chain runs at most once in twelve hours; requests meanwhile wait, and the latest runs for all of them."""
    runs = machines.throttled(t("events"), "user_id", F.col("ts"), "event_id", 12 * 3600.0)
    return runs.select(F.col("user_id").alias("chain"), F.col("id").alias("request"), F.col("at").alias("run_at"), F.col("merged").alias("coalesced"))


@query("ST-07", """WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS due FROM g GROUP BY user_id, s HAVING arg_max(event_type, ts) <> 'error'""")
def clustering_due(t):
    """Work starts once arrivals have been quiet for a while, unless something is pending then (here: the last one failed)."""
    quiet = sequences.quiet_periods(t("events"), ["user_id"], "ts", "12 hours", F.col("event_type") == "error")
    return quiet.filter("NOT pending").select("user_id", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"))


@query("AG-30", "SELECT o_custkey AS album FROM orders GROUP BY 1 HAVING count(*) >= 2 AND (o_custkey % 3 = 0 OR (min(o_orderkey % 4) = 0 AND max(o_orderkey % 4) = 0))")
def unplaced_albums(t):
    """Albums of two members at least whose places are all 0: they were never put in order."""
    members = t("orders").select(F.col("o_custkey").alias("album"), F.when(F.col("o_custkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 4).alias("position"))
    return sequences.unplaced(members, ["album"], "position").select("album")


@query("SET-06 SNK-10", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders WHERE o_custkey = 7")
def album_put_in_order(t):
    """One album in the order that a user gives; any other list than a permutation of its members is refused."""
    members = t("orders").filter("o_custkey = 7").select(F.col("o_orderkey").alias("id"), F.lit(0).cast("long").alias("position"), "o_totalprice")
    wish = numbered(members.select("id", (-F.col("o_totalprice")).alias("price")), [], ["price", "id"])  # what a user sends, of one album
    return sync.reordered(members.select("id", "position"), wish.select("id", (F.col("place") - 1).alias("place")), "id").select("id", "position")



_PATH = "CASE page_id % 4 WHEN 0 THEN '/a/.snapshots/' ELSE '/a/b/' END || page_id || CASE page_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.txt' WHEN 3 THEN '.png' ELSE '' END"


def _paths(t):
    k = F.col("page_id")
    tail = F.when(k % 5 == 0, ".JPG").when(k % 5 == 1, ".mp4").when(k % 5 == 2, ".txt").when(k % 5 == 3, ".png").otherwise("")
    return t("pages").select("page_id", F.concat(F.when(k % 4 == 0, "/a/.snapshots/").otherwise("/a/b/"), k, tail).alias("path"), F.length("html").cast("long").alias("size"), (k % 6).alias("modified"))


@query("FLT-12 FLT-13 SRC-02", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/mp4' ELSE 'image/png' END AS mime_type, length(html) * 1000 > 20000000 AS oversize FROM pages WHERE page_id % 4 <> 0 AND page_id % 5 NOT IN (2, 4)")
def supported_media(t):
    """Supported files outside snapshots, and whether their pixels are more than a model takes."""
    rows = _paths(t).filter(~predicates.in_folder(F.col("path"), ".snapshots")).withColumn("mime_type", files.mime_type(F.col("path"))).filter("mime_type IS NOT NULL")
    return rows.select("page_id", "mime_type", files.oversize(F.col("size"), F.lit(1000), 20_000_000).alias("oversize"))


_TREE = "'/' || page_id % 7 || CASE page_id % 4 WHEN 0 THEN '/.snapshots' WHEN 1 THEN '/deep/er' ELSE '' END || CASE page_id % 6 WHEN 0 THEN '/left out' ELSE '' END || '/' || page_id || CASE page_id % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.mp4' WHEN 2 THEN '.txt' WHEN 3 THEN '.png' ELSE '' END"


@query("SRC-01", f"SELECT {_TREE} AS path, length(html) % 100 AS size, CASE page_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/mp4' ELSE 'image/png' END AS mime_type FROM pages WHERE page_id % 4 <> 0 AND NOT (page_id % 6 = 0 AND page_id % 7 = 3 AND page_id % 4 > 1) AND page_id % 5 NOT IN (2, 4)")
def folders_walked(t):
    """A tree of files, one for each page, and the walk through it: hidden folders and an excluded one are not entered."""
    k, pages = F.col("page_id"), t("pages")
    root = shared_folder(pages.sparkSession, "tree")
    root = root if "://" in root else f"file://{root}"
    tail = F.when(k % 5 == 0, ".JPG").when(k % 5 == 1, ".mp4").when(k % 5 == 2, ".txt").when(k % 5 == 3, ".png").otherwise("")
    below = F.concat(F.when(k % 4 == 0, "/.snapshots").when(k % 4 == 1, "/deep/er").otherwise(""), F.when(k % 6 == 0, "/left out").otherwise(""))
    path = F.concat(F.lit(f"{root}/"), k % 7, below, F.lit("/"), k, tail)
    rows = pages.select(path.alias("path"), F.repeat(F.lit("x"), (F.length("html") % 100).cast("int")).cast("binary").alias("content"))
    written(walks.put_files(rows, "path", "content").select("path"), "put")
    found = walks.media_files(pages.sparkSession, [root], (f"{root}/3/left out",))
    return found.select(F.substr("path", F.lit(len(root) + 1)).alias("path"), "size", "mime_type")


@query("SRC-03", f"""WITH f AS (SELECT {_PATH} AS path, length(html) AS size, page_id % 6 AS m, page_id FROM pages)
SELECT path, CASE WHEN page_id % 3 = 0 THEN 'add' WHEN page_id % 7 = 1 THEN 'drop' ELSE 'again' END AS action FROM f WHERE page_id % 3 = 0 AND page_id % 7 <> 1 OR page_id % 3 <> 0 AND (page_id % 7 = 1 OR page_id % 11 = 0)""")
def folder_scanned(t):
    """A folder's files against the catalogue: new ones, changed ones, and those that went."""
    rows = _paths(t)
    catalog = rows.filter("page_id % 3 <> 0").withColumn("modified", F.when(F.col("page_id") % 11 == 0, -1).otherwise(F.col("modified")))
    return files.scan_difference(rows.filter("page_id % 7 <> 1"), catalog)


@query("SRC-07 SRC-08", "SELECT event_id, '/in/' || event_id || '-' || i || '.jpg' AS path FROM events, (SELECT unnest([1, 2]) AS i) WHERE event_type = 'click'")
def bus_messages(t):
    """Paths of "created" messages, a JSON list within a string of the message; others and broken ones give none."""
    k = F.col("event_id").cast("string")
    paths = F.to_json(F.array(F.concat(F.lit("/in/"), k, F.lit("-1.jpg")), F.concat(F.lit("/in/"), k, F.lit("-2.jpg")), F.lit("")))
    message = F.to_json(F.struct(F.when(F.col("event_type") == "click", "created").otherwise("deleted").alias("name"), F.struct(paths.alias("paths")).alias("properties")))
    rows = t("events").select("event_id", F.when(F.col("event_type") == "error", "{broken").otherwise(message).alias("value"))
    return files.event_paths(rows, "created").select("event_id", "path")


@query("SRC-12", "SELECT event_id, round(value * 10)::BIGINT * 100 AS duration_ms, 'h264' AS video_codec, (event_id % 50)::DOUBLE AS frame_rate, ((event_id * 90) % 360)::INT AS rotation FROM events")
def video_probed(t):
    k = F.col("event_id")
    stream = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.concat((k % 50).cast("string"), F.lit("/1")).alias("avg_frame_rate"), F.array(F.struct((k * 90 - 360 * 5).cast("double").alias("rotation"))).alias("side_data_list"))
    text = F.to_json(F.struct(F.array(stream).alias("streams"), F.struct((F.round(F.col("value") * 10).cast("long") / 10).cast("string").alias("duration")).alias("format")))
    out = files.video_probe(t("events").select("event_id", text.alias("json")))
    return out.select("event_id", (F.round(F.col("duration_ms") / 100.0).cast("long") * 100).alias("duration_ms"), "video_codec", "frame_rate", "rotation")


@query("RM-10", """SELECT 'pending' AS queue, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'faces', o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 = 0
UNION ALL SELECT 'sprites', o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'captions', o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 5 = 0""")
def work_queues(t):
    """What waits for each kind of work: an asset may wait in several queues."""
    k = F.col("o_orderkey")
    assets = t("orders").select(k.alias("id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("indexed").alias("status"), (k % 3 != 0).alias("face_scanned"), (k % 5 != 0).alias("caption_synced"), (F.col("o_orderpriority") == "1-URGENT").alias("video"))
    return people.queues(assets, t("lineitem").select(F.col("l_orderkey").alias("id")))


@query("RM-16", f"WITH {_PLACES} SELECT id, arg_min(key, [round(km, 9), key])::BIGINT AS key FROM near WHERE close AND key % 2 = 0 GROUP BY 1")
def nearest_landmark(t):
    """The nearest landmark of the cells around, and none for points without any there."""
    return geo.nearest(_points(t).drop("iso2"), _cities(t).filter("key % 2 = 0").select("key", "t_lat", "t_lon"), fallback=False).select("id", "key")


@query("RM-18 VEC-26", """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 100 - 50) / 100.0 END AS margin, doc_id % 11 / 10.0 AS lines FROM documents)
SELECT doc_id, round(CASE WHEN margin IS NULL THEN greatest(0, least(1, lines)) ELSE 0.65 * greatest(0, least(1, (margin + 0.5) / 1.0)) + 0.35 * greatest(0, least(1, lines)) END, 6) AS score FROM m""")
def verdicts_with_gaps(t):
    """Verdicts on documents, from the layout of their lines alone where there is no vector or no prompt of this generation."""
    k = F.col("doc_id")
    layout = t("documents").select("doc_id", (k % 11 / 10.0).alias("regularity"))
    margins = t("documents").filter("doc_id % 3 <> 0").select("doc_id", ((k % 100 - 50) / 100.0).alias("margin"))
    old = t("documents").filter("doc_id % 3 = 0").select("doc_id", F.lit(9.0).alias("margin"))
    cached = margins.withColumn("generation", F.lit(2)).unionByName(old.withColumn("generation", F.lit(1)))
    return people.verdicts(layout, cached, 2, -0.5, 0.5).select("doc_id", F.round("score", 6).alias("score"))


@query("Q-05 GEO-10", """WITH p AS (SELECT c_nationkey AS city, o_orderkey AS id, o_orderdate AS at_, year(o_orderdate) AS y FROM orders JOIN customer ON c_custkey = o_custkey),
g AS (SELECT *, CASE WHEN at_ - lag(at_) OVER (PARTITION BY city ORDER BY at_, id) <= INTERVAL 10 DAY THEN 0 ELSE 1 END AS fresh FROM p)
SELECT city, count(*)::BIGINT AS photos, sum(fresh)::BIGINT AS visits, count(DISTINCT y)::BIGINT AS years, mode_y AS busiest, CASE WHEN sum(fresh) >= 5 THEN 'often' WHEN sum(fresh) > 1 THEN 'again' ELSE 'once' END AS insight
FROM g JOIN (SELECT city AS k, arg_max(y, (n, y)) AS mode_y FROM (SELECT city, y, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1) ON k = city GROUP BY city, mode_y""")
def place_details(t):
    """A place's pictures, visits (parted by ten days), years, and what can be said of it by rule."""
    return people.place_details(_photos(t), 10).select("city", "photos", "visits", "years", "busiest", "insight")


@query("GEO-05 GEO-07", _SPOTS + _MEMBERS_OF_SPOTS)
def spots_of_cities(t):
    """Spots within cities: pictures, newest first, join the nearest spot within 300 m of its running centre, or open one."""
    return geo.greedy_spots(_photos(t)).select("city", "id", "spot", "members")
