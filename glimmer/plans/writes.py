"""Sinks: tables written to a shared folder, changed there, and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.operators import machines, sync, tables
from glimmer.operators.manifests import Folder
from glimmer.operators.sequences import best_row, unique_names
from glimmer.operators.vectors import constant, linear_head
from glimmer.plans.registry import query
from glimmer.store import shared_folder, written


def _new(rows, name):
    """A table's first version, and its folder."""
    path = shared_folder(rows.sparkSession, name)
    tables.put(rows, path)
    return path


@query("SNK-03", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS writer, CASE WHEN vec_id % 2 = 0 THEN round(2 * e[1] / sqrt(list_dot_product(e, e)) + 0.5, 6) END AS score FROM v WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0""")
def vectors_written(t):
    """Vectors that are known are updated, others inserted, each with its score."""
    rows = t("embeddings").select("vec_id", "embedding")
    path = _new(rows.filter("vec_id % 3 <> 0").withColumn("writer", F.lit("old")).withColumn("score", F.lit(None).cast("double")), "vectors")
    weights = constant([2.0] + [0.0] * 63)
    tables.upsert(path, rows.filter("vec_id % 2 = 0").withColumn("writer", F.lit("new")).withColumn("score", linear_head(F.col("embedding"), weights, 0.5)), ["vec_id"])
    return tables.current(rows.sparkSession, path).select("vec_id", "writer", F.round("score", 6).alias("score"))


@query("SNK-04", """SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 1 ELSE len(string_split(text, chr(10))) END::BIGINT AS line_count, sha256(CASE WHEN doc_id % 4 = 2 THEN 'old' ELSE text END) AS text FROM documents WHERE doc_id % 4 <> 3""")
def recognized_text_written(t):
    """A document's lines are replaced by those found now, and its header is made of them."""
    docs = t("documents").select("doc_id", "text")
    path = _new(docs.filter("doc_id % 2 = 0").select("doc_id", F.lit(0).alias("line_no"), F.lit("old").alias("line")), "lines")
    found = docs.filter("doc_id % 4 < 2")
    tables.replace_children(path, found, found.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")), "doc_id")
    lines = tables.current(docs.sparkSession, path)
    header = lines.groupBy("doc_id").agg(F.count("*").alias("line_count"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return header.select("doc_id", "line_count", F.sha2(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), 256).alias("text"))


@query("SNK-28 RM-08", "SELECT 'tag' AS kind, lang AS key, count(*)::BIGINT AS n FROM documents GROUP BY 2 UNION ALL SELECT 'site', source, count(*)::BIGINT FROM documents WHERE n_chars > 500 GROUP BY 2")
def entities_replaced(t):
    """All entities of one kind are replaced; the partition of the other kind isn't touched."""
    count = lambda rows, kind, c: rows.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    docs = t("documents")
    path = shared_folder(docs.sparkSession, "entities")
    tables.replace_partitions(path, count(docs, "tag", "lang").unionByName(count(docs, "site", "source")), "kind")
    tables.replace_partitions(path, count(docs.filter("n_chars > 500"), "site", "source"), "kind")
    return docs.sparkSession.read.parquet(path).select("kind", "key", "n")


@query("SNK-25", "SELECT n_nationkey AS key, CASE WHEN n_nationkey % 5 = 1 THEN 'given' WHEN n_nationkey % 3 = 0 THEN 'mine' ELSE n_name END AS title FROM nation")
def recipes_seeded(t):
    """Defaults come where no recipe has the key; given ones are put over what is there."""
    rows = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("title"))
    path = _new(rows.filter("key % 3 = 0").withColumn("title", F.lit("mine")), "recipes")
    tables.insert_absent(path, rows, ["key"])
    tables.upsert(path, rows.filter("key % 5 = 1").withColumn("title", F.lit("given")), ["key"])
    return tables.current(rows.sparkSession, path)


@query("SNK-26", """WITH o AS (SELECT o_custkey AS moment, o_orderkey AS asset, o_orderkey + 5 AS added_at, o_orderkey % 14 = 0 AS manual FROM orders WHERE o_orderkey % 2 = 0), d AS (SELECT o_custkey AS moment, o_orderkey AS asset, o_orderkey % 100 / 100.0 AS score FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(o.moment, d.moment) AS moment, coalesce(o.asset, d.asset) AS asset, score, added_at, coalesce(manual, false) AS manual FROM o FULL OUTER JOIN d ON o.moment = d.moment AND o.asset = d.asset WHERE d.asset IS NOT NULL OR manual""")
def moments_synced(t):
    """Members that stay keep the time they were added; pinned ones stay although they are not drafted."""
    own = t("orders").select(F.col("o_custkey").alias("moment"), F.col("o_orderkey").alias("asset"))
    path = _new(own.filter("asset % 2 = 0").select("*", F.lit(None).cast("double").alias("score"), (F.col("asset") + 5).alias("added_at"), (F.col("asset") % 14 == 0).alias("manual")), "members")
    drafted = own.filter("asset % 3 = 0").withColumn("score", F.col("asset") % 100 / 100.0)
    tables.put(sync.sync_members(tables.current(own.sparkSession, path), drafted, ["moment", "asset"]), path)
    return tables.current(own.sparkSession, path)


@query("SNK-26 RM-19", """WITH o AS (SELECT o_custkey AS moment, o_orderkey AS asset, o_orderkey % 14 = 0 AS manual FROM orders WHERE o_orderkey % 2 = 0), d AS (SELECT o_custkey AS moment, o_orderkey AS asset FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey % 10 <> 4),
m AS (SELECT coalesce(o.moment, d.moment) AS moment, coalesce(o.asset, d.asset) AS asset FROM o FULL OUTER JOIN d ON o.moment = d.moment AND o.asset = d.asset WHERE d.asset IS NOT NULL OR manual),
old AS (SELECT DISTINCT moment FROM o), new AS (SELECT moment, count(*) AS n FROM d GROUP BY 1)
SELECT m.moment, CASE WHEN old.moment IS NOT NULL AND m.moment % 4 = 0 THEN 'told ' || m.moment WHEN n IS NOT NULL THEN 'of ' || n ELSE 'plain ' || m.moment END AS title, count(*)::BIGINT AS members
FROM m LEFT JOIN old ON old.moment = m.moment LEFT JOIN new ON new.moment = m.moment GROUP BY ALL""")
def moments_committed(t):
    """Moments and their members change in one commit: told titles stay, pinned members stay, moments without any go."""
    own = t("orders").select(F.col("o_custkey").alias("moment"), F.col("o_orderkey").alias("asset"))
    folder = Folder(own.sparkSession, shared_folder(own.sparkSession, "moments"))
    stored = own.filter("asset % 2 = 0")
    told = F.col("moment") % 4 == 0
    folder.commit(lambda s: {
        "moments": stored.select("moment").distinct().select("moment", F.concat(F.when(told, "told ").otherwise("plain "), "moment").alias("title"), told.alias("told")),
        "members": stored.select("*", F.lit(None).cast("double").alias("score"), (F.col("asset") + 5).alias("added_at"), (F.col("asset") % 14 == 0).alias("manual")),
    })
    drafted = own.filter("asset % 3 = 0 AND moment % 10 <> 4").withColumn("score", F.lit(0.5))

    def sync_both(s):
        members = sync.sync_members(s.table("members"), drafted, ["moment", "asset"])
        drafts = drafted.groupBy("moment").agg(F.concat(F.lit("of "), F.count("*")).alias("title")).withColumn("told", F.lit(False))
        titled = sync.upsert(s.table("moments"), drafts, ["moment"], {"title": F.when(F.col("old.told"), F.col("old.title")).otherwise(F.col("new.title")), "told": F.col("old.told")})
        return {"members": members, "moments": titled.join(members.select("moment").distinct(), "moment", "left_semi")}

    now = folder.commit(sync_both)
    counts = now.table("members").groupBy("moment").agg(F.count("*").alias("members"))
    return now.table("moments").join(counts, "moment").select("moment", "title", "members")


@query("SNK-27", """WITH r AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) * 10 AS sort_order FROM customer WHERE c_nationkey = 3)
SELECT c_custkey AS id, sort_order::BIGINT AS sort_order, c_custkey % 7 = 0 AS hidden, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 10 <> 0 THEN 'title ' || c_custkey ELSE c_name END AS title FROM customer LEFT JOIN r ON id = c_custkey""")
def moments_edited(t):
    """Places by tens of those that a user put in order, hidden ones, and titles unless blank."""
    rows = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(False).alias("hidden"), "c_nationkey", "c_acctbal")
    path = _new(rows.select("id", F.lit(None).cast("long").alias("sort_order"), "hidden", "title"), "moments")
    order = rows.filter("c_nationkey = 3").select("id", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "id")).alias("place"))
    titles = rows.filter("id % 5 = 0").select("id", F.when(F.col("id") % 10 != 0, F.concat(F.lit("title "), "id")).otherwise("  ").alias("title"))
    tables.put(sync.edited_moments(tables.current(rows.sparkSession, path), order, rows.filter("id % 7 = 0").select("id"), titles), path)
    return tables.current(rows.sparkSession, path)


@query("SNK-29", "SELECT s_suppkey AS place, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1000 ELSE s_suppkey END AS cover FROM supplier WHERE (s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) AND s_suppkey % 10 <> 0")
def overrides_written(t):
    own = t("supplier").select(F.col("s_suppkey").alias("place"), F.col("s_suppkey").alias("cover"))
    path = _new(own.filter("place % 2 = 0"), "overrides")
    tables.upsert(path, own.filter("place % 3 = 0").withColumn("cover", F.col("cover") + 1000), ["place"])
    tables.delete(path, own.filter("place % 10 = 0"), ["place"])
    return tables.current(own.sparkSession, path)


_ROOT = "regexp_extract(url, '^[a-z]+://[^/]*/[^/]*/', 0)"


@query("SNK-30 ST-12", f"SELECT page_id, {_ROOT} <> '' AND length({_ROOT}) % 3 = 0 AS offline FROM pages")
def offline_marked(t):
    """Of two mount tables the roots that went; what lies below them is offline."""
    from glimmer.sources.files import volume_roots

    pages = t("pages").select("page_id", "url")
    before = pages.select(F.regexp_extract("url", "^[a-z]+://[^/]*/[^/]*/", 0).alias("root")).filter("root <> ''").distinct().withColumn("v", F.lit(1))
    changes = sync.difference(before, before.filter("length(root) % 3 <> 0"), "root", "v")
    gone = volume_roots(pages, "page_id", "url", changes.filter("action = 'delete'").select("root"))
    path = _new(pages.withColumn("offline", F.lit(False)), "assets")
    tables.upsert(path, gone.select("page_id", F.lit(True).alias("offline")), ["page_id"], {"url": F.col("old.url")})
    return tables.current(pages.sparkSession, path).select("page_id", "offline")


@query("SNK-32", "SELECT user_id AS task, arg_max(event_type, (ts, event_id)) AS status, max(value) AS offset_, arg_max(event_id, (ts, event_id)) AS updated FROM events WHERE user_id % 4 < 2 GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def upload_tasks(t):
    """Tasks by their last update; the furthest offset counts; failed ones are deleted."""
    log = t("events").filter("user_id % 4 < 2").select(F.col("user_id").alias("task"), "event_type", "value", "event_id", F.struct("ts", "event_id").alias("at"))
    path = _new(log.groupBy("task").agg(F.max_by("event_type", "at").alias("status"), F.max("value").alias("offset_"), F.max_by("event_id", "at").alias("updated")), "tasks")
    tables.delete(path, tables.current(log.sparkSession, path).filter("status = 'error'"), ["task"])
    return tables.current(log.sparkSession, path)


@query("ST-10", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type IN ('purchase', 'error') AS ends, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, 0::BIGINT AS i, false AS running, 0::BIGINT AS asked, NULL::BIGINT AS waits, NULL::BIGINT AS request, NULL::BIGINT AS run_at, NULL::BIGINT AS n FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT w.user_id, e.i, NOT ends OR (running AND asked > 0), CASE WHEN NOT ends AND running THEN asked + 1 ELSE 0 END, CASE WHEN NOT ends AND running THEN e.event_id END,
  CASE WHEN NOT ends AND NOT running THEN e.event_id WHEN ends AND running AND asked > 0 THEN waits END, t, CASE WHEN NOT ends THEN 1 ELSE asked END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id AS chain, request, run_at, n AS merged FROM w WHERE request IS NOT NULL""")
def reruns_replayed(t):
    """A log of requests and ends of runs: a request during a run lets one more follow at its end (`manifests.Ledger` keeps this state)."""
    runs = machines.rerun(t("events"), "user_id", F.col("ts"), "event_id", ~F.col("event_type").isin("purchase", "error"))
    return runs.select(F.col("user_id").alias("chain"), F.col("id").alias("request"), F.col("at").alias("run_at"), "merged")


@query("ST-14 SNK-35", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 7 = 0 THEN 2 ELSE 3 END::INT AS generation, doc_id % 7 = 0 AND doc_id % 3 <> 0 AS pending FROM documents")
def generations_rebuilt(t):
    """Runs of three generations: each does what no earlier run of its generation or a later one has done; a request that comes while one runs leaves its rows pending."""
    docs = t("documents").select("doc_id")
    spark, path = docs.sparkSession, shared_folder(docs.sparkSession, "generations")
    tables.stamp(path, docs.filter("doc_id % 3 = 0"), 1)
    read = lambda: spark.read.schema("doc_id long, generation int").parquet(path)
    tables.stamp(path, tables.outdated(docs, read(), "doc_id", 1), 2)
    redo = written(tables.outdated(docs.filter("doc_id % 7 <> 0 AND doc_id % 3 <> 0"), read(), "doc_id", 3), "redo")
    tables.stamp(path, redo, 3)
    last = read().groupBy("doc_id").agg(F.max("generation").alias("generation"))
    return last.select("doc_id", "generation", F.col("generation").eqNullSafe(F.lit(2)).alias("pending"))


@query("SNK-08", """WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 1 THEN 'renamed ' || c_custkey ELSE c_mktsegment || CASE WHEN r = 1 THEN '' ELSE '-' || r END END AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer)),
m AS (SELECT o_custkey AS album, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT id, name, CASE WHEN id % 3 <> 0 THEN first END AS cover FROM a LEFT JOIN m ON album = id WHERE id % 9 <> 0""")
def albums_changed(t):
    """Albums with names of their own, some renamed, with a cover that has to be a member, some deleted."""
    albums = unique_names(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.lit("").alias("all")), "name", ["all"], ["id"])
    path = _new(albums.select("id", F.col("entry").alias("name"), F.lit(None).cast("long").alias("cover")), "albums")
    spark = albums.sparkSession
    tables.upsert(path, albums.filter("id % 6 = 1").select("id", F.concat(F.lit("renamed "), "id").alias("name")), ["id"])
    members = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("asset"))
    asked = members.filter("asset % 2 = 0").groupBy("id").agg(F.min("asset").alias("cover")).withColumn("cover", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("cover")))
    covers = asked.join(members.withColumnRenamed("asset", "cover"), ["id", "cover"], "left_semi")
    tables.upsert(path, covers, ["id"])
    tables.delete(path, albums.filter("id % 9 = 0"), ["id"])
    return tables.current(spark, path).select("id", "name", "cover")


@query("SNK-02", """SELECT l_orderkey AS id, any_value(CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey % 4000 END) AS width, any_value(CASE WHEN l_orderkey % 2 = 1 THEN 'h264' END) AS video_codec, any_value(CASE WHEN l_orderkey % 2 = 1 THEN round(l_orderkey / 7.0, 6) END) AS frame_rate, any_value(CASE WHEN l_orderkey % 6 = 0 OR l_orderkey % 6 = 3 THEN 'kept' END) AS make FROM lineitem GROUP BY 1""")
def exif_written(t):
    """Pictures and videos write their own columns each, and leave the others as they are."""
    ids = t("lineitem").select(F.col("l_orderkey").alias("id")).distinct()
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    path = _new(ids.filter("id % 3 = 0").select("id", *none("long", "width"), *none("string", "video_codec"), *none("double", "frame_rate"), F.lit("kept").alias("make")), "exif")
    keep = lambda *names: {n: F.col(f"old.{n}") for n in names}
    tables.upsert(path, ids.filter("id % 2 = 0").select("id", (F.col("id") % 4000).alias("width")), ["id"], keep("video_codec", "frame_rate", "make"))
    tables.upsert(path, ids.filter("id % 2 = 1").select("id", F.lit("h264").alias("video_codec"), (F.col("id") / 7.0).alias("frame_rate")), ["id"], keep("width", "make"))
    return tables.current(ids.sparkSession, path).select("id", "width", "video_codec", F.round("frame_rate", 6).alias("frame_rate"), "make")


@query("SNK-16", """SELECT s_suppkey AS id, s_suppkey % 4 = 1 OR s_suppkey % 4 = 2 AS hidden, s_suppkey % 4 = 2 AS waiting FROM supplier WHERE NOT (s_suppkey % 4 = 0 AND s_suppkey % 8 <> 4)""")
def people_swept(t):
    """Hidden, restored and purged people; a purge waits thirty seconds, and the sweep leaves those that were restored meanwhile."""
    rows = t("supplier").select(F.col("s_suppkey").alias("id"), F.lit(False).alias("hidden"), F.lit(None).cast("long").alias("purge_at"))
    path = _new(rows, "people")
    hidden = lambda due: rows.select("id", F.lit(True).alias("hidden"), due.cast("long").alias("purge_at"))
    tables.upsert(path, hidden(F.lit(None)).filter("id % 4 = 1"), ["id"])
    tables.upsert(path, sync.purge_planned(rows.filter("id % 4 = 0"), 1_000), ["id"])
    tables.upsert(path, sync.purge_planned(rows.filter("id % 4 = 2"), 60_000), ["id"])
    tables.upsert(path, rows.filter("id % 8 = 4"), ["id"])  # restored
    tables.put(sync.purged(tables.current(rows.sparkSession, path), 40_000), path)
    return tables.current(rows.sparkSession, path).select("id", "hidden", F.col("purge_at").isNotNull().alias("waiting"))


@query("SNK-17 SNK-34", """WITH f AS (SELECT l_suppkey AS person, l_orderkey AS asset, l_suppkey % 9 = 4 AND l_orderkey % 2 = 0 OR l_suppkey % 9 = 5 AS out FROM lineitem)
SELECT person, (count(*) FILTER (NOT out))::BIGINT AS faces FROM f GROUP BY 1 HAVING bool_or(NOT out) OR person % 18 = 5""")
def faces_detached(t):
    """Faces taken from people; a person that is left without any goes, unless a user has named it."""
    faces = t("lineitem").select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("asset_id"))
    out = faces.filter("person_id % 9 = 4 AND asset_id % 2 = 0 OR person_id % 9 = 5").select("person_id", "asset_id").distinct()
    people = faces.select(F.col("person_id").alias("id")).distinct().withColumn("name", F.when(F.col("id") % 18 == 5, "named"))
    left, kept = sync.detached(faces, out, people)
    counts = left.groupBy("person_id").agg(F.count("*").alias("n"))
    return kept.join(counts, F.col("id") == F.col("person_id"), "left").select(F.col("id").alias("person"), F.coalesce("n", F.lit(0).cast("long")).alias("faces"))


@query("SNK-18 RM-14", """WITH f AS (SELECT l_suppkey AS person, l_orderkey AS asset, l_partkey AS face, l_quantity * 100 + l_linenumber AS area FROM lineitem), b AS (SELECT person, arg_max(face, [area, -face]) AS face FROM f GROUP BY 1), l AS (SELECT person, arg_max(face, [area, -face]) AS face FROM f WHERE asset % 50 = 7 GROUP BY 1)
SELECT b.person, CASE WHEN b.person % 2 = 0 AND l.face IS NOT NULL THEN l.face ELSE b.face END AS cover, b.person % 2 = 0 AND l.face IS NOT NULL AS locked FROM b LEFT JOIN l ON l.person = b.person""")
def covers_locked(t):
    """A cover that a user chose is the largest face on that picture, and locked; otherwise it is the person's largest face."""
    faces = t("lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("asset"), F.col("l_partkey").alias("face"), (F.col("l_quantity") * 100 + F.col("l_linenumber")).alias("area"))
    largest = lambda rows: best_row(rows, ["person"], [F.desc("area"), F.asc("face")])
    path = _new(largest(faces).select("person", F.col("face").alias("cover"), F.lit(False).alias("locked")), "people")
    chosen = largest(faces.filter("asset % 50 = 7 AND person % 2 = 0")).select("person", F.col("face").alias("cover"), F.lit(True).alias("locked"))
    tables.upsert(path, chosen, ["person"])
    return tables.current(faces.sparkSession, path)


@query("SNK-38 RM-01 SNK-34", "SELECT l_orderkey AS asset, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') OR l_shipdate >= TIMESTAMP '2000-01-01' GROUP BY 1")
def cache_pruned(t):
    """Files of a cache whose asset is gone are dropped once they are old enough."""
    cache = t("lineitem").select(F.col("l_orderkey").alias("asset"), F.col("l_shipdate").alias("written_at"))
    kept = sync.pruned(cache, t("orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("asset")), "asset", "written_at", F.lit("2000-01-01").cast("timestamp_ntz"))
    return kept.groupBy("asset").agg(F.count("*").alias("n"))
