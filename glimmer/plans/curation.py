"""Standing views, edits, upserts and differences between states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.operators import sync
from glimmer.plans.registry import query


@query("SET-01 AG-20 FLT-16 FLT-17", """
SELECT o_orderkey AS asset_id, round((s1 + s2) / 2, 6) AS match_score FROM (SELECT o_orderkey, o_custkey, o_orderdate, 0.5 + (o_orderkey % 50) / 100.0 AS s1, 0.6 + (o_orderkey % 37) / 100.0 AS s2 FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0)
WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE lower(n_name) = 'nation_5' OR n_regionkey = 2)
  AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59' AND (s1 + s2) / 2 >= 0.7""")
def condition_intersection(t):
    from datetime import datetime

    from glimmer.operators.conditions import Library, evaluate, parse

    orders, lit = t("orders"), F.lit
    place = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("city"), F.concat(lit("region "), "n_regionkey").alias("region"))
    geo = orders.join(place, "o_custkey").select(F.col("o_orderkey").alias("asset_id"), "city", F.col("region").alias("country"), "region")
    either = geo.filter((F.lower("city") == "nation_5") | (F.col("region") == "region 2")).select("asset_id", lit("either").alias("city"), lit("either").alias("country"), lit("either").alias("region"))

    def likeness(text):
        n, add, by = (2, 0.5, 50) if text == "sea" else (3, 0.6, 37)
        return orders.filter(F.col("o_orderkey") % n == 0).select(F.col("o_orderkey").alias("asset_id"), (add + (F.col("o_orderkey") % by) / 100.0).alias("score"))

    assets = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken_at"), lit(None).cast("string").alias("mime_type"))
    library = Library(assets, assets, assets, either, assets, likeness)
    texts = ["place: Either", "year: 1996", "scene: sea", "hills"]
    conditions = [parse(x, datetime(2024, 1, 1), lambda _: None, lambda _: False) for x in texts]
    return evaluate(conditions, library, 70).select("asset_id", F.round("match_score", 6).alias("match_score"))


@query("SET-02", """
WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS p FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)),
b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS p FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100))
SELECT id, source, (row_number() OVER (ORDER BY source, p, id) - 1)::BIGINT AS position FROM (SELECT id, 0 AS source, p FROM a UNION ALL SELECT id, 1, p FROM b WHERE id NOT IN (SELECT id FROM a))""")
def ordered_union(t):
    def top(*order):
        rows = t("orders").orderBy(*order).limit(100)
        return rows.select(F.col("o_orderkey").alias("id"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("position"))

    both = sync.ordered_union(top(F.desc("o_totalprice"), "o_orderkey"), top(F.desc("o_orderdate"), "o_orderkey"), "id")
    return both.select("id", "source", F.col("position").cast("long").alias("position"))


def _matches(t, cut, shift):
    return t("orders").filter(F.col("o_orderdate") >= F.lit(cut).cast("timestamp_ntz")).select(F.col("o_orderkey").alias("asset_id"), ((F.col("o_orderkey") + shift) % 40 / 40.0).alias("match_score"))


_STATES = """WITH a AS (SELECT o_orderkey AS k, o_orderkey % 40 / 40.0 AS s, CASE WHEN o_orderkey % 17 = 0 THEN 1 WHEN o_orderkey % 19 = 0 THEN 2 ELSE 0 END AS origin FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey AS k, (o_orderkey + o_orderkey % 2) % 40 / 40.0 AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01')"""


def _states(t):
    old = _matches(t, "1997-01-01", 0).filter("asset_id % 3 <> 0")
    origin = F.when(F.col("asset_id") % 17 == 0, 1).when(F.col("asset_id") % 19 == 0, 2).otherwise(0)
    return old.withColumn("origin", origin), _matches(t, "1997-06-01", F.col("o_orderkey") % 2)


@query("ST-08 SNK-37", f"""{_STATES} SELECT coalesce(a.k, b.k) AS asset_id, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' WHEN abs(a.s - b.s) > 0.0 THEN 'update' ELSE 'keep' END AS action FROM a FULL OUTER JOIN b ON a.k = b.k""")
def diff_sync(t):
    old, new = _states(t)
    return sync.difference(old, new, "asset_id", "match_score").select("asset_id", "action")


@query("SNK-21 RM-06", f"""{_STATES} SELECT coalesce(a.k, b.k) AS asset_id, coalesce(origin, 0) AS origin, round(CASE WHEN coalesce(origin, 0) <> 0 THEN a.s ELSE coalesce(b.s, a.s) END, 6) AS match_score,
CASE WHEN coalesce(origin, 0) <> 0 THEN 'keep' WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' WHEN a.s <> b.s THEN 'update' ELSE 'keep' END AS action FROM a FULL OUTER JOIN b ON a.k = b.k""")
def standing_view_reconcile(t):
    old, new = _states(t)
    return sync.reconcile(old, new).select("asset_id", "origin", F.round("match_score", 6).alias("match_score"), "action")


@query("ST-09 RM-07", """
WITH m AS (SELECT o_custkey AS moment_id, o_orderkey AS asset_id FROM orders WHERE o_orderkey % 2 = 0),
x AS (SELECT o_custkey AS moment_id, o_orderkey AS asset_id FROM orders WHERE o_orderkey % 14 = 0),
p AS (SELECT o_custkey AS moment_id, o_orderkey AS asset_id FROM orders WHERE o_orderkey % 9 = 0 AND o_orderstatus <> 'P')
SELECT moment_id, asset_id, (moment_id, asset_id) IN (SELECT (moment_id, asset_id) FROM p) AS manual FROM (SELECT * FROM m WHERE (moment_id, asset_id) NOT IN (SELECT (moment_id, asset_id) FROM x) UNION SELECT * FROM p WHERE (moment_id, asset_id) NOT IN (SELECT (moment_id, asset_id) FROM m))""")
def edit_replay(t):
    own = t("orders").select(F.col("o_custkey").alias("moment_id"), F.col("o_orderkey").alias("asset_id"), "o_orderstatus")
    edits = own.filter("asset_id % 14 = 0").select("moment_id", "asset_id", F.lit("exclude").alias("op")).unionByName(own.filter("asset_id % 9 = 0").select("moment_id", "asset_id", F.lit("pin").alias("op")))
    alive = own.filter("o_orderstatus <> 'P'").select("asset_id")
    return sync.replay_edits(own.filter("asset_id % 2 = 0").select("moment_id", "asset_id"), edits, alive, ["moment_id", "asset_id"])


@query("SNK-01", """
WITH a AS (SELECT o_orderkey AS id, 'p' || o_orderkey AS file_path, o_orderkey % 5 AS checksum, true AS face_scanned, o_totalprice AS size FROM orders WHERE o_orderkey % 4 <> 0),
b AS (SELECT o_orderkey + 1000000 AS id, 'p' || o_orderkey AS file_path, o_orderkey % 10 AS checksum, false AS face_scanned, o_totalprice + 1 AS size FROM orders WHERE o_orderkey % 3 <> 0)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.file_path, b.file_path) AS file_path, coalesce(b.checksum, a.checksum)::BIGINT AS checksum,
  CASE WHEN b.id IS NULL THEN a.face_scanned WHEN a.id IS NULL THEN b.face_scanned WHEN a.checksum = b.checksum THEN a.face_scanned ELSE false END AS face_scanned, coalesce(b.size, a.size) AS size FROM a FULL OUTER JOIN b ON a.file_path = b.file_path""")
def asset_upsert(t):
    def rows(keep, shift, by, scanned, more):
        k = F.col("o_orderkey")
        own = t("orders").filter(k % keep != 0)
        return own.select((k + shift).alias("id"), F.concat(F.lit("p"), k).alias("file_path"), (k % by).alias("checksum"), F.lit(scanned).alias("face_scanned"), (F.col("o_totalprice") + more).alias("size"))

    old, new = rows(4, 0, 5, True, 0), rows(3, 1_000_000, 10, False, 1)
    same = F.col("old.checksum").eqNullSafe(F.col("new.checksum"))
    return sync.upsert(old, new, ["file_path"], {"id": F.col("old.id"), "face_scanned": F.when(same, F.col("old.face_scanned")).otherwise(False)})


@query("SNK-06 SET-05", "SELECT DISTINCT user_id, floor(value * 3)::INT % 50 AS item FROM events WHERE event_type IN ('view', 'click')")
def favorites_inserted_once(t):
    own = t("events").select("user_id", (F.floor(F.col("value") * 3).cast("int") % 50).alias("item"), "event_type")
    kept = own.filter("event_type = 'view'").select("user_id", "item").distinct()
    return sync.insert_absent(kept, own.filter("event_type = 'click'").select("user_id", "item"), ["user_id", "item"])


@query("SNK-12 SNK-13 RM-11", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-01-31' - INTERVAL 30 DAY")
def retention_purge(t):
    return sync.expired(t("orders").filter("o_orderstatus = 'F'"), "o_orderdate", F.lit("1998-01-31").cast("timestamp_ntz"), 0).select("o_orderkey")


@query("SNK-33", "SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'de')")
def orphans_pruned(t):
    return sync.orphans_removed(t("labels"), t("documents").filter("lang <> 'de'"), "doc_id", "doc_id").select("doc_id")


@query("SNK-15", "SELECT CASE WHEN l_suppkey = 7 THEN 3 ELSE l_suppkey END AS person, count(DISTINCT l_orderkey)::BIGINT AS assets FROM lineitem GROUP BY 1")
def person_merge(t):
    mapping = t("lineitem").select(F.col("l_suppkey").alias("person_id"), "l_orderkey")
    return sync.merged_person(mapping, 7, 3).groupBy(F.col("person_id").alias("person")).agg(F.countDistinct("l_orderkey").alias("assets"))


@query("SRC-05", """SELECT page_id, max(root) AS volume FROM (SELECT page_id, root, max(length(root)) OVER (PARTITION BY page_id) AS m FROM pages, (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*/[^/]*/', 0) AS root FROM pages WHERE page_id % 9 = 0 UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*/', 0) FROM pages WHERE page_id % 4 = 0) WHERE root <> '' AND starts_with(url, root)) WHERE length(root) = m GROUP BY page_id""")
def volume_of_path(t):
    from glimmer.sources.files import volume_roots

    deep = t("pages").filter("page_id % 9 = 0").select(F.regexp_extract("url", r"^[a-z]+://[^/]*/[^/]*/", 0).alias("root"))
    flat = t("pages").filter("page_id % 4 = 0").select(F.regexp_extract("url", r"^[a-z]+://[^/]*/", 0).alias("root"))
    return volume_roots(t("pages").select("page_id", "url"), "page_id", "url", deep.union(flat).filter("root <> ''").distinct()).select("page_id", F.col("root").alias("volume"))


@query("", "SELECT event_id, (props ->> '$.k')::INT AS k FROM events WHERE event_type = 'purchase' AND (props ->> '$.k')::INT >= 50")
def event_properties(t):
    rows = t("events").filter("event_type = 'purchase'").withColumn("p", F.from_json("props", "k int"))
    return rows.select("event_id", F.col("p.k").alias("k")).filter("k >= 50")


@query("JN-24", """
SELECT a.page_id AS still, min(b.page_id) AS clip FROM (SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS stem FROM pages WHERE page_id % 2 = 0) a
JOIN (SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS stem FROM pages WHERE page_id % 2 = 1) b USING (stem) WHERE stem <> '' GROUP BY 1""")
def live_photo_pairs(t):
    rows = t("pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).alias("stem")).filter("stem <> ''")
    clips = rows.filter("page_id % 2 = 1").groupBy("stem").agg(F.min("page_id").alias("clip"))
    return rows.filter("page_id % 2 = 0").join(clips, "stem").select(F.col("page_id").alias("still"), "clip")


@query("", "SELECT 'tag' AS kind, lang AS key, count(*)::BIGINT AS n FROM documents GROUP BY 2 UNION ALL SELECT 'site', source, count(*)::BIGINT FROM documents GROUP BY 2")
def entities_by_kind(t):
    rows = t("documents").select(F.explode(F.create_map(F.lit("tag"), "lang", F.lit("site"), "source")).alias("kind", "key"))
    return rows.groupBy("kind", "key").agg(F.count("*").alias("n"))
