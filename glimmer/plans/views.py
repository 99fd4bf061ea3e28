"""Standing views from their texts to matches, figures, copies and albums."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from glimmer.operators import sync, views
from glimmer.operators.conditions import Library, evaluate, lookups, parse_all
from glimmer.plans.registry import query

_MATCHES = """m AS (SELECT o_custkey % 8 AS view_id, o_orderkey AS asset_id, (o_orderkey % 101) / 100.0 AS s, o_orderkey % 7 % 3 AS origin, o_orderdate AS seen, o_orderkey * 10 AS size FROM orders)"""


def _matches(t):
    k = F.col("o_orderkey")
    own = t("orders").select((F.col("o_custkey") % 8).alias("view_id"), k.alias("asset_id"), (k % 101 / 100.0).alias("match_score"), (k % 7 % 3).cast("int").alias("origin"), F.col("o_orderdate").alias("matched_at"))
    return own, t("orders").select(k.alias("id"), (k * 10).alias("file_size"))


def _library(t):
    """Orders as assets, suppliers as people on them, customers' nations as places."""
    orders = t("orders")
    assets = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken_at"), F.when(F.col("o_orderstatus") == "F", "video/mp4").otherwise("image/jpeg").alias("mime_type"))
    faces = t("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), F.col("l_orderkey").alias("asset_id"), (F.col("l_returnflag") == "R").alias("excluded"), "l_suppkey")
    links = faces.select(F.col("id").alias("face_id"), F.col("l_suppkey").cast("string").alias("person_id"))
    place = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    geo = orders.join(place, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("asset_id"), F.col("n_name").alias("city"), F.concat(F.lit("Land "), F.col("n_regionkey")).alias("country"), F.lit("world").alias("region"))
    ocr = orders.select(F.col("o_orderkey").alias("asset_id"), F.col("o_orderpriority").alias("text"))
    likeness = lambda _: orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("asset_id"), (0.4 + F.col("o_orderkey") % 60 / 100.0).alias("score"))
    people = t("supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    return Library(assets, faces, links, geo, ocr, likeness), people


_VIEWS = {
    1: (["supplier#000000007"], ""),
    2: (["Somewhere, land 2", "ocr: medium|urgent", "Jan 1996 - Dec 1996"], ""),
    3: (["score > 3", "gps: here"], "Nation_5"),
    4: (["scene: sea", "year: 1997"], "1998"),
}


@query("FLT-18 FLT-19 FLT-16 FLT-17 Q-06", """
WITH g AS (SELECT o_orderkey, n_name, n_regionkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
SELECT 1 AS view_id, o_orderkey AS asset_id, 1.0::DOUBLE AS match_score FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7 AND l_returnflag <> 'R')
UNION ALL SELECT 2, o_orderkey, 1.0 FROM orders JOIN g USING (o_orderkey) WHERE n_regionkey = 2 AND (lower(o_orderpriority) LIKE '%medium%' OR lower(o_orderpriority) LIKE '%urgent%') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
UNION ALL SELECT 3, o_orderkey, 1.0 FROM g WHERE lower(n_name) = 'nation_5'
UNION ALL SELECT 4, o_orderkey, round(0.4 + o_orderkey % 60 / 100.0, 6) FROM orders WHERE o_orderkey % 3 = 0 AND year(o_orderdate) = 1997 AND 0.4 + o_orderkey % 60 / 100.0 >= 0.7""")
def views_evaluated(t):
    """People and places are looked up in tables; a view without a condition that can be evaluated goes by its description."""
    library, people = _library(t)
    out = None
    for view, (texts, description) in _VIEWS.items():
        person, place = lookups(people, library.geo, [*texts, description])
        found = evaluate(parse_all(texts, description, datetime(2024, 1, 1), person, place), library)
        rows = found.select(F.lit(view).alias("view_id"), "asset_id", F.round("match_score", 6).alias("match_score"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("AG-12 Q-06", f"""WITH {_MATCHES} SELECT view_id, count(*)::BIGINT AS n, (count(*) FILTER (seen >= TIMESTAMP '2001-07-25'))::BIGINT AS added, sum(size)::BIGINT AS bytes, floor(quantile_cont(s, 0.5) * 100 + 0.5)::BIGINT AS median,
array_to_string([{", ".join(f"count(*) FILTER (least(floor(s * 10), 9) = {i})" for i in range(10))}], ',') AS bins FROM m WHERE origin <> 2 GROUP BY 1""")
def view_stats(t):
    matches, assets = _matches(t)
    out = views.stats(matches, assets, F.lit("2001-07-25").cast("timestamp_ntz"))
    return out.withColumn("bins", F.array_join(F.transform("bins", lambda x: x.cast("string")), ","))


@query("SNK-22 RM-06", f"""WITH {_MATCHES}, e AS (SELECT asset_id, CASE WHEN asset_id % 5 = 0 THEN 'pin' WHEN asset_id % 5 = 1 THEN 'remove' ELSE 'restore' END AS op FROM m WHERE asset_id % 5 < 3), o AS (SELECT * FROM m WHERE asset_id % 2 = 0)
SELECT asset_id, coalesce(s, 1.0) AS match_score, CASE op WHEN 'pin' THEN 1 WHEN 'remove' THEN 2 WHEN 'restore' THEN 0 ELSE origin END::INT AS origin FROM o FULL OUTER JOIN e USING (asset_id) WHERE origin IS NOT NULL OR op = 'pin'""")
def view_pins(t):
    matches, _ = _matches(t)
    op = F.when(F.col("asset_id") % 5 == 0, "pin").when(F.col("asset_id") % 5 == 1, "remove").otherwise("restore")
    edits = matches.filter("asset_id % 5 < 3").select("asset_id", op.alias("op"))
    return sync.set_origin(matches.filter("asset_id % 2 = 0").select("asset_id", "match_score", "origin"), edits)


@query("SNK-20", f"""WITH {_MATCHES}, v AS (SELECT r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'renamed' ELSE r_name END AS name, CASE WHEN r_regionkey = 2 THEN 70 ELSE 60 END AS threshold FROM region
  UNION ALL VALUES (100, 'made', 70), (101, 'strict', 95)),
c AS (SELECT * FROM v UNION ALL SELECT id + 200, name || ' (copy)', threshold FROM v WHERE id IN (0, 1)),
n AS (SELECT view_id AS id, asset_id FROM m UNION ALL SELECT view_id + 200, asset_id FROM m WHERE view_id IN (0, 1))
SELECT c.id, name, threshold::INT AS threshold, count(asset_id)::BIGINT AS matches FROM c LEFT JOIN n ON n.id = c.id WHERE c.id <> 3 GROUP BY 1, 2, 3""")
def views_kept(t):
    """Views made, changed, copied and deleted, with their matches."""
    matches, _ = _matches(t)
    own = t("region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(60).alias("threshold"), F.lit(True).alias("live"))
    own = views.created(own, [(100, " made ", 20), (101, "strict", 95), (102, "  ", 80)])
    spark = own.sparkSession
    own = views.changed(own, spark.createDataFrame([(1, "renamed", None, None), (2, None, 150, False)], "id long, name string, threshold int, live boolean"))
    own, matches = views.duplicated(own, matches, spark.createDataFrame([(0, 200), (1, 201)], "id long, copy_id long"))
    own, matches = views.deleted(own, matches, spark.createDataFrame([(3,)], "id long"))
    counts = matches.groupBy(F.col("view_id").alias("id")).agg(F.count("*").alias("matches"))
    return own.join(counts, "id", "left").select("id", "name", "threshold", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"))


@query("SRT-12 SNK-20", "SELECT user_id AS view_id, event_id, action FROM (SELECT user_id, event_id, event_type AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def view_activity(t):
    log = t("events").select(F.col("user_id").alias("view_id"), F.col("ts").alias("at"), F.col("event_type").alias("action"), F.col("event_id").alias("id"))
    return views.activity(log).select("view_id", F.col("id").alias("event_id"), "action")


@query("SNK-23", f"WITH {_MATCHES} SELECT view_id AS album, asset_id, row_number() OVER (PARTITION BY view_id ORDER BY s DESC, asset_id) - 1 AS position FROM m WHERE origin <> 2")
def view_as_album(t):
    return views.as_album(_matches(t)[0])


@query("SNK-23 SNK-21", f"""WITH {_MATCHES}, p AS (SELECT view_id, asset_id FROM m WHERE asset_id % 4 = 0), n AS (SELECT view_id, asset_id, s FROM m WHERE asset_id % 6 = 0)
SELECT coalesce(p.asset_id, n.asset_id) AS asset_id, CASE WHEN p.asset_id IS NULL THEN s ELSE 1.0 END AS match_score, CASE WHEN p.asset_id IS NULL THEN 0 ELSE 1 END::INT AS origin, CASE WHEN p.asset_id IS NULL THEN 'insert' ELSE 'keep' END AS action FROM p FULL OUTER JOIN n ON p.asset_id = n.asset_id""")
def album_as_view(t):
    """An album's members are pinned in the view that it becomes, so a new evaluation leaves them alone."""
    matches, _ = _matches(t)
    members = views.from_album(matches.filter("asset_id % 4 = 0").select(F.col("view_id").alias("album"), "asset_id"))
    return sync.reconcile(members, matches.filter("asset_id % 6 = 0"))
