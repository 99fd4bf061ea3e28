"""Listings, joins and statistics of a library: orders stand for assets, suppliers for people, customers for albums."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.functions.predicates import contains_any, has_word
from glimmer.functions.scalars import place_name, place_name_or_country
from glimmer.operators.dealing import tasks_of
from glimmer.operators.sequences import best_row, next_positions, spread_positions, top_per_group, unique_names
from glimmer.operators.sync import count_events
from glimmer.plans.registry import query


def _time(c: str = "o_orderdate"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("AG-01", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS n,
  (count(*) FILTER (o_orderpriority = '1-URGENT'))::BIGINT AS videos, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS documents
FROM orders GROUP BY 1""")
def timeline_buckets(t):
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    some = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return t("orders").groupBy(month).agg(F.count("*").alias("n"), some(F.col("o_orderpriority") == "1-URGENT").alias("videos"), some(F.col("o_orderstatus") == "F").alias("documents")).orderBy(F.desc_nulls_last("month"))


@query("SRT-02 FLT-03 Q-02", """
SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 6
ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20""")
def timeline_bucket_page(t):
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    month = t("orders").filter((F.col("o_orderdate") >= at("1997-06-01")) & (F.col("o_orderdate") < at("1997-07-01")))  # a range, which reaches the scan
    return month.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(50).select("o_orderkey", "o_totalprice")


@query("AG-02", """
SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*)::BIGINT AS n,
  string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC, o_orderkey) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1, 2""")
def timeline_groups(t):
    pending = F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == "P", F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("t"), F.col("o_orderkey").alias("k")))))
    ids = F.transform(pending, lambda s: s["k"].cast("string"))
    rows = t("orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return rows.agg(F.count("*").alias("n"), F.when(F.size(ids) > 0, F.array_join(ids, ",")).alias("pending"))


@query("JN-01 SRT-01 PRJ-01 PRJ-02", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS taken, coalesce(c_name, '') AS owner, coalesce(n_name, '') AS place
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def asset_page_left_enriched(t):
    page = t("orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)  # the page first, its joins then
    joined = page.join(t("customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.select("o_orderkey", _time().alias("taken"), F.coalesce("c_name", F.lit("")).alias("owner"), F.coalesce("n_name", F.lit("")).alias("place"))


@query("JN-03", """
SELECT l_orderkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name <> '' GROUP BY 1""")
def named_entities_per_asset(t):
    named = t("supplier").join(t("nation").filter("n_name <> ''"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name")
    rows = t("lineitem").join(named, F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("names"))


@query("JN-04 RM-04", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1) ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
def entity_assets_page(t):
    own = t("lineitem").filter("l_suppkey = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").join(own, "o_orderkey", "left_semi").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(40).select("o_orderkey")


@query("JN-05 AG-06", """
SELECT b.l_suppkey AS other, count(DISTINCT a.l_orderkey)::BIGINT AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
WHERE a.l_suppkey = 1 AND b.l_suppkey <> 1 GROUP BY 1""")
def co_occurrence(t):
    mine = t("lineitem").filter("l_suppkey = 1").select("l_orderkey").distinct()
    others = t("lineitem").filter("l_suppkey <> 1").select("l_orderkey", F.col("l_suppkey").alias("other")).distinct()
    return others.join(mine, "l_orderkey", "left_semi").groupBy("other").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "other")


@query("AG-05 GEO-09", """
SELECT l_suppkey AS person, count(DISTINCT l_orderkey)::BIGINT AS assets, strftime(min(l_shipdate), '%Y-%m-%d') AS first, strftime(max(l_shipdate), '%Y-%m-%d') AS last,
  count(DISTINCT c_nationkey)::BIGINT AS places
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def entity_stats(t):
    lines = t("lineitem").select(F.col("l_suppkey").alias("person"), "l_orderkey", "l_shipdate")
    n = tasks_of(lines)
    placed = t("orders").repartition(n, "o_custkey").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey").repartition(n, "o_orderkey")
    placed = placed.withColumn("counts", F.col("c_nationkey").eqNullSafe(F.min("c_nationkey").over(Window.partitionBy("o_orderkey"))).cast("long"))  # once, if an order had several places
    span = lambda first, last: (F.min(first).alias("first"), F.max(last).alias("last"))
    met = lines.repartition(n, "l_orderkey").join(placed, F.col("o_orderkey") == F.col("l_orderkey"))
    each = met.groupBy("person", "l_orderkey", "c_nationkey", "counts").agg(*span("l_shipdate", "l_shipdate"))
    cells = each.groupBy("person", "c_nationkey").agg(F.sum("counts").alias("assets"), *span("first", "last"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return cells.groupBy("person").agg(F.sum("assets").alias("assets"), day(F.min("first")).alias("first"), day(F.max("last")).alias("last"), F.count("c_nationkey").alias("places"))


@query("JN-09 JN-11 JN-13 JN-15 AG-31", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_missing(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("JN-10 RM-10 JN-27", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'stale' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0""")
def stale_or_missing(t):
    both = t("documents").select("doc_id").join(t("labels").withColumn("found", F.lit(True)), "doc_id", "left")
    return both.filter(F.col("found").isNull() | (F.col("quality") == 0)).select("doc_id", F.when(F.col("found").isNull(), "missing").otherwise("stale").alias("reason"))


@query("JN-12", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '2001-01-01')")
def anti_cooldown(t):
    recent = t("orders").filter(F.col("o_orderdate") > F.lit("2001-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey").join(recent, "c_custkey", "left_anti")


@query("JN-14 FLT-02", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)")
def semi_exists(t):
    large = t("lineitem").filter("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").select("o_orderkey").join(large, "o_orderkey", "left_semi")


@query("JN-22", """
SELECT user_id, max(ts) FILTER (event_type = 'purchase') > coalesce(max(ts) FILTER (event_type = 'view'), TIMESTAMP '1970-01-01') AS is_new
FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') > 0""")
def recency_flag(t):
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    rows = t("events").groupBy("user_id").agg(last("purchase").alias("matched"), last("view").alias("viewed")).filter("matched IS NOT NULL")
    return rows.select("user_id", (F.col("viewed").isNull() | (F.col("matched") > F.col("viewed"))).alias("is_new"))


@query("JN-07 AG-19", """
SELECT s_suppkey AS person, count(*)::BIGINT AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
WHERE c_nationkey = 3 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""")
def top_faces_between(t):
    time = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))
    orders = t("orders").filter(time).join(t("customer").filter("c_nationkey = 3"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey")
    rows = t("lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.groupBy(F.col("s_suppkey").alias("person")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person").limit(5)


@query("PRJ-04 PRJ-05 JN-28", """
SELECT s_suppkey AS person, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE n_name || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ', ' || r_name END END AS place,
  CASE WHEN s_suppkey % 5 = 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE r_name END ELSE n_name || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ', ' || r_name END END AS place_or_country
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def place_names(t):
    rows = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    city = F.when(F.col("s_suppkey") % 5 != 0, F.col("n_name"))
    country = F.when(F.col("s_suppkey") % 3 != 0, F.col("r_name"))
    return rows.select(F.col("s_suppkey").alias("person"), place_name(city, country).alias("place"), place_name_or_country(city, country).alias("place_or_country"))


@query("JN-23 AG-10 Q-08", """
SELECT c_custkey AS album, count(o_orderkey)::BIGINT AS n, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS videos, (count(*) FILTER (o_orderstatus <> 'F'))::BIGINT AS photos,
  strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last,
  coalesce(max(o_orderkey) FILTER (o_orderkey = c_custkey * 4), arg_max(o_orderkey, (o_totalprice, -o_orderkey))) AS cover
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def album_list(t):
    rows = t("customer").select("c_custkey").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    chosen = F.max(F.when(F.col("o_orderkey") == F.col("c_custkey") * 4, F.col("o_orderkey")))
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey")))
    some = lambda c: F.count(F.when(c, 1))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return rows.groupBy(F.col("c_custkey").alias("album")).agg(
        F.count("o_orderkey").alias("n"),
        some(F.col("o_orderstatus") == "F").alias("videos"),
        some(F.col("o_orderstatus") != "F").alias("photos"),
        day(F.min("o_orderdate")).alias("first"),
        day(F.max("o_orderdate")).alias("last"),
        F.coalesce(chosen, best).alias("cover"),
    )


@query("AG-03 Q-10", "SELECT o_orderstatus AS status, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS bytes FROM orders GROUP BY 1")
def status_counts(t):
    return t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("bytes"))


@query("AG-04", """
SELECT round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS raw, round(sum(l_quantity) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O'), 2) AS video,
  round(sum(l_quantity) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O'), 2) AS photo FROM lineitem""")
def conditional_bytes(t):
    raw, video = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    part = lambda c: F.round(F.sum(F.when(c, F.col("l_quantity"))), 2)
    return t("lineitem").agg(part(raw).alias("raw"), part(~raw & video).alias("video"), part(~raw & ~video).alias("photo"))


@query("", """
SELECT least(floor(l_discount * 100 / 1.0), 9)::INT AS bin, count(*)::BIGINT AS n, any_value(m) AS median FROM lineitem, (SELECT median(l_discount) AS m FROM lineitem) GROUP BY 1""")
def score_histogram_median(t):
    rows = t("lineitem")
    median = rows.agg(F.percentile("l_discount", F.lit(0.5)).alias("median"))
    bins = rows.groupBy(F.least(F.floor(F.col("l_discount") * 100 / 1.0), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return bins.crossJoin(F.broadcast(median))  # one row


@query("AG-07 AG-08 JN-06", """
SELECT c_nationkey AS city, count(*)::BIGINT AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS last, arg_max(c_mktsegment, (o_orderdate, o_orderkey)) AS segment, any_value(n_regionkey) AS region, any_value(cities)::BIGINT AS cities
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN (SELECT n_regionkey AS r, count(DISTINCT n_nationkey) AS cities FROM nation GROUP BY 1) ON r = n_regionkey GROUP BY 1""")
def top_places(t):
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    cities = t("nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.countDistinct("n_nationkey").alias("cities"))
    places = rows.groupBy(F.col("c_nationkey").alias("city")).agg(
        F.count("*").alias("n"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"), F.max_by("c_mktsegment", F.struct("o_orderdate", "o_orderkey")).alias("segment"), F.first("n_regionkey").alias("region")
    )
    return places.join(cities, "region").select("city", "n", "last", "segment", "region", "cities").orderBy(F.desc("n"), "city")


@query("AG-09", """
SELECT city, n, n = max(n) OVER () AND n >= 2 AS home FROM (SELECT c_nationkey AS city, count(*)::BIGINT AS n FROM customer GROUP BY 1)""")
def home_flag(t):
    cities = t("customer").groupBy(F.col("c_nationkey").alias("city")).agg(F.count("*").alias("n"))
    most = cities.agg(F.max("n").alias("most"))
    return cities.crossJoin(F.broadcast(most)).select("city", "n", ((F.col("n") == F.col("most")) & (F.col("n") >= 2)).alias("home"))  # one row


@query("WIN-08 SRT-04 GEO-12", """
SELECT o_custkey AS album, o_orderkey AS cover FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1""")
def set_cover_argmax(t):
    score = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    return best_row(t("orders"), ["o_custkey"], [F.desc_nulls_last(score), F.asc("o_orderkey")]).select(F.col("o_custkey").alias("album"), F.col("o_orderkey").alias("cover"))


@query("WIN-01 SNK-36", """
SELECT o_custkey AS album, o_orderkey AS asset, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)""")
def position_backfill(t):
    many = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 2").select("o_custkey")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = t("orders").join(many, "o_custkey", "left_semi")
    return rows.select(F.col("o_custkey").alias("album"), F.col("o_orderkey").alias("asset"), (F.row_number().over(w) - 1).cast("long").alias("position"))


@query("SNK-09", """
WITH old AS (SELECT o_custkey AS album, o_orderkey AS asset, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS position FROM orders WHERE o_orderstatus = 'F'),
fresh AS (SELECT o_custkey AS album, o_orderkey AS asset FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND (o_custkey, o_orderkey) NOT IN (SELECT (album, asset) FROM old))
SELECT f.album, asset, (coalesce(m, -1) + row_number() OVER (PARTITION BY f.album ORDER BY asset))::BIGINT AS position FROM fresh f LEFT JOIN (SELECT album, max(position) AS m FROM old GROUP BY 1) l ON l.album = f.album""")
def album_append(t):
    own = t("orders").select(F.col("o_custkey").alias("album"), F.col("o_orderkey").alias("asset"), "o_orderdate", "o_orderstatus")
    w = Window.partitionBy("album").orderBy("asset")
    old = own.filter("o_orderstatus = 'F'").withColumn("position", F.row_number().over(w) - 1)
    fresh = own.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("album", "asset")
    return next_positions(fresh, old, ["album"], "asset", ["asset"]).select("album", "asset", F.col("position").cast("long").alias("position"))


@query("WIN-06", """
SELECT l_suppkey, l_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS rank
  FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE rank <= 3""")
def top_n_per_group(t):
    rows = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return top_per_group(rows, 3, ["l_suppkey"], [F.desc("q"), F.asc("l_partkey")]).select("l_suppkey", "l_partkey", F.col("rank").cast("long").alias("rank"))


@query("WIN-10", """
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
WHERE p IN (0, n // 2, n - 1)""")
def cover_candidates(t):
    whole = Window.partitionBy("o_custkey")
    rows = t("orders").withColumn("c", spread_positions(whole.orderBy("o_orderdate", "o_orderkey"), whole))
    return rows.filter("c").select("o_custkey", "o_orderkey")


@query("WIN-09", "SELECT arg_max(c_nationkey, (o_orderdate, o_orderkey)) AS city FROM orders JOIN customer ON c_custkey = o_custkey")
def current_trip_city(t):
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.agg(F.max_by("c_nationkey", F.struct("o_orderdate", "o_orderkey")).alias("city"))


@query("AG-14 Q-08", """
WITH d AS (SELECT source, doc_id, lang, n_chars, substr(text, 1, 80) AS head FROM documents),
top AS (SELECT source, string_agg(lang || ':' || n, ',' ORDER BY n DESC, lang) AS langs FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM (SELECT source, lang, count(*) AS n FROM d GROUP BY 1, 2)) WHERE r <= 3 GROUP BY 1),
longest AS (SELECT source, string_agg(sha256(head), ',' ORDER BY r) AS longest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM d) WHERE r <= 3 GROUP BY 1),
covered AS (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS covers FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM d) WHERE p IN (0, n // 2, n - 1) GROUP BY 1)
SELECT d.source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, any_value(langs) AS langs, any_value(longest) AS longest, any_value(covers) AS covers
FROM d JOIN top USING (source) JOIN longest USING (source) JOIN covered USING (source) GROUP BY 1""")
def album_summary(t):
    d = t("documents").select("source", "doc_id", "lang", "n_chars", F.substring("text", 1, 80).alias("head"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", c.alias("x")))), lambda s: s["x"]), ",")
    langs = top_per_group(d.groupBy("source", "lang").agg(F.count("*").alias("n")), 3, ["source"], [F.desc("n"), F.asc("lang")]).groupBy("source").agg(joined(F.concat_ws(":", "lang", "n")).alias("langs"))
    longest = top_per_group(d, 3, ["source"], [F.desc("n_chars"), F.asc("doc_id")]).groupBy("source").agg(joined(F.sha2("head", 256)).alias("longest"))
    whole = Window.partitionBy("source")
    covers = d.withColumn("c", spread_positions(whole.orderBy("doc_id"), whole)).filter("c").withColumn("rank", F.col("doc_id")).groupBy("source").agg(joined(F.col("doc_id").cast("string")).alias("covers"))
    totals = d.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return totals.join(langs, "source").join(longest, "source").join(covers, "source")


@query("FLT-04", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def text_contains(t):
    return t("documents").filter(contains_any(F.col("text"), "LICENSE")).select("doc_id")


@query("FLT-05", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'ingly')")
def text_any_of(t):
    return t("documents").filter(contains_any(F.col("text"), "License | ingly | ")).select("doc_id")


@query("FLT-06", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^0-9a-z_])apache($|[^0-9a-z_])')")
def text_word_boundary(t):
    return t("documents").filter(has_word(F.col("text"), "Apache")).select("doc_id")


@query("FLT-08 FLT-10", "SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE (lower(n_name) = 'nation_3' OR lower(r_name) = 'asia') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def place_without_videos(t):
    named = t("nation").join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).filter((F.lower("n_name") == "nation_3") | (F.lower("r_name") == "asia")).select("n_nationkey")
    videos = t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(named, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").join(videos, "c_custkey", "left_anti").select("c_custkey")


@query("FLT-11", r"""
SELECT page_id, starts_with(url, 'https://') AS secure, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS volume, list_contains(string_split(url, '/'), 'tag') AS tagged FROM pages""")
def url_parts(t):
    return t("pages").select("page_id", F.col("url").startswith("https://").alias("secure"), F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1).alias("volume"), F.array_contains(F.split("url", "/"), "tag").alias("tagged"))


@query("SNK-07", "SELECT user_id, event_type, count(*)::BIGINT AS view_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1, 2")
def view_counters(t):
    return count_events(t("events"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "view_count", _time("last_viewed_at").alias("last"))


_WALK = """WITH RECURSIVE {rows},
w AS (SELECT g, 0::BIGINT AS i, {used} AS used, NULL::BIGINT AS id, NULL::VARCHAR AS given FROM (SELECT DISTINCT g FROM r)
UNION ALL SELECT g, i, list_append(used, given), id, given FROM (
  SELECT w.g, r.i, used, r.id, CASE WHEN NOT list_contains(used, name) THEN name ELSE list_filter(list_transform(range({first}, len(used) + 3), lambda n: regexp_extract(name, '^(.*)[.]', 1) || {mark} || '.jpg'), lambda c: NOT list_contains(used, c))[1] END AS given
  FROM w JOIN r ON r.g = w.g AND r.i = w.i + 1))
SELECT id AS {id}, given AS {out} FROM w WHERE i > 0"""
_NAMES = """r AS (SELECT id, g, name, row_number() OVER (PARTITION BY g ORDER BY id) AS i FROM (SELECT page_id AS id, page_id % 29 AS g,
  'p' || page_id % 3 || CASE page_id % 5 WHEN 0 THEN '-' || (2 + page_id % 7) WHEN 1 THEN '-2-' || (2 + page_id % 2) ELSE '' END || '.jpg' AS name FROM pages))"""


@query("SNK-24", _WALK.format(rows=_NAMES, used="[]::VARCHAR[]", first=2, mark="'-' || n", id="page_id", out="entry"))
def zip_entry_names(t):
    """Archives of pages, of which some are named as others would be."""
    k = F.col("page_id")
    mark = F.when(k % 5 == 0, F.concat(F.lit("-"), 2 + k % 7)).when(k % 5 == 1, F.concat(F.lit("-2-"), 2 + k % 2)).otherwise("")
    rows = t("pages").select("page_id", (k % 29).alias("archive"), F.concat(F.lit("p"), k % 3, mark, F.lit(".jpg")).alias("name"))
    return unique_names(rows, "name", ["archive"], ["page_id"]).select("page_id", "entry")


@query("SRT-08", "SELECT p_partkey FROM part ORDER BY CASE WHEN p_size > 10 THEN NULL ELSE p_size END ASC NULLS LAST, p_retailprice DESC, p_partkey LIMIT 60")
def manual_order_first(t):
    manual = F.when(F.col("p_size") <= 10, F.col("p_size"))
    return t("part").orderBy(F.asc_nulls_last(manual), F.desc("p_retailprice"), "p_partkey").limit(60).select("p_partkey")


@query("SRT-03", "SELECT o_orderkey, o_totalprice, p::BIGINT AS place FROM orders JOIN (SELECT unnest([40, 8, 16, 4, 8000]) AS k, unnest(range(5)) AS p) ON k = o_orderkey")
def explicit_order(t):
    wanted = t("orders").limit(1).select(F.posexplode(F.array(*[F.lit(k).cast("long") for k in (40, 8, 16, 4, 8000)])).alias("place", "k"))
    return t("orders").join(F.broadcast(wanted), F.col("k") == F.col("o_orderkey")).select("o_orderkey", "o_totalprice", F.col("place").cast("long").alias("place")).orderBy("place")  # as many rows as ids are given


@query("SRT-07 SRT-11", """
SELECT o_orderkey, (SELECT ceil(count(*) / 24.0)::BIGINT FROM orders WHERE o_orderstatus = 'P') AS pages FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 24 OFFSET 48""")
def paged_with_total(t):
    rows = t("orders").filter("o_orderstatus = 'P'")
    pages = rows.agg(F.ceil(F.count("*") / 24.0).alias("pages"))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(48).limit(24).select("o_orderkey").crossJoin(F.broadcast(pages))  # one row


@query("JN-26 RM-24", "SELECT n_nationkey, coalesce(o.o_orderkey, d.cover) AS cover FROM nation LEFT JOIN (SELECT c_nationkey, max(o_orderkey) AS cover FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) d ON d.c_nationkey = n_nationkey LEFT JOIN orders o ON o.o_orderkey = n_nationkey * 8")
def cover_overrides(t):
    own = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_nationkey").agg(F.max("o_orderkey").alias("cover"))
    chosen = t("nation").select("n_nationkey", (F.col("n_nationkey").cast("long") * 8).alias("o_orderkey")).join(t("orders").select("o_orderkey"), "o_orderkey")
    return t("nation").select("n_nationkey").join(own, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(chosen, "n_nationkey", "left").select("n_nationkey", F.coalesce("o_orderkey", "cover").alias("cover"))


@query("AG-13 RM-06", "SELECT user_id, (count(*) FILTER (ts >= TIMESTAMP '2024-01-20'))::BIGINT AS added FROM events GROUP BY 1")
def added_recently(t):
    return t("events").groupBy("user_id").agg(F.count(F.when(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"), 1)).alias("added"))
