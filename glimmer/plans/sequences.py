"""Trips, bursts, sessions, retries and watchdogs on the events table; moments made of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glimmer.functions.scalars import retry_delay_ms, short_id, trip_id
from glimmer.operators.sequences import failures_since_success, gap_segments, global_gap_segments, rising_edges, runs
from glimmer.plans.registry import query

_SECONDS = "epoch_us(ts) / 1000000.0"
_GAPS = f"""WITH g AS (SELECT *, {_SECONDS} - lag({_SECONDS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM g)"""


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("WIN-02 WIN-07 RM-09", f"""{_GAPS}
SELECT user_id, segment::BIGINT AS segment, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*)::BIGINT AS n,
  floor((max({_SECONDS}) - min({_SECONDS})) / 86400)::BIGINT + 1 AS days, array_to_string(list(event_id ORDER BY ts, event_id)[1:6], ',') AS thumbs FROM s GROUP BY 1, 2""")
def trips_by_gap(t):
    rows = gap_segments(t("events"), "ts", 6 * 3600, ["user_id"], ["event_id"])
    ordered = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("ts", "event_id"))), 1, 6), lambda s: s["event_id"].cast("string"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1_000_000
    return rows.groupBy("user_id", "segment").agg(
        _time(F.min("ts")).alias("first"),
        _time(F.max("ts")).alias("last"),
        F.count("*").alias("n"),
        (F.floor((seconds(F.max("ts")) - seconds(F.min("ts"))) / 86400) + 1).alias("days"),
        F.array_join(ordered, ",").alias("thumbs"),
    )


@query("WIN-04 WIN-03", f"""
WITH g AS (SELECT *, {_SECONDS} - lag({_SECONDS}) OVER (ORDER BY ts) AS gap FROM events)
SELECT event_id, sum(CASE WHEN gap > 60 THEN 1 ELSE 0 END) OVER (ORDER BY ts)::BIGINT AS burst FROM g""")
def bursts(t):
    return global_gap_segments(t("events"), "ts", 60, "burst").select("event_id", F.col("burst").cast("long").alias("burst"))


@query("ST-03", f"{_GAPS} SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, segment")
def session_batches(t):
    rows = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    batches = rows.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return batches.select("user_id", _time(F.col("session_window.start")).alias("opened"), "n", "total")


_STREAK = """WITH m AS (SELECT *, (event_type = 'error')::INT AS f, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
k AS (SELECT *, sum(f) OVER (PARTITION BY user_id, s ORDER BY ts, event_id)::BIGINT AS fail_count FROM m)"""


@query("ST-05 SNK-31", f"""{_STREAK} SELECT event_id, fail_count, CASE least(fail_count, 5) WHEN 1 THEN 300000 WHEN 2 THEN 900000 WHEN 3 THEN 3600000 WHEN 4 THEN 21600000 ELSE 86400000 END::BIGINT AS delay_ms FROM k WHERE f = 1""")
def retry_ladder(t):
    rows = failures_since_success(t("events"), F.col("event_type") == "error", ["user_id"], ["ts", "event_id"])
    return rows.filter("event_type = 'error'").select("event_id", "fail_count", retry_delay_ms(F.col("fail_count")).alias("delay_ms"))


@query("ST-05 JN-12", f"""{_STREAK}, last AS (SELECT user_id, arg_max(fail_count, (ts, event_id)) AS fail_count, max(ts) AS seen FROM k GROUP BY 1)
SELECT user_id, fail_count, strftime(seen, '%Y-%m-%d %H:%M:%S') AS at FROM last WHERE fail_count > 0""")
def failure_ledger(t):
    rows = failures_since_success(t("events"), F.col("event_type") == "error", ["user_id"], ["ts", "event_id"])
    last = rows.groupBy("user_id").agg(F.max_by("fail_count", F.struct("ts", "event_id")).alias("fail_count"), F.max("ts").alias("ts"))
    return last.filter("fail_count > 0").select("user_id", "fail_count", _time("ts").alias("at"))


@query("ST-13", f"{_STREAK} SELECT user_id, count(*)::BIGINT AS length, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM k WHERE f = 1 GROUP BY user_id, s HAVING count(*) >= 3")
def run_length_watchdog(t):
    found = runs(t("events"), F.col("event_type") == "error", ["user_id"], ["ts", "event_id"]).filter("length >= 3")
    return found.select("user_id", "length", _time("first").alias("first"))


@query("ST-15", "SELECT event_id FROM (SELECT *, value >= 10 AS ready, lag(value >= 10, 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE ready AND NOT p")
def readiness_edges(t):
    return rising_edges(t("events"), F.col("value") >= 10, ["user_id"], ["ts", "event_id"]).select("event_id")


@query("", "SELECT min(event_id) AS event_id FROM events GROUP BY user_id, event_type, floor(epoch(ts) / 3600)")
def in_flight_dedup(t):
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    return t("events").groupBy("user_id", "event_type", hour.alias("h")).agg(F.min("event_id").alias("event_id")).select("event_id")


@query("ST-11 SNK-32", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, epoch(TIMESTAMP '2024-02-01' - max(ts)) > 300 AS stale FROM events GROUP BY 1")
def latest_status(t):
    rows = t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"))
    age = F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) / 1_000_000
    return rows.select("user_id", "status", (age > 300).alias("stale"))


@query("WIN-03 AG-18 Q-07 RM-19", """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, n_name, epoch(o_orderdate) - lag(epoch(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS gap
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = (o_orderkey % 3 + c_nationkey) % 25),
s AS (SELECT *, sum(CASE WHEN gap > 200 * 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seg FROM o),
c AS (SELECT o_custkey, seg, n_name, count(*) AS n FROM s GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, seg ORDER BY n DESC, n_name) AS r, sum(n) OVER (PARTITION BY o_custkey, seg) AS total FROM c),
p AS (SELECT o_custkey, seg, max(n_name) FILTER (r = 1) || coalesce(' & ' || max(n_name) FILTER (r = 2 AND n / total > 0.3), '') AS place FROM r GROUP BY 1, 2),
m AS (SELECT o_custkey, seg, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*)::BIGINT AS n FROM s GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT o_custkey AS owner, substr(sha1('trip|' || isoyear(first) || '-W' || lpad(weekofyear(first)::VARCHAR, 2, '0')), 1, 16) AS id, place || ' Trip' AS title,
  CASE WHEN strftime(first, '%b %Y') = strftime(last, '%b %Y') THEN strftime(first, '%b %Y') WHEN year(first) = year(last) THEN strftime(first, '%b') || ' – ' || strftime(last, '%b %Y')
    ELSE strftime(first, '%b %Y') || ' – ' || strftime(last, '%b %Y') END AS subtitle, n
FROM m JOIN p USING (o_custkey, seg)""")
def trip_moments(t):
    from glimmer.plans.moments import trips

    c = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    place = t("nation").select(F.col("n_nationkey"), F.col("n_name").alias("city"))
    rows = t("orders").join(c, "o_custkey").join(place, F.col("n_nationkey") == (F.col("o_orderkey") % 3 + F.col("c_nationkey")) % 25)
    items = rows.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken_at"), "city")
    return trips(items, ["owner"], gap_days=200, min_assets=3, recipe="trip").select("owner", "id", "title", "subtitle", "n")


@query("AG-21 SET-03 Q-07", """
WITH hits AS (SELECT doc_id, 0.4 + (doc_id % 50) / 100.0 AS s FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 0.3 + (doc_id % 40) / 80.0 FROM documents WHERE doc_id % 4 = 0),
best AS (SELECT doc_id, max(s) AS s FROM (SELECT doc_id, s FROM hits WHERE s >= 0.5 UNION ALL SELECT doc_id, 0.5 FROM documents WHERE regexp_matches(lower(text), '(^|[^0-9a-z_])(license|stupid)($|[^0-9a-z_])')) GROUP BY 1)
SELECT doc_id AS asset_id, round(s, 6) AS score FROM best WHERE doc_id % 5 <> 1""")
def theme_moments(t):
    from glimmer.plans.moments import theme

    d = t("documents").select(F.col("doc_id").alias("asset_id"), "text")
    first = d.filter("asset_id % 3 = 0").select("asset_id", (0.4 + (F.col("asset_id") % 50) / 100.0).alias("score"))
    second = d.filter("asset_id % 4 = 0").select("asset_id", (0.3 + (F.col("asset_id") % 40) / 80.0).alias("score"))
    pool = d.filter("asset_id % 5 <> 1").select("asset_id")
    return theme([first, second], d, ["license", "stupid"], pool, 0.5).select("asset_id", F.round("score", 6).alias("score"))


@query("AG-15", """SELECT substr(sha1('person|' || l_suppkey), 1, 16) AS id, l_suppkey AS person, count(DISTINCT l_orderkey)::BIGINT AS photos FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) >= 20 ORDER BY photos DESC, person LIMIT 8""")
def frequent_people(t):
    from glimmer.plans.moments import frequent

    rows = t("lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("asset_id"))
    return frequent(rows, "person", 20, 8).select(short_id(F.lit("person"), F.col("person").cast("string")).alias("id"), "person", "photos")


@query("AG-16 Q-07", """WITH top AS (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 20 ORDER BY count(DISTINCT l_orderkey) DESC, 1 LIMIT 8)
SELECT l_orderkey AS asset_id, count(DISTINCT l_suppkey)::BIGINT AS people FROM lineitem JOIN top USING (l_suppkey) GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2""")
def family_together(t):
    from glimmer.plans.moments import frequent, together

    rows = t("lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("asset_id"))
    return together(rows, frequent(rows, "person", 20, 8), 2)


@query("AG-17 SET-04", """
WITH terms AS (SELECT unnest(['license', 'stupid', 'the', 'und']) AS term), hits AS (SELECT term, doc_id, source FROM documents, terms WHERE regexp_matches(lower(text), '(^|[^0-9a-z_])' || term || '($|[^0-9a-z_])')),
pins AS (SELECT 'und' AS term, doc_id, source FROM documents WHERE doc_id % 97 = 0)
SELECT term, count(DISTINCT doc_id)::BIGINT AS photos, count(DISTINCT source)::BIGINT AS spread FROM (SELECT * FROM hits UNION SELECT * FROM pins) WHERE doc_id % 101 <> 0 GROUP BY 1 HAVING count(DISTINCT source) >= 2""")
def keyword_recurrence(t):
    from glimmer.plans.moments import recurring

    d = t("documents").select(F.col("doc_id").alias("asset_id"), "text", F.col("source").alias("month"))
    pins = d.filter("asset_id % 97 = 0").select(F.lit("und").alias("term"), "asset_id", "month")
    excludes = d.filter("asset_id % 101 = 0").select("asset_id")
    return recurring(d, ["license", "stupid", "the", "und"], pins, excludes, 2)


@query("WIN-03", "SELECT o_custkey, max(n)::BIGINT AS longest FROM (SELECT o_custkey, count(*) AS n FROM (SELECT *, sum(CASE WHEN gap > 14 * 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS s FROM (SELECT *, epoch(o_orderdate) - lag(epoch(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS gap FROM orders)) GROUP BY o_custkey, s) GROUP BY 1")
def longest_visit(t):
    rows = gap_segments(t("orders"), "o_orderdate", 14 * 86400, ["o_custkey"], ["o_orderkey"])
    return rows.groupBy("o_custkey", "segment").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.max("n").alias("longest"))


@query("ST-04", f"""
WITH p AS (SELECT *, lag(event_type) OVER w AS status, lag(floor(value)) OVER w AS bucket, lag({_SECONDS}) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id FROM p WHERE status IS NULL OR status <> event_type OR bucket <> floor(value) OR {_SECONDS} - before >= 0.5""")
def changes_published(t):
    """Against the row before; the streaming form compares with what was last published."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    rows = t("events").withColumn("s", F.lag("event_type").over(w)).withColumn("b", F.lag(F.floor("value")).over(w)).withColumn("a", F.lag(at).over(w))
    return rows.filter(F.col("s").isNull() | (F.col("s") != F.col("event_type")) | (F.col("b") != F.floor("value")) | (at - F.col("a") >= 0.5)).select("event_id")


@query("RM-19", "SELECT o_orderkey, substr(sha1('trip|' || isoyear(o_orderdate) || '-W' || lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0')), 1, 16) AS id, substr(sha1('theme'), 1, 16) AS theme FROM orders")
def stable_ids(t):
    return t("orders").select("o_orderkey", trip_id(F.lit("trip"), F.col("o_orderdate")).alias("id"), short_id(F.lit("theme")).alias("theme"))
