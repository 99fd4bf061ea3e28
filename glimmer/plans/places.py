"""Reverse geocoding, cells and spots. Points and cities get coordinates from their keys, as the tables have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from glimmer.functions.scalars import cell, half_degree_cell, metro_radius_km, spot_key
from glimmer.operators import geo
from glimmer.plans.registry import query


def _points(t):
    k = F.col("c_custkey")
    lat, lon = k % 60 * 53 % 1190 / 10.0 - 59.35 + k % 7 / 20.0, k % 60 * 29 % 3390 / 10.0 - 169.45 + k % 11 / 20.0
    return t("customer").select(k.alias("id"), lat.alias("lat"), lon.alias("lon"), (k % 5).cast("string").alias("iso2"))


def _cities(t):
    k = F.col("s_suppkey")
    return t("supplier").select(
        k.alias("key"), F.col("s_name").alias("name"), ((k * 53) % 1190 / 10.0 - 59.3).alias("t_lat"), ((k * 29) % 3390 / 10.0 - 169.4).alias("t_lon"), (k % 5).cast("string").alias("iso2"), F.concat(F.lit("a"), k % 3).alias("admin1"), ((k % 60) * 100_000).alias("population")
    )


_SQL = """p AS (SELECT c_custkey AS id, c_custkey % 60 * 53 % 1190 / 10.0 - 59.35 + c_custkey % 7 / 20.0 AS lat, c_custkey % 60 * 29 % 3390 / 10.0 - 169.45 + c_custkey % 11 / 20.0 AS lon, c_custkey % 5 AS iso FROM customer),
c AS (SELECT s_suppkey AS key, s_name AS name, (s_suppkey * 53) % 1190 / 10.0 - 59.3 AS t_lat, (s_suppkey * 29) % 3390 / 10.0 - 169.4 AS t_lon, s_suppkey % 5 AS t_iso, (s_suppkey % 60) * 100000 AS pop FROM supplier),
near AS (SELECT *, 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM (SELECT *, pow(sin(radians(t_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(t_lat)) * pow(sin(radians(t_lon - lon) / 2), 2) AS h,
  abs(floor(lat + 90) - floor(t_lat + 90)) <= 1 AND abs(floor(lon + 180) - floor(t_lon + 180)) <= 1 AS close FROM p, c)),
best AS (SELECT id, CASE WHEN bool_or(close) THEN min([km, key]) FILTER (close) ELSE min([km, key]) END AS m FROM near GROUP BY 1)"""


@query("GEO-01 JN-16", f"WITH {_SQL} SELECT id, m[2]::BIGINT AS city, round(m[1], 6) AS km FROM best")
def haversine_nn(t):
    found = geo.nearest(_points(t).drop("iso2"), _cities(t).select("key", "t_lat", "t_lon"))
    return found.select("id", F.col("key").alias("city"), F.round("km", 6).alias("km"))


_RADIUS = "CASE WHEN pop >= 5000000 THEN 40 WHEN pop >= 1000000 THEN 30 WHEN pop >= 500000 THEN 22 WHEN pop >= 200000 THEN 15 WHEN pop >= 100000 THEN 10 ELSE 0 END"


@query("JN-17 GEO-03", f"WITH {_SQL} SELECT id, arg_max(key, (pop, -key)) AS city FROM near WHERE close AND iso = t_iso AND km <= {_RADIUS} AND {_RADIUS} > 0 GROUP BY 1")
def metro_snap(t):
    return geo.metro(_points(t), _cities(t).select("key", "t_lat", "t_lon", "iso2", "population")).select("id", F.col("key").alias("city"))


@query("GEO-02 GEO-04 SNK-05 SRC-14", f"""WITH {_SQL},
snap AS (SELECT n.id, arg_max(n.key, (n.pop, -n.key)) AS key FROM near n JOIN best b ON b.id = n.id JOIN c ON c.key = b.m[2]::BIGINT WHERE close AND n.t_iso = c.t_iso AND km <= {_RADIUS.replace('pop', 'n.pop')} AND {_RADIUS.replace('pop', 'n.pop')} > 0 GROUP BY 1)
SELECT b.id, coalesce(s.key, b.m[2]::BIGINT) AS city_id, c.name AS city, CASE c.t_iso WHEN 0 THEN 'asia' WHEN 1 THEN 'europe' WHEN 2 THEN 'americas' WHEN 3 THEN 'africa' ELSE '' END AS region
FROM best b LEFT JOIN snap s ON s.id = b.id JOIN c ON c.key = coalesce(s.key, b.m[2]::BIGINT)""")
def reverse_geocode(t):
    continents = F.array(*[F.lit(x) for x in ("AS", "EU", "SA", "AF", "??")])
    countries = t("nation").filter("n_nationkey < 5").select(F.col("n_nationkey").cast("string").alias("iso2"), F.col("n_name").alias("name"), F.element_at(continents, F.col("n_nationkey") + 1).alias("continent"))
    return geo.reverse_geocode(_points(t).drop("iso2"), _cities(t), countries).select("id", "city_id", "city", "region")


@query("JN-18 GEO-06", f"WITH {_SQL} SELECT id, coalesce(max(name) FILTER (key = pk), max(name) FILTER (key = ck)) AS name FROM (SELECT *, arg_min(key, [km, key]) FILTER (close AND km <= 60 AND key % 2 = 0) OVER (PARTITION BY id) AS pk, arg_min(key, [km, key]) FILTER (close AND km <= 60 AND key % 2 = 1) OVER (PARTITION BY id) AS ck FROM near) GROUP BY id")
def nearest_feature(t):
    c = _cities(t).select("key", "name", "t_lat", "t_lon")
    return geo.nearest_feature(_points(t).drop("iso2"), c.filter("key % 2 = 0"), c.filter("key % 2 = 1"), 60.0)


@query("GEO-08 GEO-09 FLT-09", f"""WITH {_SQL} SELECT id, trunc(lat * 2)::INT || ',' || trunc(lon * 2)::INT AS cell, iso || ':' || trunc(lat / 0.01)::INT || ':' || trunc(lon / 0.01)::INT AS spot, trunc(lat / 10)::INT AS band FROM p""")
def geo_cells(t):
    lat, lon = F.col("lat"), F.col("lon")
    return _points(t).select("id", half_degree_cell(lat, lon).alias("cell"), spot_key(F.col("iso2"), lat, lon).alias("spot"), cell(lat, 10).alias("band"))


@query("SRC-15", f"WITH {_SQL}, capital AS (SELECT key AS k, t_lat AS clat, t_lon AS clon FROM c WHERE key % 10 = 0) SELECT key FROM c WHERE key % 10 = 0 OR NOT EXISTS (SELECT 1 FROM capital WHERE 2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(t_lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(t_lat)) * pow(sin(radians(t_lon - clon) / 2), 2)))) <= 200)")
def cities_without_districts(t):
    """Places within 200 km of a capital are its parts."""
    c = _cities(t)
    plain = c.filter("key % 10 <> 0").select(F.col("key").alias("id"), F.col("t_lat").alias("lat"), F.col("t_lon").alias("lon"))
    parts = geo.within_km(plain, c.filter("key % 10 = 0").select("key", "t_lat", "t_lon"), 200.0).select(F.col("id").alias("key"))
    return c.select("key").join(parts, "key", "left_anti")


def _photos(t):
    """Orders as photos of a nation, some hundred metres around a few places."""
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    k = F.col("o_orderkey")
    lat = 10 + F.col("c_nationkey") + (k % 5) * 0.02 + (k % 7) * 0.0005
    lon = 20 + F.col("c_nationkey") + (k % 3) * 0.02 + (k % 11) * 0.0003
    return rows.select(F.col("c_nationkey").alias("city"), k.alias("id"), lat.alias("lat"), lon.alias("lon"), F.col("o_orderdate").alias("taken_at"))


#: Spots of a city by a walk through its pictures, newest first.
_SPOTS = """WITH RECURSIVE p AS (SELECT c_nationkey AS city, o_orderkey AS id, 10 + c_nationkey + (o_orderkey % 5) * 0.02 + (o_orderkey % 7) * 0.0005 AS lat, 20 + c_nationkey + (o_orderkey % 3) * 0.02 + (o_orderkey % 11) * 0.0003 AS lon, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS i
  FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT city, 0::BIGINT AS i, []::STRUCT(n BIGINT, a DOUBLE, b DOUBLE)[] AS spots, 0::BIGINT AS spot, 0::BIGINT AS id FROM (SELECT DISTINCT city FROM p)
  UNION ALL SELECT city, i, CASE WHEN k = 0 THEN list_append(spots, {'n': 1, 'a': lat, 'b': lon}) ELSE list_transform(spots, lambda x, j: CASE WHEN j = k THEN {'n': x.n + 1, 'a': x.a + lat, 'b': x.b + lon} ELSE x END) END, CASE WHEN k = 0 THEN len(spots) ELSE k - 1 END, id
  FROM (SELECT *, CASE WHEN len(d) > 0 AND list_min(d) <= 0.3 THEN len(d) - list_position(list_reverse(d), list_min(d)) + 1 ELSE 0 END AS k FROM (SELECT s.city, p.i, s.spots, p.id, p.lat, p.lon,
    list_transform(s.spots, lambda x: 2 * 6371.0 * asin(least(1, sqrt(pow(sin(radians(x.a / x.n - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(x.a / x.n)) * pow(sin(radians(x.b / x.n - p.lon) / 2), 2))))) AS d
    FROM s JOIN p ON p.city = s.city AND p.i = s.i + 1)))
"""
_MEMBERS_OF_SPOTS = "SELECT city, id, spot::BIGINT AS spot, count(*) OVER (PARTITION BY city, spot)::BIGINT AS members FROM s WHERE i > 0"


@query("", _SPOTS + _MEMBERS_OF_SPOTS)
def spots_greedy(t):
    return geo.greedy_spots(_photos(t)).select("city", "id", "spot", "members")


@query("GEO-06", _SPOTS.rstrip() + """,
u AS (SELECT city, unnest(range(len(spots))) AS spot, unnest(spots) AS x FROM (SELECT city, spots FROM s QUALIFY i = max(i) OVER (PARTITION BY city)))
SELECT city, city || ':' || trunc(x.a / x.n / 0.01)::INT || ':' || trunc(x.b / x.n / 0.01)::INT AS key, 'Spot ' || row_number() OVER (PARTITION BY city ORDER BY spot) AS name, x.n AS count, row_number() OVER (PARTITION BY city ORDER BY x.n DESC, spot) AS rank
FROM u WHERE x.n >= 3 QUALIFY rank <= 8""")
def spot_list(t):
    return geo.spot_list(geo.greedy_spots(_photos(t))).select("city", "key", "name", "count", "rank")


@query("GEO-11 FLT-07", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59'")
def place_assets_in_window(t):
    time = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31 23:59:59").cast("timestamp_ntz"))
    return t("orders").filter(time).join(t("customer").filter("c_nationkey = 3"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey")


@query("GEO-03", "SELECT c_custkey AS id, " + _RADIUS.replace("pop", "(c_custkey % 70 * 100000)") + "::DOUBLE AS km FROM customer")
def metro_radius(t):
    return t("customer").select(F.col("c_custkey").alias("id"), metro_radius_km(F.col("c_custkey") % 70 * 100_000).alias("km"))
