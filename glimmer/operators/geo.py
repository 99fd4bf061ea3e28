"""Places: nearest city and landmark by grid cells, metropolitan areas, spots of one city."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.functions.scalars import haversine_km, metro_radius_km, region_of, spot_key
from glimmer.operators.dealing import ROWS, tasks_for
from glimmer.store import written

SPOT_KM, SPOT_LEAST, SPOTS_MOST = 0.3, 3, 8


EARTH_KM = 6371.0
#: Levels of cubes that `nearest_of_all` goes down: sides of 2**-level, on a sphere of radius one (the last some 1.5 km).
LEVELS = (0, 3, 6, 9, 12)


def _cell(lat: Column, lon: Column) -> list[Column]:
    return [F.floor(lat + 90).alias("__y"), F.floor(lon + 180).alias("__x")]


def _near(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Points (id, lat, lon) with the targets (key, t_lat, t_lon, ...) of their cell of one degree and the eight around it.

    A cell with many pairs is dealt in parts of its points, each with all of its targets. The cells (64,800 at most) are broadcast.
    """
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    spread = targets.withColumn("__d", F.explode(around)).select("*", (F.floor(F.col("t_lat") + 90) + F.col("__d.dy")).alias("__y"), (F.floor(F.col("t_lon") + 180) + F.col("__d.dx")).alias("__x")).drop("__d")
    own, at = points.select("*", *_cell(F.col("lat"), F.col("lon"))), ["__y", "__x"]
    counts = own.groupBy(*at).agg(F.count("*").alias("__n")).join(spread.groupBy(*at).agg(F.count("*").alias("__m")), at)
    cells = written(counts.select(*at, (F.col("__n") * F.col("__m")).alias("__pairs")), "cells")
    tasks = tasks_for(points.sparkSession, cells.agg(F.sum("__pairs")).first()[0] or 0)
    parts = F.broadcast(cells.select(*at, F.ceil(F.col("__pairs") / ROWS).alias("__parts")))
    sided = own.join(parts, at).withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts"))).drop("__parts").repartition(tasks, *at, "__part")
    other = spread.join(parts, at).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts").repartition(tasks, *at, "__part")
    return sided.join(other, [*at, "__part"]).drop(*at, "__part").withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")))


def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    """Coordinates x, y, z from 0 to 2, of the point on a sphere of radius one around (1, 1, 1)."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo) + 1, F.cos(la) * F.sin(lo) + 1, F.sin(la) + 1]


def _cubes(columns: list[Column], side: float, names: str) -> list[Column]:
    return [F.floor(c / side).cast("int").alias(n) for c, n in zip(columns, names, strict=True)]


def _arc_km(chord: Column) -> Column:
    return 2 * EARTH_KM * F.asin(F.least(chord / 2, F.lit(1.0)))


def nearest_of_all(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, key, km): the nearest of all targets to each point, of equal ones the smallest key.

    Cubes in space have no seam at 180 degrees and no poles. From the largest to the smallest level, each point keeps those
    occupied cubes of which some place may be as near as the nearest known target: each cube has one target that is known,
    and the distance to its box bounds all others. So a point meets some dozens of cubes a level, and at last the targets of a
    few cubes of 1.5 km; targets at one place count once, by their smallest key.
    """
    spots = targets.groupBy("t_lat", "t_lon").agg(F.min("key").alias("key")).withColumns(dict(zip("xyz", _on_sphere(F.col("t_lat"), F.col("t_lon")), strict=True)))
    step = 2 ** (LEVELS[1] - LEVELS[0])
    top = F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: F.struct((i % 3).alias("a"), (F.floor(i / 3) % 3).cast("int").alias("b"), F.floor(i / 9).cast("int").alias("c")))
    place = dict(zip("xyz", _on_sphere(F.col("lat"), F.col("lon")), strict=True))
    found = points.select("id", "lat", "lon").withColumns(place).withColumn("p", F.explode(top)).select("id", "lat", "lon", "x", "y", "z", "p.a", "p.b", "p.c")
    for n, level in enumerate(LEVELS):
        side = 2.0**-level
        cubes = spots.select(*_cubes([F.col(c) for c in "xyz"], side, "def"), "key", "t_lat", "t_lon").groupBy("d", "e", "f").agg(F.min(F.struct("key", "t_lat", "t_lon")).alias("t"))
        above = F.col if n == 0 else (lambda c: F.floor(F.col(c) / step).cast("int"))
        cubes = cubes.select(above("d").alias("a"), above("e").alias("b"), above("f").alias("c"), "d", "e", "f", "t")
        gap = [F.greatest(F.col(c) * side - F.col(p), F.col(p) - (F.col(c) + 1) * side, F.lit(0.0)) for c, p in zip("def", "xyz", strict=True)]
        least = _arc_km(F.sqrt(sum((g * g for g in gap[1:]), gap[0] * gap[0])))
        met = found.join(cubes, ["a", "b", "c"]).withColumn("least", least).withColumn("known", haversine_km(F.col("lat"), F.col("lon"), F.col("t.t_lat"), F.col("t.t_lon")))
        best = F.min("known").over(Window.partitionBy("id"))
        kept = met.withColumn("best", best).filter(F.col("least") <= F.col("best") * (1 + 1e-9) + 1e-6)
        found = kept.select("id", "lat", "lon", "x", "y", "z", F.col("d").alias("a"), F.col("e").alias("b"), F.col("f").alias("c"))
    leaves = spots.select(*_cubes([F.col(c) for c in "xyz"], 2.0 ** -LEVELS[-1], "abc"), "key", "t_lat", "t_lon")
    near = found.join(leaves, ["a", "b", "c"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")))
    return near.groupBy("id").agg(F.min(F.struct("km", "key")).alias("m")).select("id", F.col("m.key").alias("key"), F.col("m.km").alias("km"))


def within_km(points: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(id, key, km) of all points (id, lat, lon) and targets (key, t_lat, t_lon) at most so far apart, by cubes of that side."""
    side = 2 * math.sin(min(most / EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-9
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    spread = targets.select("key", "t_lat", "t_lon", *_cubes(_on_sphere(F.col("t_lat"), F.col("t_lon")), side, "abc"), F.explode(around).alias("o"))
    spread = spread.select("key", "t_lat", "t_lon", *[(F.col(c) + F.col(f"o.{o}")).alias(c) for c, o in zip("abc", "ijk", strict=True)])
    own = points.select("id", "lat", "lon", *_cubes(_on_sphere(F.col("lat"), F.col("lon")), side, "abc"))
    met = own.join(spread, ["a", "b", "c"]).withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon")))
    return met.filter(F.col("km") <= most).select("id", "key", "km")


def nearest(points: DataFrame, targets: DataFrame, fallback: bool = True) -> DataFrame:
    """(id, key, km): each point's nearest target in its own and the eight cells around, of equal ones the smallest key.

    With fallback, points without any target there get the nearest of all.
    """
    best = _near(points, targets).groupBy("id").agg(F.min(F.struct("km", "key")).alias("m"))
    found = best.select("id", F.col("m.key").alias("key"), F.col("m.km").alias("km"))
    if not fallback:
        return found
    return found.unionByName(nearest_of_all(points.join(found, "id", "left_anti"), targets))


def metro(points: DataFrame, cities: DataFrame) -> DataFrame:
    """(id, key): the most populous city of the point's country (iso2) whose radius covers it."""
    near = _near(points, cities.withColumnRenamed("iso2", "t_iso2")).filter((F.col("iso2") == F.col("t_iso2")) & (metro_radius_km(F.col("population")) > 0) & (F.col("km") <= metro_radius_km(F.col("population"))))
    return near.groupBy("id").agg(F.max_by("key", F.struct("population", -F.col("key"))).alias("key"))


def reverse_geocode(points: DataFrame, cities: DataFrame, countries: DataFrame) -> DataFrame:
    """id, city_id, city, country, region, admin1, km of each point: the nearest city, or the metropolis around it."""
    plain = cities.select("key", "t_lat", "t_lon")
    nearest_city = nearest(points, plain).join(cities.select("key", "iso2"), "key").select("id", F.col("key").alias("near"), "iso2", "km")
    snapped = metro(points.join(nearest_city.select("id", "iso2"), "id"), cities.select("key", "t_lat", "t_lon", "iso2", "population"))
    chosen = nearest_city.join(snapped.withColumnRenamed("key", "snap"), "id", "left").select("id", F.coalesce("snap", "near").alias("key"), "km")
    named = chosen.join(cities.select("key", "name", "iso2", "admin1"), "key").join(countries.select("iso2", F.col("name").alias("country"), "continent"), "iso2", "left")
    return named.select("id", F.col("key").alias("city_id"), F.col("name").alias("city"), F.coalesce("country", "iso2").alias("country"), region_of(F.col("continent")).alias("region"), "admin1", "km")


def nearest_feature(points: DataFrame, pois: DataFrame, cities: DataFrame, most_km: float = 5.0) -> DataFrame:
    """(id, name) of the nearest landmark within most_km, else of the nearest city within it."""
    poi = nearest(points, pois.select("key", "t_lat", "t_lon"), fallback=False).filter(F.col("km") <= most_km).join(pois.select("key", F.col("name").alias("poi")), "key").select("id", "poi")
    city = nearest(points, cities.select("key", "t_lat", "t_lon"), fallback=False).filter(F.col("km") <= most_km).join(cities.select("key", F.col("name").alias("town")), "key").select("id", "town")
    return points.select("id").join(poi, "id", "left").join(city, "id", "left").select("id", F.coalesce("poi", "town").alias("name"))


def greedy_spots(rows: DataFrame, radius_km: float = SPOT_KM) -> DataFrame:
    """(city, id, spot, spot_lat, spot_lon, members) of rows (city, id, lat, lon, taken_at).

    Newest first, each row joins the nearest running centre within the radius, or opens a spot. The order decides, so a
    city is one task's work; only the ids and coordinates of its rows travel.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf[["taken_at", "id"]].reset_index(drop=True).sort_values(["taken_at", "id"], ascending=[False, True], na_position="last").index.to_numpy()
        lats, lons = pdf["lat"].to_numpy(), pdf["lon"].to_numpy()
        sums: list[list[float]] = []
        labels = np.zeros(len(pdf), np.int64)
        for start in range(0, len(order), 65536):  # Python's numbers take four times the room of numpy's
            at = order[start : start + 65536]
            own = []
            for lat, lon in zip(lats[at].tolist(), lons[at].tolist(), strict=True):
                best, least = -1, radius_km
                for i, (n, a, b) in enumerate(sums):
                    d = _km(lat, lon, a / n, b / n)
                    if d <= least:
                        best, least = i, d
                if best < 0:
                    sums.append([1, lat, lon])
                    best = len(sums) - 1
                else:
                    s = sums[best]
                    s[0], s[1], s[2] = s[0] + 1, s[1] + lat, s[2] + lon
                own.append(best)
            labels[at] = own
        n, a, b = (np.array([s[k] for s in sums]) for k in range(3))
        out = {"city": pdf["city"], "id": pdf["id"], "spot": labels, "spot_lat": (a / n)[labels], "spot_lon": (b / n)[labels], "members": n[labels]}
        return pd.DataFrame(out, copy=False)

    kinds = dict(rows.dtypes)
    return rows.select("city", "id", "lat", "lon", "taken_at").filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("city").applyInPandas(run, f"city {kinds['city']}, id {kinds['id']}, spot long, spot_lat double, spot_lon double, members long")


def _km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    dlat, dlon = math.radians(lat2 - lat1), math.radians(lon2 - lon1)
    a = math.sin(dlat / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(dlon / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def spot_list(members: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A city's spots of three rows at least, the eight largest: city, key, name, lat, lon, count. names: (city, spot, name)."""
    spots = members.groupBy("city", "spot").agg(F.first("spot_lat").alias("lat"), F.first("spot_lon").alias("lon"), F.first("members").alias("count")).filter(F.col("count") >= SPOT_LEAST)
    named = spots.join(names, ["city", "spot"], "left") if names is not None else spots.withColumn("name", F.lit(None).cast("string"))
    # numbers of unnamed spots run in the order in which spots were opened
    number = F.sum(F.col("name").isNull().cast("int")).over(Window.partitionBy("city").orderBy("spot"))
    largest = F.row_number().over(Window.partitionBy("city").orderBy(F.desc("count"), "spot"))
    return named.select("city", spot_key(F.col("city"), F.col("lat"), F.col("lon")).alias("key"), F.coalesce("name", F.concat(F.lit("Spot "), number)).alias("name"), "lat", "lon", "count", largest.alias("rank")).filter(F.col("rank") <= SPOTS_MOST)


def spot_members(members: DataFrame, key: str) -> DataFrame:
    """Ids of the spot with this key; of several in one cell the largest."""
    own = members.withColumn("key", spot_key(F.col("city"), F.col("spot_lat"), F.col("spot_lon"))).filter(F.col("key") == key)
    best = own.groupBy("city").agg(F.min_by("spot", F.struct(-F.col("members"), "spot")).alias("best"))
    return own.join(best, "city").filter(F.col("spot") == F.col("best")).select("city", "id")
