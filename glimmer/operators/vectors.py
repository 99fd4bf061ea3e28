"""Operators on vectors: distances, nearest neighbours, all similar pairs, centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.functions.scalars import clamp
from glimmer.operators import metric


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2(a: Column, b: Column) -> Column:
    square = lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where one of them is zero; the cosine is kept within -1 and 1."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 1.0).otherwise(1 - clamp(dot(a, b) / size, -1.0))


def constant(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def nearest(rows: DataFrame, vector: str, query: Column, k: int, id_column: str) -> DataFrame:
    """The k rows with the smallest Euclidean distance to query, in order; filters on rows come before, so k are found."""
    return rows.withColumn("distance", l2(F.col(vector), query)).orderBy("distance", id_column).limit(k)


def nearest_each(rows: DataFrame, queries: DataFrame, id_column: str, vector: str, k: int) -> DataFrame:
    """The k nearest rows of each of a stated set of queries: query, neighbor, distance, rank; equal distances by id."""
    return metric.k_nearest(metric.usable(rows, id_column, vector), metric.usable(queries, id_column, vector), k)


def similar_pairs(rows: DataFrame, id_column: str, vector: str, most: float, within: str | None = None) -> DataFrame:
    """All pairs a < b with a cosine distance of at most `most` (and the same value of the column `within`): a, b, distance.

    Pairs of cells that the triangle inequality rules out don't meet (`metric`). Within groups all parts of a group meet.
    """
    if within is None:
        return metric.pairs_within(metric.usable(rows, id_column, vector), most)
    own = rows.select(F.coalesce(F.col(within).cast("string"), F.lit("")).alias("g"), F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return metric.pairs_within_groups(own.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())), most)


def similar_links(rows: DataFrame, id_column: str, vector: str, radii: list[float], nested: bool = False) -> DataFrame:
    """Links (radius: its place in radii; a, b) with the components of all pairs within each cosine distance of radii; nested: those of a radius and of the smaller ones before it."""
    return metric.links_within(metric.usable(rows, id_column, vector), radii, nested)


def similar_block_links(rows: DataFrame, id_column: str, vector: str, most: float) -> DataFrame:
    """Links (a, b) with the blocks of all pairs within a cosine distance, for `clustering.cut_vertices`; far fewer than the pairs."""
    return metric.block_links_within(metric.usable(rows, id_column, vector), most)


def distance_quantiles(rows: DataFrame, id_column: str, vector: str, within: str, shares: list[float]) -> DataFrame:
    """Of all pairs of rows with the same value of the column `within`: it, n, low, high, mean and q, the quantiles of shares, of their cosine distances."""
    own = rows.select(F.col(within).alias("g"), F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    found = metric.distance_quantiles(own.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())), shares)
    return found.withColumnRenamed("g", within)


def centroids(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The mean of each dimension within keys, and the number of vectors."""
    sums = rows.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return sums.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))


def confidence(rows: DataFrame, centers: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean cosine similarity to the centroid, within 0 and 1; 1 for a single vector."""
    mean = F.avg(1 - cosine_distance(F.col(vector), F.col("centroid")))
    return rows.join(centers, keys).groupBy(*keys).agg(F.when(F.count("*") == 1, 1.0).otherwise(clamp(mean)).alias("confidence"), F.count("*").alias("members"))


def merge_suggestions(centers: DataFrame, key: str, low: float, high: float, rejected: DataFrame | None = None) -> DataFrame:
    """Pairs of entities whose centroids are further than low and nearer than high, without the rejected pairs."""
    pairs = similar_pairs(centers, key, "centroid", high).filter((F.col("distance") > low) & (F.col("distance") < high))
    if rejected is not None:
        pairs = pairs.join(rejected.select(F.least("person_a", "person_b").alias("a"), F.greatest("person_a", "person_b").alias("b")), ["a", "b"], "left_anti")
    return pairs


def nearest_anchor(rows: DataFrame, anchors: DataFrame, id_column: str, vector: str, most: float, digits: int = 12) -> DataFrame:
    """Each row's (query) nearest anchor (anchor, centroid) within `most`; of those equal to that many digits the largest anchor."""
    return metric.closest_within(metric.usable(rows, id_column, vector), metric.usable(anchors, "anchor", "centroid"), most, digits).select("query", "anchor")


def prompt_margin(image: Column, documents: list[Column], photos: list[Column]) -> Column:
    """Best similarity to the first group of prompts less that to the second; 0 where a group is empty."""
    if not documents or not photos:
        return F.lit(0.0)
    best = lambda group: F.array_max(F.array(*[1 - cosine_distance(image, p) for p in group]))
    return best(documents) - best(photos)


def linear_head(vector: Column, weights: Column, bias: float) -> Column:
    """A scoring head without activations on the vector of length one."""
    size = norm(vector)
    return F.when(size == 0, bias).otherwise(dot(vector, weights) / size + bias)


def line_regularity(quads: DataFrame, keys: list[str], box: str = "box") -> DataFrame:
    """How evenly recognized lines lie: level, alike in height and aligned, from 0 to 1; 0.5 with fewer than three.

    Fixed values: 15 degrees, 0.75 of the mean height and 0.15 of the width are where each of the three is 0.
    """
    q = F.col(box)
    dx, dy = q[2] - q[0], q[3] - q[1]
    angle = F.abs(F.degrees(F.atan2(dy, dx)))
    height = (F.hypot(q[6] - q[0], q[7] - q[1]) + F.hypot(q[4] - q[2], q[5] - q[3])) / 2
    usable = (F.size(q) == 8) & ~((dx == 0) & (dy == 0)) & (height > 0)
    lines = quads.select(*keys, F.when(usable, F.struct(F.when(angle > 90, 180 - angle).otherwise(angle).alias("a"), height.alias("h"), F.least(q[0], q[6]).alias("l"), ((q[0] + q[2] + q[4] + q[6]) / 4).alias("c"))).alias("line"))
    s = lambda name: F.col(f"line.{name}")
    level = clamp(1 - F.avg(s("a")) / 15)
    even = clamp(1 - F.stddev_pop(s("h")) / F.avg(s("h")) / 0.75)
    aligned = clamp(1 - F.least(F.stddev_pop(s("l")), F.stddev_pop(s("c"))) / 0.15)
    return lines.groupBy(*keys).agg(F.when(F.count("line") < 3, 0.5).otherwise((level + even + aligned) / 3).alias("regularity"))
