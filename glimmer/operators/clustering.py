"""Groups of similar things: connected components, density clusters, near-duplicate groups, people."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.operators import metric
from glimmer.operators.blocks import Blocks, roots
from glimmer.operators.sequences import best_row
from glimmer.shipping import ship
from glimmer.store import removed, written

#: Edges that one task finishes, at most; more of them are contracted by shuffles first.
FEW = 1 << 20


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, the smallest b that links lead to), for each FEW links of a partition."""
    held: list[pa.RecordBatch] = []

    def close() -> pa.RecordBatch:
        links = pa.Table.from_batches(held)
        ids, at = np.unique(np.concatenate([links.column(c).to_numpy() for c in "ab"]), return_inverse=True)
        root = roots(at[: links.num_rows], at[links.num_rows :], np.arange(len(ids)))
        low = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[x], links.schema.field(0).type) for x in (low, root[low])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= FEW:
            yield close()
            held = []
    if held:
        yield close()


def linked(edges: DataFrame) -> DataFrame:
    """(id, component: the smallest id reachable) of the nodes of edges (a, b), in either direction, written.

    Edges are contracted to stars: each partition's by themselves, then by rounds of linking each node's larger
    neighbours (large stars) and its smaller ones (small stars) to the smallest neighbour, which lose no connection. Their
    number falls from round to round; once at most FEW are left, one task ends the work. Only counts come to the driver.
    """
    ship(edges.sparkSession)
    kinds = dict(edges.select("a", "b").dtypes)
    shape = f"a {kinds['a']}, b {kinds['b']}"
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    links = written(down.mapInArrow(_stars, shape).distinct(), "links")
    n, before = links.count(), None
    while n > FEW:
        low = links.union(links.select("b", "a")).groupBy(F.col("a").alias("u")).agg(F.least(F.first("a"), F.min("b")).alias("low"))
        large = written(links.join(low, F.col("b") == F.col("u")).select("a", F.col("low").alias("b")).mapInArrow(_stars, shape).distinct(), "links")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("low"))
        joined = large.join(low, F.col("a") == F.col("u"))
        small = joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(joined.select("a", F.col("low").alias("b")))
        small = written(small.distinct(), "links")
        removed(links, large)
        links, last = small, before
        n, *before = small.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if before == last:
            break  # stars already
    else:
        links = links.coalesce(1).mapInArrow(_stars, shape)
    labels = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = written(labels.union(labels.select("component", "component").distinct()), "components")
    return labels


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component: the smallest id reachable) of nodes (id) under edges (a, b), in either direction."""
    found = linked(edges).withColumnRenamed("id", "linked")
    return nodes.select("id").distinct().join(found, F.col("id") == F.col("linked"), "left").select("id", F.coalesce("component", "id").alias("component"))


def density_clusters(nodes: DataFrame, pairs: DataFrame, min_points: int = 1) -> DataFrame:
    """(id, cluster) by density: cores have min_points neighbours; clusters are components of cores.

    With one point every node is a core, so clusters are components. With more, a border node joins the smallest
    neighbouring core's cluster, and other nodes have none (null); this is the variant that doesn't depend on order.
    """
    ids = nodes.select("id")
    if min_points <= 1:
        return components(ids, pairs).withColumnRenamed("component", "cluster")
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    cores = both.groupBy("a").count().filter(F.col("count") >= min_points - 1).select(F.col("a").alias("id"))
    inner = pairs.join(cores.withColumnRenamed("id", "a"), "a", "left_semi").join(cores.withColumnRenamed("id", "b"), "b", "left_semi")
    of_cores = components(cores, inner)
    border = both.join(of_cores, F.col("b") == F.col("id")).groupBy("a").agg(F.min_by("component", "b").alias("near"))
    return ids.join(of_cores, "id", "left").join(border.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("component", "near").alias("cluster"))


def burst_groups(rows: DataFrame, id_column: str, vector: str, burst: list[str], least: float) -> DataFrame:
    """(id, group) within bursts: chains of pairs with a cosine similarity above least. A long burst is as many tasks as its parts' pairs."""
    known = rows
    for c in burst:
        known = known.filter(F.col(c).isNotNull())
    own = known.select(F.struct(*burst, F.size(vector).alias("__width")).alias("g"), F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    links = metric.links_above(own.filter(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())), least)
    return components(rows.select(F.col(id_column).alias("id")), links).withColumnRenamed("component", "group")


def representatives(rows: DataFrame, keys: list[str], score: str, id_column: str) -> DataFrame:
    """The best-scored row of each group; rows without a score come last, equal ones by id."""
    return best_row(rows, keys, [F.desc(F.coalesce(F.col(score), F.lit(-1.0))), F.asc(id_column)])


def partition_signature(labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """Labels renamed to the smallest id of their group, so that equal partitions are equal tables."""
    low = labels.groupBy(F.col(label).alias("__l")).agg(F.min(id_column).alias("canonical"))
    return labels.join(low, F.col(label).eqNullSafe(F.col("__l"))).select(id_column, "canonical")


def evaluated(rows: DataFrame, label: str, cluster: str, gate: int) -> DataFrame:
    """One row on clusters against labels: recall (a label's share in its largest part), fragments (its parts), purity, clusters, largest, second, gated (rows in clusters of the gate's size at least)."""
    parts = rows.groupBy(label, cluster).agg(F.count("*").alias("k"))
    labels = parts.groupBy(label).agg((F.max("k") / F.sum("k")).alias("recall"), F.count("*").alias("parts")).agg(F.avg("recall").alias("recall"), F.avg("parts").alias("fragments"))
    groups = parts.groupBy(cluster).agg((F.max("k") / F.sum("k")).alias("purity"), F.sum("k").alias("size"))
    sums = groups.agg(F.avg("purity").alias("purity"), F.count("*").alias("clusters"), F.max("size").alias("largest"), F.sum(F.when(F.col("size") >= gate, F.col("size")).otherwise(0)).alias("gated"))
    two = groups.orderBy(F.desc("size")).limit(2).agg(F.when(F.count("*") > 1, F.min("size")).otherwise(0).alias("second"))
    return labels.crossJoin(sums).crossJoin(two)  # a row each


def cut_vertices(edges: DataFrame, component: str = "component") -> DataFrame:
    """(component, id, parts): nodes whose loss splits their component, and into how many parts.

    Edges of a large component are dealt over tasks, which keep of each share links with the same blocks, fewer than twice
    its nodes; shares double from round to round, until one is a component. So the last task of a component follows its
    nodes, not its edges.
    """
    ship(edges.sparkSession)
    kind = edges.schema[component].dataType

    def found(table: pa.Table) -> tuple[np.ndarray, Blocks]:
        ids, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in "ab"]), return_inverse=True)
        blocks = Blocks(len(ids))
        blocks.add(at[: table.num_rows], at[table.num_rows :])
        return ids, blocks

    def named(table: pa.Table, columns: dict[str, np.ndarray]) -> pa.Table:
        n = len(next(iter(columns.values())))
        return pa.table({component: pa.array([table.column(component)[0].as_py()], table.schema.field(component).type).take(pa.array(np.zeros(n, np.int64))), **columns})

    def fewer(table: pa.Table) -> pa.Table:
        ids, blocks = found(table)
        a, b = blocks.cycles()
        return named(table, {"a": ids[a].astype(np.int64), "b": ids[b].astype(np.int64)})

    def search(table: pa.Table) -> pa.Table:
        ids, blocks = found(table)
        parts = blocks.parts()
        cut = parts > 1
        return named(table, {"id": ids[cut].astype(np.int64), "parts": parts[cut].astype(np.int64)})

    key, left, room = f"{component} {kind.simpleString()}", written(edges.select(component, "a", "b"), "links"), FEW
    while True:
        sizes = left.groupBy(F.col(component).alias("__of")).agg(F.count("*").alias("__n")).filter(F.col("__n") > room)
        if sizes.isEmpty():
            break
        shares = F.pmod(F.xxhash64("a", "b"), F.ceil(F.col("__n") / room))
        dealt = left.join(F.broadcast(sizes), F.col(component).eqNullSafe(F.col("__of")), "left").select(component, "a", "b", F.coalesce(shares, F.lit(0)).alias("__share"))
        kept = written(dealt.groupBy(component, "__share").applyInArrow(fewer, f"{key}, a long, b long"), "links")
        removed(left)
        left, room = kept, room * 2
    return left.groupBy(component).applyInArrow(search, f"{key}, id long, parts long")
