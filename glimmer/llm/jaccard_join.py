"""Near duplicates by a Jaccard join of word shingles in prefix trees.

A document's set holds its distinct shingles of `SHINGLE` words (A-Z lower-cased; fewer words are one shingle; no words
are none, linked with nothing). Two documents are linked when 100 * intersection >= 80 * union. Shingles are 64-bit
hashes, sets are told apart by 128 bits of hashes of their shingles; documents with equal sets are one node.

1. A filter without false negatives finds nodes that can have a link: of each set's smallest hashes, so many are looked
   up that two linked documents share at least a fixed number of them. Blocks of documents ask for the totals of their
   hashes (`_packed`) and learn which ones another document has too. Most documents end here; their texts never shuffle.
2. How many of these sets have each shingle is counted in the same packed way. The global order is rare shingles first:
   a linked pair shares one of the first `n - ceil(0.8 n) + 1` shingles of both, and a set with that many shingles of
   its own ends here. Groups of a shingle's sets go into a prefix tree: sets with the same beginning share their overlaps
   with a probe, and subtrees are left where the remaining lengths can't reach the similarity. A first round takes
   those two shingles of each prefix that most sets share; components of its links then settle most other groups, as
   nothing new can be found in a group that lies in one component. A second round takes all groups that are left, those with the
   same members once.
3. Groups larger than `LIMIT` sets are split into parts at random in the first round; in the second one every set outside the
   group's largest component meets every part. So no task holds a group, no pair is lost, and copies are never paired.

Repeated
rows are documents of their own with equal sets. Null doc_ids take part, but name no component unless alone in it. Other
columns are carried on by `keep_one`. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.operators.clustering import linked

from . import _store, _text
from ._packed import ASK_SQL, asked, fan_bits, spans, totals, unzipped, unzipped_sorted, zipped, zipped_sorted

SHINGLE = 5
BLOCK_TOKENS = 1 << 19
#: Sets and shingles that one prefix tree holds at most, about.
LIMIT, LIMIT_SHINGLES = 2000, 1_000_000
#: Bits of a shingle's hash below the six of its grade, in the global order.
CODE_BITS = np.uint64(58)


def least_overlap(n):
    """ceil(0.8 n): what a set of n shares at least with each linked one."""
    return -(-4 * n // 5)


def sets_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their numbers."""
    w = _text.split(texts, _text.WORDS_LOWER)
    h, firsts, n = w.hashes(), w.firsts, len(w.counts)
    owner = np.repeat(np.arange(n), w.counts)
    room = firsts[1:][owner] - np.arange(len(h))
    at = np.flatnonzero(room >= SHINGLE)
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    value = np.concatenate([_text.spans_hash(h, at, at + SHINGLE), _text.spans_hash(h, firsts[short], firsts[short + 1])])
    owner = np.concatenate([owner[at], short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=n)


def _nodes(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set."""
    ends = np.cumsum(sizes)
    return [_text.spans_hash(_text.mix(values ^ np.uint64(seed)), ends - sizes, ends).view(np.int64) for seed in (0, 0x5851F42D4C957F2D)]


_LISTS = ("doc_id", "tag", "x", "y", "n")
_BLOCK = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary()), ("places", pa.binary()), *[(c, pa.list_(pa.int64())) for c in _LISTS]])
_BLOCK_SQL = "block long, size long, keys binary, counts binary, owners binary, places binary, " + ", ".join(f"{c} array<long>" for c in _LISTS)


def _look_up(block_tokens: int):
    """Blocks of documents: the sorted hashes to look up, how many documents have each, and which (owners, places of the hashes)."""

    def close(held: list, block: int) -> pa.RecordBatch:
        ids, tags = ([x for part in held for x in part[i]] for i in (0, 1))
        values, sizes = np.concatenate([p[2] for p in held]), np.concatenate([p[3] for p in held])
        ends = np.cumsum(sizes)
        place = np.arange(len(values)) - np.repeat(ends - sizes, sizes)
        wanted = sizes - least_overlap(sizes) + np.maximum(1, sizes // 5)
        own = place < np.repeat(wanted, sizes)
        # the smallest hashes lie close together, so they are mixed again for their ranges
        keys, back, counts = np.unique(_text.mix(values[own]), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)[own]
        x, y = _nodes(values, sizes)
        row = {"block": block, "size": len(keys), "keys": zipped_sorted(keys), "counts": zipped(counts.astype(np.uint32)), "owners": zipped(np.bincount(owner, minlength=len(sizes)).astype(np.uint32)), "places": zipped(back.astype(np.uint32))}
        return pa.RecordBatch.from_pylist([row | {"doc_id": ids, "tag": tags, "x": x.tolist(), "y": y.tolist(), "n": sizes.tolist()}], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in _text.slices(batch, "text"):
                values, sizes = sets_of(part.column("text"))
                held.append((part.column("doc_id").to_pylist(), part.column("tag").to_pylist(), values, sizes))
                n += len(values) + len(sizes)
                if n >= block_tokens:
                    yield close(held, block)
                    held, n, block = [], 0, block + 1
        if held:
            yield close(held, block)

    return run


def _ask(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("block", "keys", "counts")], strict=True):
                yield asked(block, unzipped_sorted(keys), unzipped(counts, np.uint32), bits)

    return run


def _answered(keys: np.ndarray, right: pa.Table, bits: int) -> np.ndarray:
    """Totals of a block's sorted hashes."""
    given = dict(zip(right.column("path").to_pylist(), right.column("totals").to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, np.int64), *[unzipped(given[path], np.int64) for path, _, _ in spans(keys, bits)]])


def _settle(bits: int):
    """Whether each document of a block can have a link."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            total = _answered(unzipped_sorted(row["keys"]), right, bits)
            n, owners = np.array(row["n"], np.int64), unzipped(row["owners"], np.uint32).astype(np.int64)
            shared = np.concatenate(([0], np.cumsum(total[unzipped(row["places"], np.uint32)] > 1)))
            ends = np.cumsum(owners)
            near = (n > 0) & (shared[ends] - shared[ends - owners] >= np.maximum(1, least_overlap(n) // 5))
            out.append(pa.table([*[pa.array(row[c], pa.int64()) for c in _LISTS], pa.array(near)], ["doc_id", "tag", "x", "y", "n_shingles", "near"]))
        return pa.concat_tables(out)

    return run


def _candidates(docs: DataFrame) -> DataFrame:
    """doc_id, tag, x, y (the set's hashes), n_shingles, near of each row of docs (doc_id, tag, text)."""
    blocks = _store.written(docs.select("doc_id", "tag", "text").mapInArrow(_look_up(BLOCK_TOKENS), _BLOCK_SQL), "near-blocks")
    keys = blocks.agg(F.sum("size")).first()[0] or 0
    bits = fan_bits(keys)
    answers = totals(blocks.select("block", "keys", "counts").mapInArrow(_ask(bits), ASK_SQL), keys, bits)
    asks = answers.select(F.col("child").alias("block"), "path", "totals").groupBy("block")
    found = blocks.drop("size", "counts").groupBy("block").cogroup(asks).applyInArrow(_settle(bits), "doc_id long, tag long, x long, y long, n_shingles long, near boolean")
    found = _store.written(found, "near-candidates")
    _store.removed(blocks)
    return found


def _packed_sets(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in _text.slices(batch, "text"):
                values, sizes = sets_of(part.column("text"))
                ends = np.cumsum(sizes)
                packed = [zipped_sorted(values[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), block)), *map(pa.array, _nodes(values, sizes)), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["block", "x", "y", "n", "shingles"])
                held += len(values)
                if held >= block_tokens:
                    held, block = 0, block + 1

    return run


def _block_keys(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The sets of a block, its distinct shingles, and how many of its nodes have each."""
    sets = [unzipped_sorted(x) for x in table.column("shingles").to_pylist()]
    once = dict(zip(zip(table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True), sets, strict=True))  # rows that are alike are one node
    keys, n = np.unique(np.concatenate(list(once.values())), return_counts=True)
    return sets, keys, n


def _ask_counts(bits: int):
    def run(table: pa.Table) -> pa.Table:
        _, keys, n = _block_keys(table)
        return pa.Table.from_batches([asked(table.column("block")[0].as_py(), keys, n, bits)])

    return run


def _order_sets(bits: int):
    """Sets in the global order, without the shingles that no other set has: those are only counted in n.

    An order code has the class of a shingle's count (powers of two) above `CODE_BITS` bits of its hash. `first` says how
    many of the codes belong to the set's prefix.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        out = []
        if left.num_rows:
            sets, keys, _ = _block_keys(left)
            total = _answered(keys, right, bits)
            grade = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint64)  # 63 at most
            codes = (grade << CODE_BITS) | (keys >> (np.uint64(64) - CODE_BITS))
            for x, y, n, values in zip(*[left.column(c).to_pylist() for c in ("x", "y", "n")], sets, strict=True):
                at = np.searchsorted(keys, values)
                shared = np.sort(codes[at[total[at] > 1]])
                first = n - least_overlap(n) + 1 - (n - len(shared))
                if first > 0:
                    out.append((x, y, n, first, zipped_sorted(shared)))
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["x", "y", "n", "first", "codes"])

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for node, n, first, x in zip(*[batch.column(c).to_pylist() for c in ("node", "n", "first", "codes")], strict=True):
            keys = unzipped_sorted(x)[:first]
            out.append((keys.view(np.int64), np.full(len(keys), node), np.full(len(keys), n), np.arange(len(keys))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "node", "n", "place"])


class Node:
    """Part of a set's beginning; of the sets below: the least size, the most codes, one of them, and whether there may be several components."""

    __slots__ = ("part", "next", "ends", "least", "most", "one", "mixed")

    def __init__(self, part: np.ndarray, least: int, most: int, one: int) -> None:
        self.part, self.next, self.ends = part, {}, []
        self.least, self.most, self.one, self.mixed = least, most, one, False


class PrefixTree:
    """Sets as codes in global order (and sizes, as codes leave out what no other set has), with shared beginnings.

    Finds sets of other components that are similar to a given one.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int], component: list[int]) -> None:
        self.sets, self.sizes, self.root = sets, sizes, None
        first: dict[int, int] = {}
        self.parent = [first.setdefault(c, i) for i, c in enumerate(component)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def insert(self, i: int) -> None:
        x, n, mine, at = self.sets[i], self.sizes[i], self.find(i), 0
        if self.root is None:
            self.root = Node(x[:0], n, len(x), i)
        node = self.root
        while True:
            node.least, node.most = min(node.least, n), max(node.most, len(x))
            if self.find(node.one) != mine:
                node.mixed = True
            if at == len(x):
                node.ends.append(i)
                return
            child = node.next.get(int(x[at]))
            if child is None:
                new = Node(x[at:], n, len(x), i)
                new.ends.append(i)
                node.next[int(x[at])] = new
                return
            k = min(len(child.part), len(x) - at)
            differ = np.flatnonzero(child.part[:k] != x[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(child.part):  # the child keeps its end, and a new node its beginning
                upper = Node(child.part[:same], child.least, child.most, child.one)
                upper.mixed = child.mixed
                child.part = child.part[same:]
                upper.next[int(child.part[0])] = child
                node.next[int(x[at])] = upper
                child = upper
            node, at = child, at + same

    def link(self, i: int) -> list[int]:
        """Sets similar to set i, one at least of each component but its own that has one; they become one component."""
        found: list[int] = []
        if self.root is None:
            return found
        x, n = self.sets[i], self.sizes[i]
        stack = [(self.root, 0, 0, 0)]  # a node, and before it: codes in common, of the path, of x
        while stack:
            node, common, depth, used = stack.pop()
            if not node.mixed and self.find(node.one) == self.find(i):
                continue
            part, dead = node.part, False
            for k in range(0, len(part), 128):
                some = part[k : k + 128]
                at = np.searchsorted(x, some)
                hit = (at < len(x)) & (x[np.minimum(at, len(x) - 1)] == some)
                common, depth, used = common + int(hit.sum()), depth + len(some), int(at[-1]) + int(hit[-1])
                if 9 * (common + min(len(x) - used, node.most - depth)) < 4 * (n + node.least):
                    dead = True
                    break
            if dead:
                continue
            for other in node.ends:
                if 9 * common >= 4 * (n + self.sizes[other]) and self.find(other) != self.find(i):
                    found.append(other)
                    self.parent[self.find(other)] = self.find(i)
            own = None
            for first, child in node.next.items():
                if used < len(x) and first == int(x[used]):
                    own = child  # likeliest, so it is looked at first
                else:
                    stack.append((child, common, depth, used))
            if own is not None:
                stack.append((own, common, depth, used))
        return found


def _join(table: pa.Table) -> pa.Table:
    """Links within a group: of probes with members, or among members where all are probes too."""
    nodes, sizes, component, probe = (table.column(c).to_pylist() for c in ("node", "n", "component", "probe"))
    sets = [unzipped_sorted(x) for x in table.column("codes").to_pylist()]
    order = sorted(range(len(sets)), key=lambda i: (sizes[i], nodes[i]))
    tree = PrefixTree(sets, sizes, component)
    out = []
    alone = not any(p == 2 for p in probe)
    for i in order:
        if alone:
            out += [(nodes[i], nodes[j]) for j in tree.link(i)]
        if probe[i] != 2:
            tree.insert(i)
    if not alone:
        for i in order:
            if probe[i] == 2:
                out += [(nodes[i], nodes[j]) for j in tree.link(i)]
    # each linked set with the smallest one of its component here, so that components are near their smallest node
    place = {node: i for i, node in enumerate(nodes)}
    tied = sorted({place[x] for pair in out for x in pair}, key=lambda i: nodes[i])
    low: dict[int, int] = {}
    ends = [(nodes[i], low.setdefault(tree.find(i), nodes[i])) for i in tied]
    return pa.table([pa.array([a for a, _ in ends], pa.int64()), pa.array([b for _, b in ends], pa.int64())], ["a", "b"])


def _in_groups(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the groups that rows (key, part, block, node, component, probe) make, written."""
    with_sets = rows.join(sets.select("node", "n", "codes"), "node").select("key", "part", "block", "node", "n", "component", "probe", "codes")
    return _store.written(with_sets.groupBy("key", "part", "block").applyInArrow(_join, "a long, b long"), "near-links")


def _parts(n, shingles):
    return F.ceil(F.greatest(n / LIMIT, shingles / LIMIT_SHINGLES)).cast("int")


def _same_nodes():
    """x, y: aggregates that groups of equal nodes share. No arithmetic, as that may leave the range of long."""
    return [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]


def _links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Components (x, y, component) of the sets with a link to a different one."""
    chosen = found.filter("near").groupBy("x", "y").agg(F.min(F.struct("doc_id", "tag")).alias("c")).select(F.col("c.doc_id").alias("id"), F.col("c.tag").alias("t"))
    texts = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["id"]) & (docs["tag"] == chosen["t"]), "left_semi")
    packed = _store.written(texts.select("text").mapInArrow(_packed_sets(BLOCK_TOKENS), "block long, x long, y long, n long, shingles binary"), "near-sets")
    keys = packed.agg(F.sum("n")).first()[0] or 0
    bits = fan_bits(keys)
    counts = totals(packed.groupBy("block").applyInArrow(_ask_counts(bits), ASK_SQL), keys, bits)
    asks = counts.select(F.col("child").alias("block"), "path", "totals").groupBy("block")
    ordered = packed.groupBy("block").cogroup(asks).applyInArrow(_order_sets(bits), "x long, y long, n long, first long, codes binary")
    # written with a number for each node, by which all that follows goes
    sets = _store.written(ordered.dropDuplicates(["x", "y"]).withColumn("node", F.monotonically_increasing_id()), "near-ordered")
    _store.removed(packed)
    starts = sets.mapInArrow(_prefixes, "key long, node long, n long, place long")
    shared = starts.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("size")).filter("members > 1")
    rows = _store.written(starts.join(shared, "key"), "near-prefixes")
    first = rows.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("members")).alias("m"), "place", "key", "members", "size"))), 1, 2).alias("k")).select("node", F.explode("k").alias("k"))
    part = F.pmod(F.xxhash64("node", "key"), _parts(F.col("members"), F.col("size"))).cast("int")
    one = first.select("node", "k.key", "k.members", "k.size").select("key", part.alias("part"), F.lit(0).alias("block"), "node", F.col("node").alias("component"), F.lit(1).alias("probe"))
    links = _in_groups(one, sets)
    labels = linked(links).withColumnRenamed("id", "node")
    labelled = rows.select("key", "node", "members", "size").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = labelled.groupBy("key").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.first("members").alias("members"),
        F.first("size").alias("size"),
        *_same_nodes(),
    )
    left = groups.filter("low <> high").groupBy("members", "size", "x", "y").agg(F.min("key").alias("key"))
    open_rows = _store.written(labelled.drop("members", "size").join(left.select("key", "members", "size"), "key"), "near-open")
    small = open_rows.withColumn("parts", _parts(F.col("members"), F.col("size")))
    whole = small.filter("parts = 1").select("key", F.lit(0).alias("part"), F.lit(0).alias("block"), "node", "component", F.lit(1).alias("probe"))
    large = small.filter("parts > 1")
    sizes = large.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum(F.lit(1)).alias("s"))
    largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), (F.sum("c") - F.max("c")).alias("others"))
    split = large.join(largest, "key").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("others") * F.col("parts") / F.col("members"))).cast("int"))
    member = split.select("key", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "component", F.lit(1).alias("probe"))
    probes = split.filter("component <> largest").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.hash("node"), "blocks").cast("int").alias("block"), "node", "component", F.lit(2).alias("probe"))
    more = _in_groups(whole.unionByName(member).unionByName(probes), sets)
    labels = linked(links.unionByName(more)).withColumnRenamed("id", "node")
    return labels.join(sets.select("node", "x", "y"), "node").select("x", "y", "component")


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text, tag: which tells rows apart that share a doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, tag, n_shingles, component (null: no link), component_id, for each row of docs."""
    _store.small_batches(docs.sparkSession)
    own = _tagged(docs)
    found = _candidates(own)
    labels = _links(own, found)
    near = found.filter("near").groupBy("x", "y").agg(F.min("doc_id").alias("low"))
    nodes = near.join(labels, ["x", "y"], "left").withColumn("component", F.when(F.col("component").isNotNull(), F.struct(F.lit(0).alias("kind"), F.col("component").alias("p"), F.col("component").alias("q"))).otherwise(F.struct(F.lit(1).alias("kind"), F.col("x").alias("p"), F.col("y").alias("q"))))
    lows = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = nodes.join(lows, "component").select(F.col("x").alias("near_x"), F.col("y").alias("near_y"), "component", "component_id")
    all_rows = found.withColumns({"near_x": F.when(F.col("near"), F.col("x")), "near_y": F.when(F.col("near"), F.col("y"))}).join(named, ["near_x", "near_y"], "left")
    return all_rows.select("doc_id", "tag", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to), for each row of docs."""
    return _classes(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs with their own columns; of each component the row with the smallest doc_id stays."""
    found = _store.written(_classes(docs), "near-classes")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "tag")
    best = found.filter("component IS NOT NULL").groupBy(F.col("component").alias("c")).agg(F.min(order).alias("best"))
    id_, tag, own = _store.names(docs, "id", "tag", "own")
    lost = found.join(best, F.col("component") == F.col("c")).filter(order != F.col("best")).select(F.col("doc_id").alias(id_), F.col("tag").alias(tag)).distinct()
    rows = docs.withColumn(own, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(tag))
    stays = rows.join(lost, same, "left_anti")
    # rows that are alike in doc_id and text are one document, unless they have no words
    again = found.filter("component IS NOT NULL").groupBy(F.col("doc_id").alias(id_), F.col("tag").alias(tag)).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    if not again.limit(1).count():
        return stays.drop(own)
    single = stays.join(again, same, "left_anti")
    return single.unionByName(stays.join(again, same, "left_semi").dropDuplicates(["doc_id", own])).drop(own)
