"""Batches of similar length with the least padding.

The histogram of all lengths is counted on Spark. It has a row for each distinct length, of which t tokens allow at most
sqrt(2 t). A dynamic programme over it, in whole numbers, picks the at most `buckets` upper lengths that leave the least
padding in total. A text goes to the first bucket that holds it, is padded to the bucket's length, and batches take
`budget // length` texts (at least one) in the order of doc_id.

`pack_files` packs the token ids in a folder of `token_output`: lengths come from its chunk index, without the ids, and
`batches` reads these once, a row for each batch. `pack` takes texts: a length is the number of words and one end token, or
what a column of lengths says.

Places in a bucket are counted in ranges of rows by doc_id and length: each range by itself, then the ranges' totals,
as many as partitions and buckets, are summed, so that no task holds a bucket. Rows alike in both are dealt over ranges
by a hash of their number, as their places can be exchanged. Null and empty texts have the end token alone. Null doc_ids
come first; rows that share a doc_id are ordered by length. Repeated rows are packed each. Empty tables give no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _store, token_output


def n_tokens(text: str = "text") -> Column:
    """Words of a text, and one end token."""
    spaced = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return (F.size(F.array_remove(F.split(spaced, " "), "")) + 1).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets with the least sum of (upper length - length) over all texts."""
    order = np.argsort(lengths)
    lengths, counts = [int(x) for x in lengths[order]], [int(x) for x in counts[order]]
    n = len(lengths)
    if n <= buckets:
        return lengths
    upto = [0, *accumulate(counts)]
    best = [0, *(x * c for x, c in zip(lengths, upto[1:], strict=True))]  # of the first j lengths in one bucket; padded tokens in all
    picks = []
    for _ in range(1, buckets):
        # for each j the least best[i] - lengths[j - 1] * upto[i] over i < j: lines of falling slope, asked from left to right
        new, pick, hull, at = best.copy(), [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1
            while len(hull) > 1 and (best[i] - best[hull[-2]]) * (upto[hull[-1]] - upto[hull[-2]]) <= (best[hull[-1]] - best[hull[-2]]) * (upto[i] - upto[hull[-2]]):
                hull.pop()
            hull.append(i)
            at, x = min(at, len(hull) - 1), lengths[j - 1]
            while at + 1 < len(hull) and best[hull[at + 1]] - x * upto[hull[at + 1]] < best[hull[at]] - x * upto[hull[at]]:
                at += 1
            pick[j] = hull[at]
            new[j] = best[hull[at]] + x * (upto[j] - upto[hull[at]])
        best = new
        picks.append(pick)
    out, j = [], n
    for pick in reversed(picks):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = pick[j]
    if j:
        out.append(lengths[j - 1])
    return sorted(set(out))


def ranges(sized: DataFrame) -> DataFrame:
    """The rows of sized (doc_id, n_tokens, ...) and their range, which ascends by both; written, as ranges are drawn from samples."""
    dealt = sized.withColumn("tie", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange("doc_id", "n_tokens", "tie")
    return _store.written(dealt.drop("tie").withColumn("range", F.spark_partition_id()), "packing-ranges")


def place(sized: DataFrame, buckets: int, budget: int) -> DataFrame:
    """The rows of sized (doc_id, n_tokens, ...), a written table, with bucket, bucket_tokens, batch, slot, padding."""
    histogram = sized.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n")).toPandas()
    bounds = boundaries(histogram["length"].to_numpy(), histogram["n"].to_numpy(), buckets) or [1]
    bucket = sum(((F.col("n_tokens") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    rows = ranges(sized).withColumn("bucket", bucket)
    in_range = Window.partitionBy("bucket", "range").orderBy("doc_id", "n_tokens")
    before = Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("bucket", "range").agg(F.count("*").alias("n")).select(F.col("bucket").alias("b"), F.col("range").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = rows.withColumn("at", F.row_number().over(in_range) - 1)
    placed = ranked.join(F.broadcast(offsets), (F.col("bucket") == F.col("b")) & (F.col("range") == F.col("k")))
    length = F.element_at(F.array(*[F.lit(int(b)).cast("long") for b in bounds]), F.col("bucket") + 1)
    per, at = F.greatest(F.lit(1).cast("long"), F.floor(budget / length)), F.col("offset") + F.col("at")
    return placed.select(
        *sized.columns,
        "bucket",
        length.alias("bucket_tokens"),
        F.floor(at / per).alias("batch"),
        F.pmod(at, per).alias("slot"),
        (length - F.col("n_tokens")).alias("padding"),
    )


def pack(docs: DataFrame, buckets: int = 8, budget: int = 16_384, tokens: str | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch (number in its bucket), slot, padding: a row for each row of docs."""
    length = F.greatest(F.lit(1).cast("long"), F.col(tokens).cast("long")) if tokens else n_tokens()
    # written, so that lengths are counted once and rows keep their numbers
    sized = _store.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("n_tokens")), "packing-lengths")
    return place(sized, buckets, budget)


def pack_files(spark: SparkSession, path: str, buckets: int = 8, budget: int = 16_384) -> DataFrame:
    """doc_id, n_tokens, shard, ordinal (the document in the files), and its place as `pack` gives it, of each document in the files."""
    sized = token_output.lengths(spark, path).select("doc_id", "n_tokens", "shard", "ordinal")
    return place(_store.written(sized, "packing-lengths"), buckets, budget)


def batches(spark: SparkSession, path: str, placed: DataFrame) -> DataFrame:
    """bucket, batch, bucket_tokens, docs (slot, doc_id, ids in order): a row for each batch of pack_files, which holds its budget or one text."""
    whole = token_output.read(spark, path).groupBy("shard", "ordinal").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "begin", "ids"))), lambda p: p["ids"])).alias("ids"))
    rows = placed.join(whole, ["shard", "ordinal"])
    return rows.groupBy("bucket", "batch", "bucket_tokens").agg(F.sort_array(F.collect_list(F.struct("slot", "doc_id", "ids"))).alias("docs"))
