"""Counts of many hashes over blocks of documents, in packed rows whose number is linear in the input.

A block sends its sorted hashes in a fixed number of rows, one for each range of hashes (`fan_bits`), as differences by
byte planes, compressed. Rows of one range meet in groups of a bounded number of hashes, which sum their counts. Where
a range has several groups, each sends its merged hashes on, cut into finer ranges in the same way, until a range has
one group; the totals then come back the same way. Each level merges thousands of groups, so hashes travel once for each
power of some thousand in the input's size, and at every level the rows hold thousands of hashes each. A hash comes to
a group at most once for each row, however often documents have it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store

#: Hashes of a group, about; and how finely a level's ranges are cut at most, in bits.
GROUP_KEYS = 1 << 22
MAX_BITS = 10
ASK = pa.schema([("path", pa.int64()), ("child", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])
ASK_SQL = "path long, child long, keys binary, n binary"
TOTALS_SQL = "path long, child long, totals binary, types long"


def zipped(x: np.ndarray, level: int = 1) -> bytes:
    """An integer array by byte planes."""
    raw = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=level).compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes())


def unzipped(x: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def zipped_sorted(x: np.ndarray) -> bytes:
    return zipped(np.diff(x, prepend=np.uint64(0)))


def unzipped_sorted(x: bytes) -> np.ndarray:
    return np.cumsum(unzipped(x, np.uint64), dtype=np.uint64)


def fan_bits(keys: int) -> int:
    """Bits of a level's ranges for so many hashes in all blocks."""
    return min(MAX_BITS, max(2, math.ceil(math.log2(max(1, 4 * keys / GROUP_KEYS)))))


def spans(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(path, from, to) of sorted hashes: the ranges that they have, by their upper `bits` bits."""
    path = keys >> np.uint64(64 - bits)
    at = np.flatnonzero(np.diff(path, prepend=path[:1] ^ np.uint64(1))).tolist()
    return [(int(path[lo]), lo, hi) for lo, hi in zip(at, [*at[1:], len(keys)][: len(at)], strict=True)]


def asked(child: int, keys: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted hashes and their counts, in rows."""
    rows = spans(keys, bits)
    columns = [[p for p, _, _ in rows], [child] * len(rows), [zipped_sorted(keys[lo:hi]) for _, lo, hi in rows], [zipped(n[lo:hi].astype(np.int64)) for _, lo, hi in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ASK, strict=True)], schema=ASK)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """A group's distinct hashes, their sums, where each row's hashes are among them, and the ends of rows."""
    keys = [unzipped_sorted(k) for k in table.column("keys").to_pylist()]
    n = np.concatenate([unzipped(x, np.int64) for x in table.column("n").to_pylist()])
    known, back = np.unique(np.concatenate(keys), return_inverse=True)
    return known, np.bincount(back, weights=n, minlength=len(known)).astype(np.int64), back, np.cumsum([len(k) for k in keys]).tolist()


def _given(table: pa.Table, total: np.ndarray, back: np.ndarray, ends: list[int], types: int) -> pa.Table:
    rows = [zipped(total[back[lo:hi]]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.table([table.column("path"), table.column("child"), pa.array(rows, pa.binary()), pa.array([types, *[0] * (len(ends) - 1)], pa.int64())], ["path", "child", "totals", "types"])


def _sums(table: pa.Table) -> pa.Table:
    """Totals of a range's hashes, given back to each row in the order asked; and how many odd hashes have some, once."""
    known, total, back, ends = _merged(table)
    return _given(table, total, back, ends, int(((known & np.uint64(1)) & (total > 0)).sum()))


def _finer(bits: int):
    def run(table: pa.Table) -> pa.Table:
        known, total, _, _ = _merged(table)
        return pa.Table.from_batches([asked(table.column("grp")[0].as_py(), known, total, bits)])

    return run


def _shared(left: pa.Table, right: pa.Table) -> pa.Table:
    """The totals of a group's merged hashes, as ranges in order, given to its rows."""
    if not left.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64())], ["path", "child", "totals", "types"])
    _, _, back, ends = _merged(left)
    right = right.sort_by("finer")
    total = np.concatenate([unzipped(x, np.int64) for x in right.column("totals").to_pylist()])
    return _given(left, total, back, ends, sum(right.column("types").to_pylist()))


def totals(rows: DataFrame, keys: int, bits: int) -> DataFrame:
    """path, child, totals (of each row's hashes over all rows, in the order asked), types (of a group, in one of its rows).

    rows: path, child, keys, n as `asked` gives them, the same each time; keys: how many hashes there are in all rows, about.
    """
    return _level(rows, math.ceil(keys / 2**bits / GROUP_KEYS), bits, 1)


def _level(rows: DataFrame, groups: int, bits: int, level: int) -> DataFrame:
    if groups <= 1:
        return rows.groupBy("path").applyInArrow(_sums, TOTALS_SQL)
    dealt = _store.written(rows, "packed").withColumn("grp", F.pmod(F.xxhash64("child"), F.lit(groups)))
    finer = dealt.groupBy("path", "grp").applyInArrow(_finer(bits * (level + 1)), ASK_SQL)
    # a range's groups merge 2**bits at a time, as each of them cuts its hashes that finely
    above = _level(finer, math.ceil(groups / 2**bits), bits, level + 1)
    found = above.select(F.col("path").alias("finer"), F.shiftright("path", bits).alias("path"), F.col("child").alias("grp"), "totals", "types")
    return dealt.groupBy("path", "grp").cogroup(found.groupBy("path", "grp")).applyInArrow(_shared, TOTALS_SQL)
