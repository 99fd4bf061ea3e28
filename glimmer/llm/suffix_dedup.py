"""Repeated byte strings across documents, by suffix arrays that deep-shallow sorting builds.

Texts are UTF-8 bytes. Whatever `n` bytes also start in a document with a smaller doc_id lose all bytes that they cover;
overlaps count, strings are judged on the input, and none crosses documents. Since only matches of `n` bytes count,
suffixes are ordered by their first `n` bytes.

* Texts are cut into pieces of bounded size, which overlap by `n` - 1 bytes, and pieces make blocks. So no task holds a
  long text.
* The anchor of a suffix is the smallest hash of the `ANCHOR`-byte strings in its first `n` bytes: equal strings have equal
  anchors. Blocks count their anchors together (`_packed`); only suffixes whose anchor has several places somewhere go on.
* Each block sorts these suffixes. Of those with equal first bytes the ones outside the group's smallest document are
  marked at once, and one of that document travels: neighbours with one anchor as one packed string, to the bucket that
  the anchor names. An anchor with more than `HOT` places is dealt by each suffix's own bytes instead, so that no bucket
  grows with a frequent phrase, and a passage comes to its bucket once a block, however many documents have it.
* Each bucket sorts what it gets, and marks what starts in a smaller document as well.

Sorting (`deep_shallow`): multikey quicksort takes eight bytes as one character, then five; groups that share a character
go on to the next one, down to `SHALLOW` bytes. Groups that are still together there become blind tries, all groups of a level at
once: a suffix is compared with its trie's first leaf alone, and the place and byte of the first difference name its branch.

Null and empty texts have no bytes. Null doc_id is the smallest. Rows that share a doc_id are one document, each with its
own bytes: they don't repeat each other. Empty tables give no rows. Other columns are carried on by `drop_repeats`.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _packed, _store, _text

WINDOW = 50
ANCHOR = 24
#: Bytes that multikey quicksort orders by, at least.
SHALLOW = 18
BLOCK_BYTES = 1 << 20
PIECE_BYTES = 1 << 19
#: Bytes of packed strings that a bucket gets, about.
BUCKET_BYTES = 4 << 20
#: Places of an anchor beyond which its suffixes are dealt one by one.
HOT = 4096
_NULL = -(2**63)
_SALT = np.uint64(0x5851F42D4C957F2D)


def _characters(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros stand after the end."""
    out = np.concatenate((data, np.zeros(64, np.uint8))).astype(np.uint64)
    for span in (1, 2, 4):
        out = (out[:-span] << np.uint64(8 * span)) | out[span:]
    return out


def _multikey(chars: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first min(n, SHALLOW) bytes, and whether each one begins a group of equal ones.

    The first character has eight bytes, further ones five, so that a group's number and a character fit 64 bits.
    """
    order, first, done, size = np.argsort(chars[at]), np.zeros(len(at), bool), 0, 8
    first[:1] = True
    while True:
        key = chars[at[order] + done] >> np.uint64(64 - 8 * size)
        first[1:] |= key[1:] != key[:-1]
        done, size = done + size, min(5, n - done - size)
        if done >= SHALLOW or size <= 0:
            return order, first
        group = np.cumsum(first) - 1
        some = np.flatnonzero(np.bincount(group)[group] > 1)
        inner = np.argsort(group[some].astype(np.uint64) << np.uint64(40) | chars[at[order[some]] + done] >> np.uint64(24))
        order[some] = order[some][inner]


def _branches(chars: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, n: int) -> np.ndarray:
    """Where suffixes a leave the leaves b of their tries, as a number that orders them: n bytes alike give the middle one."""
    out = np.full(len(a), 1 << 14, np.int64)
    todo = np.arange(len(a))
    for d in range(depth, n, 8):
        x, y = chars[a[todo] + d], chars[b[todo] + d]
        if n - d < 8:
            past = np.uint64(8 * (8 - n + d))
            x, y = x >> past << past, y >> past << past
        apart = np.flatnonzero(x != y)
        if len(apart):
            x, y = x[apart], y[apart]
            diff, skip = x ^ y, np.zeros(len(apart), np.int64)
            for s in (32, 16, 8):
                high = (diff >> np.uint64(64 - s)) == 0
                skip[high] += s // 8
                diff[high] <<= np.uint64(s)
            byte = ((x >> (np.uint64(56) - np.uint64(8) * skip.astype(np.uint64))) & np.uint64(255)).astype(np.int64)
            place = d + skip
            # before the leaf: the sooner apart the smaller; after it: the sooner apart the larger
            out[todo[apart]] = np.where(x < y, place * 256 + byte, (1 << 14) + 1 + (63 - place) * 256 + byte)
            todo = np.delete(todo, apart)
    return out


def deep_shallow(data: np.ndarray, at: np.ndarray, n: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of data that begin at `at` by their first n bytes (63 at most), and which begin a new group
    of suffixes alike in these."""
    chars = _characters(data)
    order, first = _multikey(chars, at, n)
    first = np.append(first, True)
    lo = np.flatnonzero(first[:-1] & ~first[1:])  # groups of several, by their places in the order
    hi = np.flatnonzero(first[1:] & ~first[:-1]) + 1
    while len(lo):
        sizes = hi - lo
        trie = np.repeat(np.arange(len(lo)), sizes)
        spot = np.arange(int(sizes.sum())) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)
        own = at[order[spot]]
        branch = _branches(chars, own, at[order[lo]][trie], min(SHALLOW, n), n)
        key = trie << 16 | branch
        if (branch != 1 << 14).any():
            inner = np.argsort(key)
            order[spot] = order[spot][inner]
            key = key[inner]
        new = np.append(np.diff(key, prepend=-1) != 0, True)
        first[spot] |= new[:-1]
        begins, ends = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:]) + 1
        more = (ends - begins > 1) & (key[begins] & 0xFFFF != 1 << 14)  # a branch of several is a trie of the next level
        lo, hi = spot[begins[more]], spot[ends[more] - 1] + 1
    return order, first[:-1]


def _hashes(chars: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
    """A hash of the `size` bytes (8 at least) from each place of `at`."""
    view = (lambda d: chars[at + d]) if isinstance(at, np.ndarray) else (lambda d: chars[at.start + d : at.stop + d])
    out = view(0)
    with np.errstate(over="ignore"):
        for d in [*range(8, size - 7, 8), *([size - 8] if size % 8 else [])]:
            out = (out ^ (out >> np.uint64(29))) * _text._P + view(d)
    return _text.mix(out ^ _SALT)


def _anchors(data: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from which n bytes of one piece follow (room: bytes to its end), and the smallest hash of an anchor's bytes in each."""
    at, k = np.flatnonzero(room >= n), min(ANCHOR, n)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    low = _hashes(_characters(data), slice(0, len(data) - k + 1), k)
    width, span = n - k + 1, 1
    while span < width:  # minima of twice as many hashes each time
        step = min(span, width - span)
        low = np.minimum(low[: len(low) - step], low[step:])
        span += step
    return at, low[at]


def _counted(at: np.ndarray, low: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct anchors, as many bits of each as tell enough of them apart, and in how many runs of places they are."""
    run = np.ones(len(at), bool)
    run[1:] = (low[1:] != low[:-1]) | (np.diff(at) != 1)
    return np.unique(low[run] & mask, return_counts=True)


class Pieces:
    """Pieces of documents in one place: each with its doc_id and its first byte's place in the document."""

    def __init__(self, doc: np.ndarray, start: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> None:
        self.doc, self.data = doc, data
        self.ends = np.cumsum(sizes)
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.shift = start - (self.ends - sizes)

    @property
    def room(self) -> np.ndarray:
        """Bytes from each place to its piece's end."""
        return self.ends[self.owner] - np.arange(len(self.data))

    def place(self, at: np.ndarray) -> np.ndarray:
        return at + self.shift[self.owner[at]]

    def runs(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted places whose n bytes go, as runs: the piece, and first and last byte in the document."""
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(self.owner[at]) != 0))
        lo, hi = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]
        return self.owner[lo], self.place(lo), self.place(hi) + n

    def ranked(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes in order, the smallest document that has each one's bytes, and the number of the group alike."""
        order, first = deep_shallow(self.data, at, n)
        own = self.doc[self.owner[at[order]]]
        least = np.minimum.reduceat(own, np.flatnonzero(first)) if len(own) else own
        group = np.cumsum(first) - 1
        return order, least[group], group


_BLOCK = pa.schema([("block", pa.int64()), ("pieces", pa.binary()), ("data", pa.binary()), ("size", pa.int64())])
_BLOCK_SQL = "block long, pieces binary, data binary, size long"
_PACKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), *[(c, pa.binary()) for c in ("numbers", "data", "marks")]])
_PACKED_SQL = "bucket long, block long, numbers binary, data binary, marks binary"
_MARKS = pa.schema([("block", pa.int64()), ("marks", pa.binary())])


@functools.cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _squeezed(data: bytes) -> bytes:
    return _codec()[0].compress(data)


def _unsqueezed(data: bytes) -> np.ndarray:
    return np.frombuffer(_codec()[1].decompress(data), np.uint8)


def _numbers(*columns: np.ndarray) -> bytes:
    """Columns of numbers in one string, by byte planes."""
    head = [len(columns), *[len(c) for c in columns]]
    raw = np.concatenate([np.array(head, np.int64), *columns]).astype(np.int64)
    return _squeezed(raw.view(np.uint8).reshape(-1, 8).T.tobytes())


def _columns(numbers: bytes) -> list[np.ndarray]:
    raw = np.ascontiguousarray(_unsqueezed(numbers).reshape(8, -1).T).view(np.int64).ravel()
    ends = np.cumsum(raw[1 : 1 + raw[0]]) + 1 + raw[0]
    return [raw[x:y] for x, y in zip([1 + raw[0], *ends[:-1]], ends, strict=True)]


def _blocks(n: int, block_bytes: int, piece_bytes: int):
    """Blocks of pieces."""

    def close(held: list[tuple], number: int) -> pa.RecordBatch:
        doc, tag, start = (np.array([x[i] for x in held], np.int64) for i in range(3))
        data = b"".join([x[3] for x in held])
        pieces = _numbers(doc, tag, start, np.array([len(x[3]) for x in held], np.int64))
        return pa.RecordBatch.from_pylist([{"block": number, "pieces": pieces, "data": _squeezed(data), "size": len(data)}], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc, tag, text in zip(*[batch.column(c) for c in ("doc_id", "tag", "text")], strict=True):
                raw = memoryview(text.as_buffer()) if text.is_valid else b""
                for at in range(0, max(len(raw) - n + 1, 0), piece_bytes):
                    piece = bytes(raw[at : at + piece_bytes + n - 1])
                    held.append((doc.as_py(), tag.as_py(), at, piece))
                    size += len(piece)
                    if size >= block_bytes:
                        yield close(held, number)
                        held, size, number = [], 0, number + 1
        if held:
            yield close(held, number)

    return run


def _requests(n: int, bits: int, mask: np.uint64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, sizes = _unsqueezed(row["data"]), _columns(row["pieces"])[3]
                room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
                yield _packed.asked(row["block"], *_counted(*_anchors(data, room, n), mask), bits)

    return run


def _deal(n: int, bits: int, mask: np.uint64, buckets: int, hot: int):
    """A block with its anchors' totals: marks, and what travels, a row for each bucket."""

    def packed(p: Pieces, block: int, at: np.ndarray, low: np.ndarray, heavy: np.ndarray, twin: np.ndarray, rep: np.ndarray) -> Iterator[dict]:
        """at: sorted places that travel; twin: further places of the same documents, rep: whose bytes they have (index in at)."""
        key = low.copy()
        if heavy.any():
            key[heavy] = _hashes(_characters(p.data), at[heavy], n)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (key[1:] != key[:-1]) | (np.diff(p.owner[at]) != 0)
        lo = np.flatnonzero(new)
        sizes = np.append(lo[1:], len(at)) - lo
        bucket = (_text.mix(key[lo] ^ _SALT) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        moved = np.empty(len(lo), np.int64)
        moved[order] = np.arange(len(lo))
        first_run = np.cumsum(new)[rep] - 1
        extra_run, extra_at = moved[first_run], rep - lo[first_run]  # the run as it is dealt, and the place's number in it
        by = np.argsort(extra_run, kind="stable")
        extra_run, extra_at, twin = extra_run[by], extra_at[by], p.place(twin[by])
        lo, sizes, bucket = lo[order], sizes[order], bucket[order]
        begin, length, raw = at[lo], sizes + n - 1, p.data.tobytes()
        piece, place = p.owner[begin], p.place(begin)
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], bucket, [-1]))))
        more = np.searchsorted(extra_run, edges)
        for k, (x, y) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            a, b = more[k], more[k + 1]
            yield {
                "bucket": int(bucket[x]),
                "block": block,
                "numbers": _numbers(p.doc[piece[x:y]], piece[x:y], place[x:y], length[x:y], extra_run[a:b] - x, extra_at[a:b], twin[a:b]),
                "data": _squeezed(b"".join([raw[i : i + j] for i, j in zip(begin[x:y].tolist(), length[x:y].tolist(), strict=True)])),
                "marks": None,
            }

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        given = dict(zip(right.column("path").to_pylist(), right.column("totals").to_pylist(), strict=True))
        rows = []
        for row in left.to_pylist():
            doc, _, start, sizes = _columns(row["pieces"])
            p = Pieces(doc, start, sizes, _unsqueezed(row["data"]))
            every, low = _anchors(p.data, p.room, n)
            keys, own = _counted(every, low, mask)
            totals = np.zeros(len(keys), np.int64)
            for path, lo, hi in _packed.spans(keys, bits):
                totals[lo:hi] = _packed.unzipped(given[path], np.int64)
            key = np.searchsorted(keys, low & mask)
            some = totals[key] > 1
            every, low, key = every[some], low[some], key[some]
            here = own[key] > 1  # what has its anchor once in the block repeats nothing in it
            at = every[here]
            order, least, group = p.ranked(at, n)
            owner = p.doc[p.owner[at[order]]]
            gone = np.sort(at[order[owner > least]])
            if len(gone):  # marks pass through some bucket
                rows.append({"bucket": row["block"] % buckets, "block": row["block"], "marks": _numbers(*p.runs(gone, n))})
            stay, group = order[owner == least], group[owner == least]
            lead = np.ones(len(stay), bool)
            lead[1:] = group[1:] != group[:-1]
            goes = ~here
            goes[np.flatnonzero(here)[stay[lead]]] = True
            if goes.any():
                place = np.cumsum(goes) - 1  # of each among those that travel
                leader = place[np.flatnonzero(here)[stay[lead]]][np.cumsum(lead) - 1]
                rows += packed(p, row["block"], every[goes], low[goes], totals[key[goes]] > hot, at[stay[~lead]], leader[~lead])
        return pa.Table.from_pylist(rows, schema=_PACKED)

    return run


def _settle(n: int):
    """Of a bucket: marks of what starts in a smaller document as well."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [{"block": r["block"], "marks": r["marks"]} for r in rows if r["marks"] is not None]
        rows = [r for r in rows if r["marks"] is None]
        if rows:
            parts = [_columns(r["numbers"]) for r in rows]
            doc, start, sizes = (np.concatenate([x[i] for x in parts]) for i in (0, 2, 3))
            p = Pieces(doc, start, sizes, np.concatenate([_unsqueezed(r["data"]) for r in rows]))
            at = np.flatnonzero(p.room >= n)
            order, least, _ = p.ranked(at, n)
            gone = np.zeros(len(p.data), bool)
            gone[at[order[p.doc[p.owner[at[order]]] > least]]] = True
            run, first, last = p.runs(np.flatnonzero(gone), n) if gone.any() else (np.zeros(0, np.int64),) * 3
            begin, base = p.ends - sizes, 0
            for r, (_, piece, _, _, extra_run, extra_at, twin) in zip(rows, parts, strict=True):
                lo, hi = np.searchsorted(run, (base, base + len(piece)))
                some = gone[begin[base + extra_run] + extra_at]
                marks = [np.concatenate(x) for x in ((piece[run[lo:hi] - base], piece[extra_run[some]]), (first[lo:hi], twin[some]), (last[lo:hi], twin[some] + n))]
                if len(marks[0]):
                    out.append({"block": r["block"], "marks": _numbers(*marks)})
                base += len(piece)
        return pa.Table.from_pylist(out, schema=_MARKS)

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, m in zip(batch.column("block").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            columns = _columns(m)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), block), pa.int64()), *[pa.array(x, pa.int64()) for x in columns]], ["block", "piece", "first", "last"])


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whose pieces a block has."""
    for batch in batches:
        for block, pieces in zip(batch.column("block").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            doc, tag = _columns(pieces)[:2]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(doc), block), np.arange(len(doc)), doc, tag)], ["of", "number", "doc_id", "tag"])


def repeated_spans(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, tag, spans (first, last: bytes, half open; they may overlap) of each row with bytes to remove."""
    if not 8 <= n <= 63:
        raise ValueError(n)
    spark = docs.sparkSession
    _store.small_batches(spark)
    text = F.col("text").cast("string")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("text"))
    blocks = _store.written(own.mapInArrow(_blocks(n, BLOCK_BYTES, PIECE_BYTES), _BLOCK_SQL), "suffix-blocks")
    size = blocks.agg(F.sum("size")).first()[0] or 0
    keys, buckets = math.ceil(2 * size / (n - min(ANCHOR, n) + 2)), max(64, 3 * size // (2 * BUCKET_BYTES))
    bits = _packed.fan_bits(keys)
    # an anchor only picks suffixes for sorting, so it has eight bits more than it takes to number all of them
    mask = ~np.uint64((1 << (64 - min(64, max(bits, keys.bit_length() + 8)))) - 1)
    rows = blocks.select("block", "pieces", "data").mapInArrow(_requests(n, bits, mask), _packed.ASK_SQL)
    answers = _packed.totals(rows, keys, bits).select(F.col("child").alias("block"), "path", "totals")
    dealt = blocks.drop("size").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_deal(n, bits, mask, buckets, HOT), _PACKED_SQL)
    marks = _store.written(dealt.groupBy("bucket").applyInArrow(_settle(n), "block long, marks binary"), "suffix-marks")
    owners = _store.written(blocks.select("block", "pieces").mapInArrow(_owners, "of long, number long, doc_id long, tag long"), "suffix-owners")
    _store.removed(blocks)
    spans = marks.mapInArrow(_spans, "block long, piece long, first long, last long")
    found = spans.join(owners, (F.col("block") == F.col("of")) & (F.col("piece") == F.col("number")))
    return found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _kept(text: bytes | None, first: np.ndarray, last: np.ndarray) -> tuple[bytes, int]:
    """The bytes outside all spans, and how many runs of bytes went."""
    text = text or b""
    if not len(first):
        return text, 0
    order = np.argsort(first)
    first, upto = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate(([True], first[1:] > upto[:-1])))
    begins, ends = first[new].tolist(), upto[np.append(new[1:], len(first)) - 1].tolist()
    return b"".join([text[x:y] for x, y in zip([0, *ends], [*begins, len(text)], strict=True)]), len(new)


def _by_row(spans: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """first and last of each row's spans; null has none."""
    ends = np.cumsum(pc.fill_null(spans.value_lengths(), 0).to_numpy(zero_copy_only=False)).tolist()
    first, last = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten()) if len(spans) else ((), ())
    for x, y in zip([0, *ends[:-1]], ends, strict=True):
        yield first[x:y], last[x:y]


def _with_spans(docs: DataFrame, n: int) -> tuple[DataFrame, str]:
    """docs with a further column of spans, and its name."""
    id_, tag, spans = _store.names(docs, "id", "tag", "spans")
    found = repeated_spans(docs, n).select(F.col("doc_id").alias(id_), F.col("tag").alias(tag), F.col("spans").alias(spans))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)) == F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(tag))
    return docs.join(found, same, "left"), spans


def digest(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept_sha256 for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [_kept(t, *s) for t, s in zip(texts, _by_row(batch.column("spans")), strict=True)]
            sizes = [len(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array([size - len(k) for size, (k, _) in zip(sizes, out, strict=True)], pa.int64()),
                    pa.array([runs for _, runs in out], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k, _ in out], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined, spans = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), n)
    return joined.select("doc_id", F.col("text").cast("binary").alias("text"), F.col(spans).alias("spans")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of docs with their own columns; texts lose their repeated bytes, and what is left of a cut character is U+FFFD."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        ends = lambda s, k: np.array([x[k] for x in s], np.int64)
        return pd.Series([t if s is None else _kept(t.encode(), ends(s, "first"), ends(s, "last"))[0].decode(errors="replace") for t, s in zip(text, spans, strict=True)], dtype=object)

    joined, spans = _with_spans(docs, n)
    return joined.withColumn("text", cut("text", spans)).select(*[F.col(f"`{c}`") for c in docs.columns])
