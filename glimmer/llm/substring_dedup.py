"""Repeated passages, by super-k-mers.

A window is `n` consecutive words of one document. Its minimiser is the smallest hash of its sequences of some words (the
leftmost of equal ones); consecutive windows that share one travel together, as one packed string of words, to the
bucket that the minimiser's hash names. Equal windows have equal minimisers, so all of them meet in one bucket, where
sorting puts them side by side; their words themselves are compared, so counts are exact. A word goes when it is covered by
a window whose words also start earlier: in a smaller doc_id, or earlier in the same document.

Before windows travel, each block of documents is sorted by itself in the same way: a window that repeats within the
block is marked at once and does not travel. So a passage that many documents share comes to its bucket once a block,
and a bucket's size follows the number of distinct windows.

A bucket is read in chunks of bounded size. If one chunk holds all of it, its windows are settled. Otherwise, as with a
phrase that stands in a third of all documents in different surroundings, each chunk is marked by itself and its other
windows are dealt anew, by minimisers of more words, at last by the whole window's hash, to more buckets, where equal
windows meet again. So no task holds a bucket, and each round has fewer windows to deal: words of more than `LONG` bytes
travel as their SHA-256, so a chunk has room for many windows whatever their words.

Null and empty texts have no words. Null doc_id is the smallest. Rows that share a doc_id count as one document of which
each row has its own words: equal starts do not repeat each other. Empty tables give no rows. Other columns are carried
on by `drop_repeats`. A run reads docs several times and expects the same rows each time, as tables give them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

WINDOW = 20
#: Words of a minimiser in each round; those after the last have the whole window.
MMERS = (6, 12)
BLOCK_WORDS = 1 << 20
#: Bytes of packed strings that a bucket gets, about.
BUCKET_BYTES = 12 << 20
#: Bytes of a word that travels as it is; a longer one is told by its SHA-256, so a window has some 1,300 bytes at most.
LONG = 64
#: Bytes of words that a task holds at once; many windows, so that each round has fewer to deal.
CHUNK_BYTES = 24 << 20
_PACKED = "bucket long, docs binary, starts binary, words binary, marks binary"
_NULL = -(2**63)


def _zip(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(x)


def _unzip(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _joined(w: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins; the total length at the end."""
    sizes = w.ends - w.starts
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    out, inside = np.full(int(offsets[-1]), 32, np.uint8), np.ones(int(offsets[-1]), bool)
    inside[offsets[1:] - 1] = False
    out[inside] = w.data[w.inside]
    return out, offsets


def _shortened(w: _text.Words) -> _text.Words:
    """The words with a NUL and the hex SHA-256 in place of each that has more than LONG bytes. The form is longer than that
    itself, so no word that stays has it."""
    long = np.flatnonzero(w.ends - w.starts > LONG)
    if not len(long):
        return w
    data, inside, at = [], [], 0
    for a, b in zip(w.starts[long].tolist(), w.ends[long].tolist(), strict=True):
        form = b"\0" + hashlib.sha256(w.data[a:b]).hexdigest().encode()
        data += [w.data[at:a], np.frombuffer(form, np.uint8)]
        inside += [w.inside[at:a], np.ones(len(form), bool)]
        at = b
    less = np.zeros(len(w.starts) + 1, np.int64)
    less[long + 1] = w.ends[long] - w.starts[long] - len(form)
    less = np.cumsum(less)
    return replace(w, data=np.concatenate([*data, w.data[at:]]), inside=np.concatenate([*inside, w.inside[at:]]), starts=w.starts - less[:-1], ends=w.ends - less[1:])


def _later(h: np.ndarray, doc: np.ndarray, start: np.ndarray, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which windows have their words in a window with a smaller (doc, start). begin, end: their bytes in buffer."""
    order = np.lexsort((start, doc, h))
    h, doc, start = h[order], doc[order], start[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    at = np.flatnonzero((doc != doc[first]) | (start != start[first]))
    out = np.zeros(len(h), bool)
    if len(at):
        a, b = order[at], order[first[at]]
        sizes = end - begin
        equal = sizes[a] == sizes[b]
        equal[equal] = _text.same(buffer, begin[a[equal]], buffer, begin[b[equal]], sizes[a[equal]])
        out[a[equal]] = True
        # two different windows with one hash: their group is told apart by the words
        raw = buffer.tobytes() if not equal.all() else b""
        for f in np.unique(first[at[~equal]]).tolist():
            seen: dict[bytes, tuple[int, int]] = {}
            stop = f + 1
            while stop < len(h) and not new[stop]:
                stop += 1
            for i in range(f, stop):
                place = seen.setdefault(raw[begin[order[i]] : end[order[i]]], (doc[i], start[i]))
                out[order[i]] = place != (doc[i], start[i])
    return out


def _windows(h: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows, and their hashes. room: words from each to its text's end."""
    at = np.flatnonzero(room >= n)
    return at, _text.spans_hash(h, at, at + n)


def _minimisers(h: np.ndarray, room: np.ndarray, at: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the place and hash of its minimiser of m words."""
    mers = np.full(len(h) + n, np.iinfo(np.uint64).max, np.uint64)
    some = np.flatnonzero(room >= m)
    mers[some] = _text.mix(_text.spans_hash(h, some, some + m) ^ np.uint64(0x5851F42D4C957F2D))
    view = np.lib.stride_tricks.sliding_window_view(mers, n - m + 1)
    place = np.concatenate([np.zeros(0, np.int64), *[view[at[k : k + 65536]].argmin(axis=1) for k in range(0, len(at), 65536)]]) + at
    return place, mers[place]


def _runs(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of consecutive places within one group."""
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(group) != 0))
    return np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(at) - 1]))


_SCHEMA = pa.schema([("bucket", pa.int64()), *[(c, pa.binary()) for c in ("docs", "starts", "words", "marks")]])


class Held:
    """Texts, or parts of them, in one place: each with doc_id, tag and the number of its first word in the document."""

    def __init__(self, parts: list[tuple]) -> None:
        """parts: doc_id, tag, start, counts of words, hashes of words, and `_joined` words."""
        self.doc, self.tag, self.start, self.counts, self.h = (np.concatenate([x[i] for x in parts]) for i in range(5))
        self.buffer = np.concatenate([x[5] for x in parts])
        shift = np.cumsum([0, *[len(x[5]) for x in parts]])
        self.offsets = np.concatenate([*[x[6][:-1] + s for x, s in zip(parts, shift, strict=False)], shift[-1:]])
        firsts = np.concatenate(([0], np.cumsum(self.counts)))
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        place = np.arange(len(self.h)) - firsts[:-1][self.owner]
        self.room, self.place = self.counts[self.owner] - place, self.start[self.owner] + place

    def settle(self, n: int, bucket: int | None = None) -> tuple[list[pa.RecordBatch], np.ndarray]:
        """A row of marks (in the bucket) for windows that repeat a smaller one held here, and the places of all others."""
        at, hashes = _windows(self.h, self.room, n)
        if not len(at):
            return [], at
        gone = _later(hashes, self.doc[self.owner[at]], self.place[at], self.buffer, self.offsets[at], self.offsets[at + n] - 1)
        if not gone.any():
            return [], at
        a = at[gone]
        lo, hi = _runs(a, self.owner[a])
        d = self.owner[a[lo]]
        marks = np.stack([self.doc[d], self.tag[d], self.place[a[lo]], self.place[a[hi]] + n]).astype(np.int64)
        row = {"bucket": bucket, "docs": None, "starts": None, "words": None, "marks": _zip(marks.tobytes())}
        return [pa.RecordBatch.from_pylist([row], schema=_SCHEMA)], at[~gone]

    def deal(self, at: np.ndarray, n: int, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
        """Windows as packed strings, a row for each bucket."""
        if not len(at):
            return
        spot, key = _minimisers(self.h, self.room, at, n, min(n, MMERS[turn] if turn < len(MMERS) else n))
        lo, hi = _runs(at, spot)
        with np.errstate(over="ignore"):
            bucket = (_text.mix(key[lo] + np.uint64(turn)) % np.uint64(buckets)).astype(np.int64)
        a, b = at[lo], at[hi] + n
        order = np.argsort(bucket, kind="stable")
        a, b, bucket = a[order], b[order], bucket[order]
        raw = self.buffer.tobytes()
        begin, end = self.offsets[a].tolist(), (self.offsets[b] - 1).tolist()
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], bucket, [-1]))))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            d = self.owner[a[lo:hi]]
            row = {
                "bucket": int(bucket[lo]),
                "docs": _zip(np.stack([self.doc[d], self.tag[d]]).astype(np.int64).tobytes()),
                "starts": _zip(self.place[a[lo:hi]].astype(np.int64).tobytes()),
                "words": _zip(b"\n".join([raw[x:y] for x, y in zip(begin[lo:hi], end[lo:hi], strict=True)])),
                "marks": None,
            }
            yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)


def _pack(n: int, buckets: int, block_words: int):
    """Blocks of documents: marks of windows that repeat within the block, the others dealt to buckets."""

    def close(held: list, number: int) -> Iterator[pa.RecordBatch]:
        block = Held(held)
        # marks pass through some bucket, so that all comes from one reading of the texts
        marks, at = block.settle(n, int(_text.mix(np.array([number], np.uint64))[0] % np.uint64(buckets)))
        yield from marks
        yield from block.deal(at, n, buckets, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _text.slices(batch, "text"):
                w = _shortened(_text.split(part.column("text"), _text.WORDS))
                ids, tags = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "tag"))
                held.append((ids, tags, np.zeros(len(ids), np.int64), w.counts, w.hashes(), *_joined(w)))
                words += len(w.starts)
                if words >= block_words:
                    yield from close(held, number)
                    held, words, number = [], 0, number + 1
        if words:
            yield from close(held, number)

    return run


def _count(n: int, buckets: int, turn: int, chunk_bytes: int):
    """Of a bucket, in chunks: marks, and, if it takes more than one chunk, its windows dealt anew."""

    def parts(docs: bytes, starts: bytes, words: bytes) -> Iterator[tuple]:
        doc, tag = np.frombuffer(docs, np.int64).reshape(2, -1)
        start, at = np.frombuffer(starts, np.int64), 0
        strings = pa.record_batch([pa.array(words.split(b"\n"), pa.binary()).cast(pa.string())], ["text"])
        for part in _text.slices(strings, "text"):
            w, own = _text.split(part.column("text"), _text.WORDS), slice(at, at + part.num_rows)
            yield doc[own], tag[own], start[own], w.counts, w.hashes(), *_joined(w)
            at += part.num_rows

    def close(held: list, whole: bool) -> Iterator[pa.RecordBatch]:
        chunk = Held(held)
        marks, at = chunk.settle(n)
        yield from marks
        if not whole:
            yield from chunk.deal(at, n, buckets, turn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, whole = [], 0, True
        for batch in batches:
            for docs, starts, words, marks in zip(*[batch.column(c) for c in ("docs", "starts", "words", "marks")], strict=True):
                if marks.is_valid:
                    yield pa.RecordBatch.from_pylist([{"bucket": None, "marks": marks.as_py()}], schema=_SCHEMA)
                    continue
                if size >= chunk_bytes:
                    whole = False
                    yield from close(held, whole)
                    held, size = [], 0
                words = _unzip(words.as_py())
                held += parts(_unzip(docs.as_py()), _unzip(starts.as_py()), words)
                size += len(words)
        if held:
            yield from close(held, whole)

    # Spark tells the two forms of such functions apart by their types, as objects
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m in batch.column("marks"):
            rows = np.frombuffer(_unzip(m.as_py()), np.int64).reshape(4, -1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "tag", "first", "last"])


def _tagged(docs: DataFrame) -> DataFrame:
    """doc_id (null: the smallest), text, tag: which tells rows apart that share a doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tag"))


def repeated_spans(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, tag, spans (first, last: words, half open) of each row with words to remove."""
    _store.small_batches(docs.sparkSession)
    own = _tagged(docs)
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(64, 3 * total // BUCKET_BYTES)
    packed, found, turn = own.mapInArrow(_pack(n, buckets, BLOCK_WORDS), _PACKED), [], 1
    while True:
        table = _store.written(packed.groupBy("bucket").applyInArrow(_count(n, buckets, turn, CHUNK_BYTES), _PACKED), "spans-marks")
        found.append(table.filter("marks IS NOT NULL").select("marks"))
        packed = table.filter("bucket IS NOT NULL")
        if not packed.limit(1).count():
            break
        turn, buckets = turn + 1, 4 * buckets
    marks = reduce(DataFrame.union, found).mapInArrow(_marks, "doc_id long, tag long, first long, last long")
    return marks.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _kept(text: bytes | None, spans: list | None) -> tuple[list[bytes], int]:
    words = (text or b"").split()
    if not spans:
        return words, len(words)
    stay = np.ones(len(words), bool)
    for s in spans:
        stay[s["first"] : s["last"]] = False
    return [words[i] for i in np.flatnonzero(stay)], len(words)


def _with_spans(docs: DataFrame, n: int) -> tuple[DataFrame, str]:
    """docs with a further column of spans, and its name."""
    id_, tag, spans = _store.names(docs, "id", "tag", "spans")
    found = repeated_spans(docs, n).select(F.col("doc_id").alias(id_), F.col("tag").alias(tag), F.col("spans").alias(spans))
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)) == F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(tag))
    return docs.join(found, same, "left"), spans


def digest(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_kept(t, s) for t, s in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t for _, t in out], pa.int64()), pa.array([t - len(k) for k, t in out], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k, _ in out], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    joined, _ = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), n)
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """The rows of docs with their own columns; texts that lose words keep the others, joined by one space."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None or not len(s) else b" ".join(_kept(t.encode(), list(s))[0]).decode() for t, s in zip(text, spans, strict=True)], dtype=object)

    joined, spans = _with_spans(docs, n)
    return joined.withColumn("text", cut("text", spans)).select(*[F.col(f"`{c}`") for c in docs.columns])
