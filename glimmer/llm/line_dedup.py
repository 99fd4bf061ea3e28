"""Line deduplication behind two Bloom filters.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased. Keys of at least
`min_chars` code points that stand in at least `min_docs` documents lose all their lines except in the largest doc_id
that holds them (null is the smallest). Hashes of the long keys go, pre-aggregated, to their segment of the first Bloom
filter, which has bits for all keys that the texts' length allows, in as many segments as that takes. What the first
filter has already is met again; the second filter is made for as many hashes as these are. Only lines whose hash is in
the second filter shuffle as text, where the keys are counted exactly. A filter has no false negatives, so no line is
lost; false positives only shuffle more. The second filter is broadcast up to `SHARED_BYTES`. Where it is larger, the
lines' hashes, with doc_ids in place of text, are joined by shuffle with the hashes met again, and the suspects are the same
lines, less the filter's false positives.

Null and empty texts are one empty line. Repeated rows and rows that share a doc_id count as one document and are all
cleaned alike. Other columns are carried on. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
BITS_PER_KEY = 16
PROBES = 4
#: What the second filter takes at most to be broadcast.
SHARED_BYTES = 32 << 20
SEGMENT_BITS = 1 << 20


def key_of(line: bytes) -> bytes:
    """Of a line in UTF-8; lower() of bytes changes A-Z alone."""
    return line.strip(_WHITE).lower()


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _segments(h: np.ndarray, segments: int) -> np.ndarray:
    return (_text.mix(h) % np.uint64(segments)).astype(np.int64)


def _bits(h: np.ndarray, size: int) -> np.ndarray:
    """The bits of each hash (PROBES columns) in a segment of size bits, a power of two."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _long_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    out = set()
    for line in (text or b"").split(b"\n"):
        if len(line) >= min_chars and len(k := key_of(line)) >= min_chars and (len(k) >= 4 * min_chars or k.isascii() or len(k.decode("utf-8", "replace")) >= min_chars):
            out.add(k)
    return out


def _segment_rows(min_chars: int, segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: dict[int, int] = {}
            for text in _texts(batch.column("text")):
                for k in _long_keys(text, min_chars):
                    h = xxhash.xxh64_intdigest(k)
                    met[h] = met.get(h, 0) + 1
            h = np.fromiter(met.keys(), np.uint64, len(met))
            twice = np.fromiter(met.values(), np.int64, len(met)) > 1
            yield pa.RecordBatch.from_arrays([pa.array(_segments(h, segments)), pa.array(h.view(np.int64)), pa.array(twice)], ["segment", "h", "twice"])

    return run


def _again(bits_each: int):
    """Fills the first filter, a segment at a time (rows come in their order); returns each segment's hashes that are met again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, once, again = None, np.zeros(0, bool), []

        def close() -> pa.RecordBatch:
            h = np.unique(np.concatenate(again))
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([h.tobytes()], pa.binary())], ["segment", "n", "hashes"])

        for batch in batches:
            segments = batch.column("segment").to_numpy()
            h, twice = batch.column("h").to_numpy().view(np.uint64), batch.column("twice").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(segments, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if segments[lo] != segment:
                    if again:
                        yield close()
                    segment, once, again = int(segments[lo]), np.zeros(bits_each, bool), []
                keys, back, n = np.unique(h[lo:hi], return_inverse=True, return_counts=True)
                bits = _bits(keys, bits_each)
                repeated = once[bits].all(axis=1) | (n > 1) | (np.bincount(back, weights=twice[lo:hi], minlength=len(keys)) > 0)
                once[bits.ravel()] = True
                if repeated.any():
                    again.append(keys[repeated])
        if again:
            yield close()

    return run


def _second(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The second filter's segments, of size bits each."""
        for batch in batches:
            out = []
            for x in batch.column("hashes").to_pylist():
                bits = np.zeros(size, bool)
                bits[_bits(np.frombuffer(x, np.uint64), size).ravel()] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(out, pa.binary())], ["segment", "bits"])

    return run


def _suspects(min_chars: int, segments: int, size: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: np.frombuffer(b, np.uint8) for s, b in shared.value.items()}
        for batch in batches:
            ids, own = _lines(batch, min_chars)
            h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
            seg, bits, hit = _segments(h, segments), _bits(h, size), np.zeros(len(own), bool)
            for s in np.unique(seg):
                if s in filters:
                    at = np.flatnonzero(seg == s)
                    b = bits[at]
                    hit[at] = ((filters[s][b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).all(axis=1)
            at = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array([own[i] for i in at], pa.binary()).cast(pa.string())], ["doc_id", "key"])

    return run


def _lines(batch: pa.RecordBatch, min_chars: int) -> tuple[list, list[bytes]]:
    """doc_ids and long keys of a batch's documents."""
    ids, own = [], []
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), _texts(batch.column("text")), strict=True):
        for k in _long_keys(text, min_chars):
            ids.append(doc_id)
            own.append(k)
    return ids, own


def _joined(own: DataFrame, again: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key) of lines whose hash is met again, by shuffles of hashes and then of those documents' texts alone."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = _lines(batch, min_chars)
            h = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h.view(np.int64))], ["doc_id", "h"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("hashes").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64))], ["h"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text, met in zip(batch.column("doc_id").to_pylist(), _texts(batch.column("text")), batch.column("met").to_pylist(), strict=True):
                met = set(met)
                for k in _long_keys(text, min_chars):
                    if int(np.uint64(xxhash.xxh64_intdigest(k)).view(np.int64)) in met:
                        ids.append(doc_id)
                        keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()).cast(pa.string())], ["doc_id", "key"])

    met = own.mapInArrow(hashes, "doc_id long, h long").join(again.mapInArrow(unpacked, "h long"), "h", "left_semi")
    met = met.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("h").alias("met"))
    return own.join(met, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "met").mapInArrow(texts, "doc_id long, key string")


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, keys): for each document with lines to drop, the keys that it loses."""
    spark = docs.sparkSession
    _store.small_batches(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # long keys there can be at most, from the texts' lengths alone
    most = (own.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // max(1, min_chars)
    segments = max(1, math.ceil(BITS_PER_KEY * most / SEGMENT_BITS))
    rows = own.select("text").mapInArrow(_segment_rows(min_chars, segments), "segment long, h long, twice boolean")
    again = _store.written(rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(_again(SEGMENT_BITS), "segment long, n long, hashes binary"), "lines-again")
    largest = again.agg(F.max("n")).first()[0] or 0
    size = 1 << max(6, math.ceil(math.log2(BITS_PER_KEY * max(1, largest))))
    if segments * size <= 8 * SHARED_BYTES:
        filled = again.mapInArrow(_second(size), "segment long, bits binary")
        shared = spark.sparkContext.broadcast({r["segment"]: bytes(r["bits"]) for r in filled.toLocalIterator()})
        found = own.mapInArrow(_suspects(min_chars, segments, size, shared), "doc_id long, key string")
    else:
        found = _joined(own, again, min_chars)
    suspects = _store.written(found, "line-suspects")
    _store.removed(again)
    # a key with its documents, counted where the rows are first; exact, as the text itself is the key
    counted = suspects.groupBy("key").agg(F.countDistinct(F.coalesce("doc_id", F.lit(-(2**63)))).alias("n"), F.max("doc_id").alias("keep"))
    # written by itself, so that the join deals out the suspects alone and Spark can split a common line's
    confirmed = _store.written(counted.filter(F.col("n") >= min_docs).select("key", "keep"), "lines-confirmed")
    lost = suspects.join(confirmed, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _cleaned(text: bytes | None, keys: list[bytes] | None) -> tuple[bytes, int, int]:
    """The text without the lines that have one of the keys, its lines before, and the lines dropped."""
    text = text or b""
    if not keys:
        return text, text.count(b"\n") + 1, 0
    lines, gone = text.split(b"\n"), set(keys)
    kept = [x for x in lines if key_of(x) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of docs with their own columns, the repeated lines taken from text."""
    id_, keys_ = _store.names(docs, "id", "keys")
    lost = repeated_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias(id_), F.col("keys").alias(keys_))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys = batch.schema.get_field_index("text"), batch.column(keys_).cast(pa.list_(pa.binary())).to_pylist()
            own = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema(list(batch.schema)[:-1]))
            if any(keys):
                new = [t if t is None else _cleaned(t, k)[0] for t, k in zip(_texts(batch.column("text")), keys, strict=True)]
                own = own.set_column(at, own.schema.field(at), pa.array(new, pa.binary()).cast(own.schema.field(at).type))
            yield own

    joined = docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], keys_).mapInArrow(clean, docs.schema)


def digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of docs."""
    lost = repeated_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias("__id"), F.col("keys").alias("__keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_cleaned(t, k) for t, k in zip(_texts(batch.column("text")), batch.column("__keys").cast(pa.list_(pa.binary())).to_pylist(), strict=True)]
            sha = [hashlib.sha256(t).hexdigest() for t, _, _ in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for _, n, _ in out], pa.int64()), pa.array([d for _, _, d in out], pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(lost, own["doc_id"].eqNullSafe(lost["__id"]), "left").select("doc_id", "text", "__keys").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
