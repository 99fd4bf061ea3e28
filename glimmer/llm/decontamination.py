"""Benchmark decontamination by a broadcast set of normalised n-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. A window is `n` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. Hashes of all windows are broadcast,
each document's windows are looked up, and a hit counts only if its words are an item's words.

Windows themselves are broadcast, as words, for benchmarks of up to `SHARED_CHARS` characters; nothing shuffles then. A
larger benchmark stays on Spark as a table of windows, and only a filter of their hashes is broadcast, of 16 bits each and
32 MiB at most; document windows that it has are joined with the table by hash and words, which confirms them. Past
16 million windows the filter lets more through to the join, with the same result.

Null and empty texts have no words and no hits; items without words have no windows. Repeated rows are scanned one by
one. Items that share an item_id count as one. Other columns are carried on by `decontaminate`. Empty tables are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text

WINDOW = 10
SHARED_CHARS = 4_000_000
#: Of the hash filter: bits of a segment, segments at most, windows that a segment is for.
SEGMENT_BITS, SEGMENTS, SEGMENT_WINDOWS = 1 << 20, 256, 1 << 16


class Windows:
    """Windows of benchmark items: by length the sorted hashes, and by the words themselves the items."""

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW) -> None:
        self.items: dict[tuple[str, ...], set[str]] = {}
        by_length: dict[int, set[int]] = {}
        for item, text in items:
            w = _text.split(pa.array([text], pa.string()), _text.ALNUM_LOWER)
            words = w.strings().to_pylist()
            if not words:
                continue
            k = min(n, len(words))
            starts = np.arange(len(words) - k + 1)
            by_length.setdefault(k, set()).update(_text.spans_hash(w.hashes(), starts, starts + k).tolist())
            for i in starts.tolist():
                self.items.setdefault(tuple(words[i : i + k]), set()).add(item)
        self.hashes = {k: np.array(sorted(h), np.uint64) for k, h in by_length.items()}

    def hits(self, w: _text.Words) -> Iterator[tuple[int, int, set[str]]]:
        """Occurrences of windows within single texts of a slice: first word, end, items."""
        if not len(w.starts):
            return
        h, firsts = w.hashes(), w.firsts
        room = np.repeat(firsts[1:], w.counts) - np.arange(len(h))  # words to the end of the text
        for k, known in self.hashes.items():
            at = np.flatnonzero(room >= k)
            if not len(at):
                continue
            own = _text.spans_hash(h, at, at + k)
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            for i in at[known[place] == own].tolist():
                words = tuple(w.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.starts[i : i + k], w.ends[i : i + k], strict=True))
                if items := self.items.get(words):
                    yield i, i + k, items


def _shared(windows, part: pa.RecordBatch, w: _text.Words, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, dict[int, set[str]]]:
    """The rows of a slice, which of their words are hit, and each hit text's items; by windows that are at hand."""
    covered = np.zeros(len(w.starts), bool)
    items: dict[int, set[str]] = {}
    for a, b, names in windows.value.hits(w):
        covered[a:b] = True
        items.setdefault(int(np.searchsorted(firsts, a, "right")) - 1, set()).update(names)
    return part, covered, items


def _joined(_, part: pa.RecordBatch, w: _text.Words, firsts: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray, dict[int, set[str]]]:
    """The same from the last two columns, spans of hit words and items."""
    covered = np.zeros(len(w.starts), bool)
    items: dict[int, set[str]] = {}
    for i, (spans, names) in enumerate(zip(part.columns[-2].to_pylist(), part.columns[-1].to_pylist(), strict=True)):
        if spans:
            items[i] = set(names)
            for x in spans:
                covered[firsts[i] + x["first"] : firsts[i] + x["last"]] = True
    return pa.RecordBatch.from_arrays(part.columns[:-2], schema=pa.schema(list(part.schema)[:-2])), covered, items


def _windows(n: int):
    """(h, words, item) of benchmark items (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                w = _text.split(part.column("text"), _text.ALNUM_LOWER)
                h, words, out = w.hashes(), w.strings().to_pylist(), ([], [], [])
                for item, a, b in zip(part.column("item").to_pylist(), w.firsts[:-1].tolist(), w.firsts[1:].tolist(), strict=True):
                    k = min(n, b - a)
                    starts = np.arange(a, b - k + 1) if k else np.zeros(0, np.int64)
                    out[0].append(_text.spans_hash(h, starts, starts + k))
                    out[1].extend(" ".join(words[i : i + k]) for i in starts.tolist())
                    out[2].extend([item] * len(starts))
                h = np.concatenate([np.zeros(0, np.uint64), *out[0]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["h", "words", "item"])

    return run


def _bits(h: np.ndarray) -> np.ndarray:
    """Four bits of each hash in its segment."""
    a, b = h >> np.uint64(32), (h >> np.uint64(12)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((a[:, None] + b[:, None] * np.arange(4, dtype=np.uint64)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64)


def _segment(table: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT_BITS, bool)
    for chunk in table.column("h").chunks:
        bits[_bits(chunk.to_numpy().view(np.uint64)).ravel()] = True
    return pa.table([pa.array([table.column("segment")[0].as_py()], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["segment", "bits"])


def _suspected(lengths: list[int], segments: int, shared):
    """(id, tag, first, last, h, words) of document windows that the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {s: np.frombuffer(b, np.uint8) for s, b in shared.value.items()}
        for batch in batches:
            for part in _text.slices(batch, "text"):
                w = _text.split(part.column("text"), _text.ALNUM_LOWER)
                h, firsts = w.hashes(), w.firsts
                owner = np.repeat(np.arange(part.num_rows), w.counts)
                room, raw = firsts[1:][owner] - np.arange(len(h)), w.data.tobytes()
                for k in lengths:
                    at = np.flatnonzero(room >= k)
                    own = _text.spans_hash(h, at, at + k)
                    segment, hit = (own % np.uint64(segments)).astype(np.int64), np.zeros(len(at), bool)
                    for s in np.unique(segment):
                        if s in filters:
                            mine = np.flatnonzero(segment == s)
                            b = _bits(own[mine])
                            hit[mine] = ((filters[s][b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).all(axis=1)
                    at, own = at[hit], own[hit]
                    words = [" ".join(raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[i : i + k].tolist(), w.ends[i : i + k].tolist(), strict=True)) for i in at.tolist()]
                    first, d = at - firsts[:-1][owner[at]], pa.array(owner[at])
                    yield pa.RecordBatch.from_arrays([part.column("id").take(d), part.column("tag").take(d), pa.array(first), pa.array(first + k), pa.array(own.view(np.int64)), pa.array(words, pa.string())], ["id", "tag", "first", "last", "h", "words"])

    return run


def _with_hits(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """docs with two further columns, by the join of suspected windows with those of the items."""
    spark = docs.sparkSession
    windows = _store.written(items.mapInArrow(_windows(n), "h long, words string, item string").distinct(), "benchmark-windows")
    lengths = [r["k"] for r in windows.select(F.size(F.split("words", " ")).alias("k")).distinct().collect()]  # n of them at most
    segments = max(1, min(SEGMENTS, windows.count() // SEGMENT_WINDOWS + 1))
    # as of unsigned hashes
    segment = F.pmod(F.pmod(F.col("h"), F.lit(segments)) + F.when(F.col("h") < 0, F.lit(2**64 % segments)).otherwise(0), F.lit(segments))
    filled = windows.select("h", segment.cast("long").alias("segment")).groupBy("segment").applyInArrow(_segment, "segment long, bits binary")
    shared = spark.sparkContext.broadcast({r["segment"]: bytes(r["bits"]) for r in filled.toLocalIterator()})
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("string").alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    suspected = own.mapInArrow(_suspected(lengths, segments, shared), "id string, tag long, first long, last long, h long, words string")
    hits = suspected.distinct().join(windows, ["h", "words"]).groupBy("id", "tag").agg(F.collect_set(F.struct("first", "last")).alias("spans"), F.collect_set("item").alias("items"))
    id_, tag, spans, found = _store.names(docs, "id", "tag", "spans", "items")
    hits = _store.written(hits, "benchmark-hits").select(F.col("id").alias(id_), F.col("tag").alias(tag), F.col("spans").alias(spans), F.col("items").alias(found))
    joined = docs.join(hits, F.col("doc_id").cast("string").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(tag)), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], spans, found)


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, found: Callable, schema) -> DataFrame:
    """docs mapped slice by slice by found(rows, words, firsts, covered, items)."""
    _store.small_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) <= SHARED_CHARS:
        at_hand = docs.sparkSession.sparkContext.broadcast(Windows([(r["item"], r["text"]) for r in items.collect()], n))
        own, source = docs, _shared
    else:
        at_hand, own, source = None, _with_hits(docs, items, n), _joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                w = _text.split(part.column("text"), _text.ALNUM_LOWER)
                firsts = w.firsts
                rows, covered, items = source(at_hand, part, w, firsts)
                yield found(rows, w, firsts, covered, items)

    return own.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_hit (words inside hits), items (those that occur, sorted as strings)."""

    def found(part, w, firsts, covered, items):
        hit = np.diff(np.concatenate(([0], np.cumsum(covered)))[firsts])
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(items.get(i, ())) for i in range(part.num_rows)], pa.list_(pa.string()))],
            ["doc_id", "n_words", "n_hit", "items"],
        )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _scan(own, benchmark, n, found, "doc_id long, n_words long, n_hit long, items array<string>")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    joined = F.array_join("items", ",")
    return scan(docs, benchmark).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _without(text: str, raw: np.ndarray, w: _text.Words, first: int, covered: np.ndarray) -> str:
    """The text without its covered words; runs of them go with what stands between their words."""
    edges = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    base = int(raw[0])
    data = text.encode("utf-8", "replace")
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        out.append(data[at : int(w.starts[first + a]) - base])
        at = int(w.ends[first + b - 1]) - base
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, remove: str = "documents") -> DataFrame:
    """The rows of docs with their own columns: without the documents that have a hit, or (remove="spans") without the hit words."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)

    def found(part, w, firsts, covered, items):
        texts = part.column("text")
        if remove == "documents":
            return part.filter(pa.array([i not in items for i in range(part.num_rows)], pa.bool_()))
        sizes = np.array([len(x.encode("utf-8", "replace")) for x in ("" if t is None else t for t in texts.to_pylist())], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        new = texts.to_pylist()
        for i in items:
            new[i] = _without(new[i], offsets[i : i + 1], w, int(firsts[i]), covered[firsts[i] : firsts[i + 1]])
        at = part.schema.get_field_index("text")
        return part.set_column(at, part.schema.field(at), pa.array(new, texts.type))

    return _scan(docs, benchmark, n, found, docs.schema)
