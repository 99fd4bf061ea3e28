"""Alignment of two tokenizers by token-byte incidence matrices.

A text stands as a space and its characters, in UTF-8. Each tokenizer has a matrix of its tokens' occurrences by bytes, in
compressed sparse rows built here: row i has a one for each byte of token i. Gustavson's row products A·Bᵀ give for each
token of A the tokens of B that share bytes with it, and how many (`overlap_links`). Offsets where a token of A and one of
B both end cut the bytes into groups; products of the two matrices of tokens by groups give the tokens that share a group
(`group_links`). Links that end together are the overlaps whose ranges have the same end.

Each link of a pair of ids adds one to the pair's count over all documents (`align`). Blocks of documents send the distinct
pairs that they have, as exact 64-bit keys, and get the totals back (`_packed`); pairs that are best for their id of B are
found from these. Only one number for each id of B, so at most a vocabulary, comes to the driver.

Long texts are encoded in parts, cut at single spaces between other characters, where the tokenizers' own files say that no
token crosses such a place. Texts that are null or empty, or whose tokens' bytes don't give the text again (a normalizer, or
U+2581 itself), have no tokens: numbers are 0 and the groups' hash is an empty string. Repeated rows, rows that share a
doc_id and null doc_ids are each on their own. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _packed, _store, _text

BLOCK_BYTES = 2 << 20
#: Characters of a part of a long text, about.
PART_CHARS = 1 << 16
#: Fixed value: how byte-level tokenizers split text before they merge bytes.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BETWEEN = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")


@dataclass(frozen=True)
class Sparse:
    """Compressed sparse rows: the columns of row i are indices[indptr[i]:indptr[i + 1]], in ascending order."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    width: int

    @staticmethod
    def of_lists(indptr: np.ndarray, indices: np.ndarray, width: int) -> Sparse:
        """Ones at the given columns."""
        return Sparse(indptr, indices, np.ones(len(indices), np.int64), width)

    @staticmethod
    def of_ranges(ends: np.ndarray) -> Sparse:
        """Row i has ones from ends[i - 1] to ends[i]: tokens, which follow each other, by bytes or groups."""
        indptr = np.concatenate(([0], ends))
        return Sparse.of_lists(indptr, np.arange(indptr[-1]), int(indptr[-1]))

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> Sparse:
        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate(([0], np.cumsum(np.bincount(self.indices, minlength=self.width))))
        return Sparse(indptr, self.rows[order], self.values[order], len(self.indptr) - 1)

    def part(self, first: int, last: int) -> Sparse:
        """Some rows."""
        a, b = self.indptr[first], self.indptr[last]
        return Sparse(self.indptr[first : last + 1] - a, self.indices[a:b], self.values[a:b], self.width)

    def times(self, other: Sparse) -> Sparse:
        """The product by Gustavson's rows: row i is the sum of other's rows k, weighed by the entries (i, k)."""
        sizes = np.diff(other.indptr)[self.indices]
        row = np.repeat(self.rows, sizes)
        at = np.arange(int(sizes.sum())) + np.repeat(other.indptr[self.indices] - (np.cumsum(sizes) - sizes), sizes)
        column, value = other.indices[at], np.repeat(self.values, sizes) * other.values[at]
        key = row * other.width + column
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(new):
            return Sparse(np.zeros(len(self.indptr), np.int64), key, value, other.width)
        summed = np.add.reduceat(value, new)
        row, column = key[new] // other.width, key[new] % other.width
        return Sparse(np.searchsorted(row, np.arange(len(self.indptr))), column, summed, other.width)


class Vocabulary:
    """The bytes of each id: `data[begin[i]:begin[i] + size[i]]`."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.size = np.zeros(max(tokens, default=-1) + 1, np.int64)
        for i, b in tokens.items():
            self.size[i] = len(b)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(len(self.size))), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        return self.data[np.arange(int(sizes.sum())) + np.repeat(self.begin[ids] - (ends - sizes), sizes)]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Ids of a byte-level BPE file of the tokenizers library; special tokens' strings are plain text.

    Where merges are listed in the order of their ids, nothing comes before or after them and pieces are those of
    `BYTE_LEVEL`, tiktoken gives the same ids from the file's vocabulary, faster.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        config = json.loads(self.tokenizer.to_str())
        model, before, letters = config["model"], config["pre_tokenizer"] or {}, byte_alphabet()
        if model["type"] != "BPE" or before.get("type") != "ByteLevel":
            raise ValueError(f"no byte-level BPE: {path}")
        vocabulary = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items() if all(c in letters for c in token)}
        self.vocabulary = Vocabulary(vocabulary)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ids = [model["vocab"].get(m) for m in merged]
        ordered = None not in ids and ids == sorted(set(ids)) and len(vocabulary) == len(ids) + 256 and ids[:1] > [max((i for i, b in vocabulary.items() if len(b) == 1), default=0)]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        free = config["normalizer"] is None and before["use_regex"] and not before["add_prefix_space"] and all(x["special"] for x in config["added_tokens"])
        self.fast = None
        if ordered and plain and free:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks={b: i for i, b in vocabulary.items()}, special_tokens={})
        self.divides = bool(free)

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        if self.fast:
            return [np.asarray(self.fast.encode_ordinary(p), np.int64) for p in parts]
        return [np.asarray(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


class Pieces:
    """Ids of a sentencepiece model, which adds a space before each text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {i: self.model.id_to_piece(i) for i in range(self.model.get_piece_size())}
        special = {i for i in names if self.model.is_control(i) or self.model.is_unknown(i)}
        single = {i: bytes([int(p[3:5], 16)]) for i, p in names.items() if self.model.is_byte(i)}
        self.vocabulary = Vocabulary({i: single.get(i, b"" if i in special else p.replace("▁", " ").encode()) for i, p in names.items()})
        # a cut before a space is safe if no piece goes on with a space after another character, and spaces stay as they are
        inside = any(re.search("[^▁]▁", p) for p in names.values())
        self.divides = not inside and self.vocabulary.joined(np.asarray(self.model.encode(" a  b "), np.int64)).tobytes() == b"  a  b "

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        return [np.asarray(x, np.int64) for x in self.model.encode(parts, num_threads=1)]


@functools.lru_cache(2)
def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


def _parts(text: str) -> list[str]:
    """Parts of which the text is made by single spaces between them."""
    out, at = [], 0
    while len(text) - at > 2 * PART_CHARS and (m := _BETWEEN.search(text, at + PART_CHARS)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


@dataclass
class Aligned:
    """Tokens of texts in one row of bytes: ids, ends, and of each text the numbers of its tokens, groups and bytes."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    text_ends: np.ndarray

    @property
    def groups(self) -> np.ndarray:
        """Ends of the groups: where tokens of both end. Texts end together, so groups don't cross them."""
        return np.intersect1d(self.a_ends, self.b_ends, assume_unique=True)

    def overlaps(self) -> Sparse:
        """A·Bᵀ: shared bytes of each pair of tokens that share some."""
        return Sparse.of_ranges(self.a_ends).times(Sparse.of_ranges(self.b_ends).transposed())

    def ending_together(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of A and of B whose ranges overlap and have the same end."""
        c = self.overlaps()
        i, j = c.rows, c.indices
        same = self.a_ends[i] == self.b_ends[j]
        return i[same], j[same]

    def by_groups(self) -> tuple[Sparse, Sparse]:
        """Tokens by groups, for A and for B."""
        ends = self.groups
        one = lambda x: Sparse.of_lists(np.arange(len(x) + 1), np.searchsorted(ends, x), len(ends))
        return one(self.a_ends), one(self.b_ends)


def encoded(texts: list[str | None], a: ByteLevel, b: Pieces) -> Aligned:
    """Tokens of texts; those without a faithful pair of encodings have none."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        if t:
            some = _parts(t) if a.divides and b.divides else [t]
            parts += some
            owner += [i] * len(some)
    left, right = a.encode([" " + p for p in parts]), b.encode(parts)
    ids = ([[] for _ in texts], [[] for _ in texts])
    for i, x, y in zip(owner, left, right, strict=True):
        ids[0][i].append(x)
        ids[1][i].append(y)
    none, kept, n_a, n_b, sizes = np.zeros(0, np.int64), ([], []), [], [], []
    for t, x, y in zip(texts, *ids, strict=True):
        x, y, raw = np.concatenate([none, *x]), np.concatenate([none, *y]), b" " + (t or "").encode()
        if not t or a.vocabulary.joined(x).tobytes() != raw or b.vocabulary.joined(y).tobytes() != raw:
            x, y, raw = none, none, b""
        kept[0].append(x)
        kept[1].append(y)
        n_a.append(len(x))
        n_b.append(len(y))
        sizes.append(len(raw))
    x, y = np.concatenate([none, *kept[0]]), np.concatenate([none, *kept[1]])
    # ids without bytes cannot stand here: the bytes of each token move its end on
    return Aligned(x, y, np.cumsum(a.vocabulary.size[x]), np.cumsum(b.vocabulary.size[y]), np.array(n_a, np.int64), np.array(n_b, np.int64), np.cumsum(np.array(sizes, np.int64)))


def _group_strings(t: Aligned) -> list[str]:
    """Of each text `a1,a2|b1;a3|b2,b3`: the ids of its groups."""
    ends = t.groups
    left, right = (m.transposed() for m in t.by_groups())  # groups by tokens
    both = np.stack([np.diff(left.indptr), np.diff(right.indptr)], 1).ravel()  # tokens of A and of B of each group in turn
    n = len(t.a) + len(t.b)
    starts = np.cumsum(both) - both
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    for k, (own, m) in enumerate(((t.a, left), (t.b, right))):
        at = np.arange(len(own)) + np.repeat(starts[k::2] - m.indptr[:-1], both[k::2])
        ids[at] = own[m.indices]
    mark[(starts + both - 1)[0::2]] = ord("|")
    mark[(starts + both - 1)[1::2]] = ord(";")
    digits = np.ones(n, np.int64)
    for p in range(1, 10):
        digits += ids >= 10**p
    stops = np.cumsum(digits + 1)
    out = np.empty(int(stops[-1]) if n else 0, np.uint8)
    out[stops - 1] = mark
    rest, at = ids.copy(), stops - 2
    some = np.arange(n)
    while len(some):
        out[at[some]] = 48 + rest[some] % 10
        rest[some] //= 10
        at[some] -= 1
        some = some[rest[some] > 0]
    raw = out.tobytes()
    upto = np.concatenate(([0], stops))[np.concatenate(([0], np.cumsum(t.n_a + t.n_b)))].tolist()
    return [raw[x : max(x, y - 1)].decode() for x, y in zip(upto[:-1], upto[1:], strict=True)]


_BLOCK = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_id", pa.list_(pa.int64())),
        *[(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")],
        ("groups_sha256", pa.list_(pa.string())),
        *[(c, pa.binary()) for c in ("keys", "own", "links")],
        ("size", pa.int64()),
    ]
)
_BLOCK_SQL = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, keys binary, own binary, links binary, size long"


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair of ids as one number, and back: a bijection whose upper bits are spread."""
    with np.errstate(over="ignore"):
        return (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * _text._P


def _right(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys * _text._P_INV & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _blocks(a: str, b: str, block_bytes: int):
    """Blocks of documents: numbers of each one, the distinct pairs, and each link as an index of these."""

    def close(block: int, held: list[tuple]) -> pa.RecordBatch:
        columns = [sum((list(x[i]) for x in held), []) for i in range(6)]
        keys, links = np.unique(np.concatenate([x[6] for x in held]), return_inverse=True)
        own = np.bincount(links, minlength=len(keys))
        row = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), columns, strict=True))
        return pa.RecordBatch.from_pylist([row | {"block": block, "keys": _packed.zipped_sorted(keys), "own": _packed.zipped(own), "links": _packed.zipped(links.astype(np.uint32)), "size": len(keys)}], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, held, size = tokenizers(a, b), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part in _text.slices(batch, "text"):
                t = encoded(part.column("text").to_pylist(), *pair)
                i, j = t.ending_together()
                per = lambda ends: np.diff(np.searchsorted(ends, t.text_ends, "right"), prepend=0).tolist()  # noqa: B023, E731
                hashes = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in _group_strings(t)]
                held.append((part.column("doc_id").to_pylist(), t.n_a.tolist(), t.n_b.tolist(), per(t.groups), per(t.a_ends[i]), hashes, _keys(t.a[i], t.b[j])))
                size += part.column("text").nbytes
                if size >= block_bytes:
                    yield close(block, held)
                    held, size, block = [], 0, block + 1
        if held:
            yield close(block, held)

    return run


def _requests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _packed.asked(row["block"], _packed.unzipped_sorted(row["keys"]), _packed.unzipped(row["own"], np.int64), bits)

    return run


def _totals(keys: np.ndarray, right: pa.Table, bits: int) -> np.ndarray:
    given = dict(zip(right.column("path").to_pylist(), right.column("totals").to_pylist(), strict=True))
    out = np.zeros(len(keys), np.int64)
    for path, lo, hi in _packed.spans(keys, bits):
        out[lo:hi] = _packed.unzipped(given[path], np.int64)
    return out


def _highest(bits: int):
    """Of a block: each id of B with its pairs' highest count."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = _packed.unzipped_sorted(left.column("keys")[0].as_py()) if left.num_rows else np.zeros(0, np.uint64)
        total, b = _totals(keys, right, bits), _right(keys)
        most = np.zeros(int(b.max(initial=-1)) + 1, np.int64)
        np.maximum.at(most, b, total)
        some = np.flatnonzero(most)
        return pa.table([pa.array(some, pa.int64()), pa.array(most[some], pa.int64())], ["b", "most"])

    return run


def _scores(bits: int, best: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            keys = _packed.unzipped_sorted(row["keys"])
            total, links = _totals(keys, right, bits), _packed.unzipped(row["links"], np.uint32).astype(np.int64)
            top = total == best[_right(keys)]
            ends = np.cumsum(row["n_links"])
            add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[ends], prepend=0)  # noqa: E731, B023
            numbers = [pa.array(row[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            out.append(pa.table([*numbers, pa.array(add(top[links]), pa.int64()), pa.array(add(total[links]), pa.int64()), pa.array(row["groups_sha256"], pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    return run


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    a: file of a byte-level BPE (tokenizers), b: file of a sentencepiece model; workers have them at these paths.
    """
    _store.small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _store.written(own.mapInArrow(_blocks(a, b, BLOCK_BYTES), _BLOCK_SQL), "align-blocks")
    keys = blocks.agg(F.sum("size")).first()[0] or 0
    bits = _packed.fan_bits(keys)
    rows = blocks.select("block", "keys", "own").mapInArrow(_requests(bits), _packed.ASK_SQL)
    answers = _store.written(_packed.totals(rows, keys, bits).select(F.col("child").alias("block"), "path", "totals"), "align-counts")
    highest = blocks.select("block", "keys").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_highest(bits), "b long, most long")
    found = highest.groupBy("b").agg(F.max("most").alias("most")).toPandas()  # a row for each id of B at most
    best = np.zeros(int(found["b"].max()) + 1 if len(found) else 0, np.int64)
    best[found["b"].to_numpy(np.int64)] = found["most"].to_numpy(np.int64)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return blocks.drop("own", "size").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(bits, best), schema)


def links(docs: DataFrame, a: str, b: str, kind: str = "overlap") -> DataFrame:
    """doc_id, a_place, b_place (numbers of tokens in the text), a_id, b_id, weight of each pair of occurrences.

    kind: overlap (weight: shared bytes), end (those that end together) or group (those in one group; weight 1).
    """
    if kind not in ("overlap", "end", "group"):
        raise ValueError(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(a, b)
        for batch in batches:
            for part in _text.slices(batch, "text"):
                t = encoded(part.column("text").to_pylist(), *pair)
                ids = part.column("doc_id").to_pylist()
                left, right = t.by_groups() if kind == "group" else (Sparse.of_ranges(t.a_ends), Sparse.of_ranges(t.b_ends))
                right, a_first, b_first = right.transposed(), np.cumsum(t.n_a) - t.n_a, np.cumsum(t.n_b) - t.n_b
                owner = np.repeat(np.arange(len(ids)), t.n_a)
                for k in range(0, len(t.a), 4096):  # rows of the product at a time
                    c = left.part(k, min(k + 4096, len(t.a))).times(right)
                    i, j, weight = c.rows + k, c.indices, c.values
                    if kind == "end":
                        same = t.a_ends[i] == t.b_ends[j]
                        i, j, weight = i[same], j[same], weight[same]
                    doc = owner[i]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[d] for d in doc.tolist()], pa.int64()), *[pa.array(x, pa.int64()) for x in (i - a_first[doc], j - b_first[doc], t.a[i], t.b[j], weight)]],
                        ["doc_id", "a_place", "b_place", "a_id", "b_id", "weight"],
                    )

    _store.small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, a_place long, b_place long, a_id long, b_id long, weight long")
