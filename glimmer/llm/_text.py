"""Columnar word splitting and hashing on Arrow string buffers.

A class of ASCII bytes separates words; every other byte, and so every non-ASCII character, belongs to a word. Whole
slices of a column are split at once with numpy. Hashes are 64 bits wide; two different strings share one with a
probability of about 2**-57 at worst.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes(range(256)).lower()
#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 1 << 18

#: Bytes that are hashed at once, unless a single word is longer.
HASH_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass(frozen=True)
class Alphabet:
    """Byte tables: what each byte counts as, and whether it belongs to a word."""

    value: np.ndarray
    word: np.ndarray


def alphabet(separators: bytes, lower: bool) -> Alphabet:
    word = np.ones(256, bool)
    word[list(separators)] = False
    return Alphabet(np.frombuffer(_LOWER if lower else bytes(range(256)), np.uint8), word)


#: `[^\x20\x09-\x0D]+`, unchanged or with A-Z lower-cased.
WORDS = alphabet(SPACE, False)
WORDS_LOWER = alphabet(SPACE, True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM_LOWER = alphabet(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), True)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and its inverse for i < n, modulo 2**64."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, p))), dtype=np.uint64) for p in (_P, _P_INV))
        if n <= 1 << 21:
            _powers[0] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span, which depends on the values and the length alone."""
    p, inv = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * p[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def same(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of left from a and those of right from b, sizes (1 at least) long, are equal."""
    out, step = np.ones(len(a), bool), 8192
    for k in range(0, len(a), step):
        n = sizes[k : k + step]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        differ = left[at + np.repeat(a[k : k + step], n)] != right[at + np.repeat(b[k : k + step], n)]
        out[k : k + step] = np.add.reduceat(differ, ends - n) == 0
    return out


@dataclass
class Words:
    """Words of a slice: `counts` per text; `data[starts:ends]` are the bytes of each, `inside` marks them all."""

    data: np.ndarray
    inside: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        """The index of each text's first word, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self) -> np.ndarray:
        """A hash of each word; bytes are taken some HASH_BYTES at a time, between words, so memory doesn't follow long texts."""
        if len(self.data) <= HASH_BYTES:
            return spans_hash(_BYTE_VALUE[self.data], self.starts, self.ends)
        out, first = np.empty(len(self.starts), np.uint64), 0
        while first < len(out):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + HASH_BYTES, "right")))
            a, b = self.starts[first], self.ends[last - 1]
            out[first:last] = spans_hash(_BYTE_VALUE[self.data[a:b]], self.starts[first:last] - a, self.ends[first:last] - a)
            first = last
        return out

    def strings(self) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        return pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[self.inside]))


def split(texts: pa.Array, table: Alphabet) -> Words:
    """Words of each text of a string column; null has none."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data, inside = table.value[raw], table.word[raw]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, inside, none, none, np.zeros(len(texts), np.int64))
    new = inside.copy()
    new[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    new[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
    return Words(data, inside, starts, ends, np.diff(np.searchsorted(starts, offsets)))


def lower_ascii(words: Words) -> Words:
    """The words with A-Z lower-cased in those that are pure ASCII; others keep their bytes."""
    data = WORDS_LOWER.value[words.data]
    high = np.concatenate(([0], np.cumsum(words.data > 0x7F)))
    mixed = np.flatnonzero(high[words.ends] > high[words.starts])
    sizes = words.ends[mixed] - words.starts[mixed]
    ends = np.cumsum(sizes)
    at = np.arange(int(sizes.sum())) + np.repeat(words.starts[mixed] - (ends - sizes), sizes)
    data[at] = words.data[at]
    return replace(words, data=data)


def slices(batch: pa.RecordBatch | pa.Table, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about `size` bytes of the column's text at most, at least one row each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, used = 0, 0
    for i, n in enumerate(lengths):
        if used and used + n > size:
            yield batch.slice(at, i - at)
            at, used = i, 0
        used += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)
    pa.default_memory_pool().release_unused()  # workers live on between tasks
