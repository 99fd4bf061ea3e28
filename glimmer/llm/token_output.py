"""Token ids in bit- or byte-plane chunks.

Texts are dealt by ranges of doc_id, so that a shard (one partition, one file) follows the other in ascending doc_id
order, and each shard is encoded as one stream of ids: those of a text, then an end id. Blocks of `chunk_ids` ids are
transposed, so that equal bytes (or bits) of all ids stand together, and each plane is compressed with zstandard on its
own. A row of the output, which is a Parquet folder written by Spark, is a chunk: `planes`, and the chunk index, namely
shard, chunk, n_ids, crc32 and the documents in it with their place. Parquet reads the index without the planes.

Null text is encoded as empty, so it has the end id alone. Null doc_ids come first. Rows that share a doc_id stand in
the order of their texts' hashes, and each is a document of its own. A text of any length may span chunks. Empty tables
give an empty folder. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _store, _text

CHUNK_IDS = 1 << 16
SCHEMA = "shard int, chunk long, n_ids int, kind string, crc32 long, planes array<binary>, docs array<struct<ordinal: long, doc_id: long, begin: int, n: int>>"
_ARROW = pa.schema(
    [
        ("shard", pa.int32()),
        ("chunk", pa.int64()),
        ("n_ids", pa.int32()),
        ("kind", pa.string()),
        ("crc32", pa.int64()),
        ("planes", pa.list_(pa.binary())),
        ("docs", pa.list_(pa.struct([("ordinal", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int32()), ("n", pa.int32())]))),
    ]
)
_PUNCTUATION = ".,!?;:"


#: The pre-tokenizer of which each piece is a match of this pattern, none of which has white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _steps(config: dict | None, key: str) -> list[dict]:
    return [] if config is None else config.get(key, [config])


class Encoder:
    """Ids of texts by one tokenizer.

    Where its own settings say that no piece has white space (words split by `PIECES`, after steps that leave ASCII white
    space between words as it is), each word is encoded by itself. Ids of words are kept and found by the words' hash, in
    a table of fixed size, where a new word takes the place of an older one; the words' bytes are kept and compared too.
    Other tokenizers encode whole texts.
    """

    SLOTS = 1 << 21
    POOL, BYTES = 12 << 20, 32 << 20

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        before, split = _steps(config["normalizer"], "normalizers"), _steps(config["pre_tokenizer"], "pretokenizers")
        harmless = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in before)
        first = split[0] if split else {}
        pieces = first.get("type") == "Split" and first.get("pattern") == {"Regex": PIECES} and first.get("behavior") == "Removed" and first.get("invert")
        spaced = any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or x["single_word"] for x in config["added_tokens"])
        self.by_word = bool(harmless and pieces and not spaced)
        self.lowers = self.by_word and any(x["type"] == "Lowercase" for x in before)
        #: Beginnings of added tokens, which lower-casing ahead of the tokenizer could make or break.
        self.added = [x["content"][:2] for x in config["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(self.SLOTS, np.uint64)
        self.at, self.size, self.word_at, self.word_size = (np.zeros(self.SLOTS, np.int32) for _ in range(4))
        self.pool, self.bytes = np.zeros(self.POOL, np.uint32), np.zeros(self.BYTES, np.uint8)
        self.used, self.bytes_used = 0, 0

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many words, and where each word's begin and how many they are."""
        plain, parts, other = [], [], []
        for i, w in enumerate(words):
            stem = w.rstrip(_PUNCTUATION)
            if (stem.isascii() and stem.isalpha()) or (stem.isalpha() and unicodedata.normalize("NFC", unicodedata.normalize("NFC", stem).lower()).isalpha()):
                plain.append(i)
                parts.append(1 + (len(stem) < len(w)))
            else:
                other.append(i)
        found, order, sizes = [], [], []
        # such words have one or two pieces, and the vocabulary tells where a piece ends
        chunks = [" ".join([words[i] for i in plain[k : k + 1000]]) for k in range(0, len(plain), 1000)]
        for k, e in enumerate(self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)):
            some = plain[1000 * k : 1000 * k + 1000]
            ids = np.asarray(e.ids, np.uint32)
            ends, last = np.flatnonzero(self.closes[ids]) + 1, np.cumsum(parts[1000 * k : 1000 * k + 1000]) - 1
            if len(ends) != last[-1] + 1 or ends[-1] != len(ids):
                other += some
                continue
            found.append(ids)
            order += some
            sizes.append(np.diff(ends[last], prepend=0))
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)]
        found.append(np.fromiter((x for ids in rest for x in ids), np.uint32))
        sizes.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        order, size = np.array([*order, *other], np.int64), np.concatenate(sizes)
        start, n = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[order], n[order] = np.cumsum(size) - size, size
        return np.concatenate(found), start, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and the number of each text's."""
        if not self.by_word:
            all_ids = [e.ids for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.fromiter((x for ids in all_ids for x in ids), np.uint32), np.fromiter(map(len, all_ids), np.int64, len(all_ids))
        words = _text.split(texts, _text.WORDS)
        # the tokenizer lower-cases too, unless its added tokens may be meant; it composes letters first, so that
        # words with any other than ASCII stay as they are
        if self.lowers and not any(pc.any(pc.match_substring(pc.fill_null(texts, ""), x, ignore_case=True)).as_py() for x in set(self.added)):
            words = _text.lower_ascii(words)
        h, lengths = np.maximum(words.hashes(), np.uint64(1)), words.ends - words.starts
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        start, n = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        hit = (self.key[slot] == h) & (self.word_size[slot] == lengths)
        at = np.flatnonzero(hit)
        hit[at] = _text.same(words.data, words.starts[at], self.bytes, self.word_at[slot[at]].astype(np.int64), lengths[at])
        missed, pool = np.flatnonzero(~hit), self.pool
        if len(missed):
            new, first, back = np.unique(h[missed], return_index=True, return_inverse=True)
            one = missed[first]  # of each hash the first word; another with the same hash stands for itself
            alike = lengths[missed] == lengths[one[back]]
            at = np.flatnonzero(alike)
            alike[at] = _text.same(words.data, words.starts[missed[at]], words.data, words.starts[one[back[at]]], lengths[missed[at]])
            back[~alike] = len(one) + np.arange(int((~alike).sum()))
            raw, wanted = words.data.tobytes(), np.concatenate([one, missed[~alike]])
            ids, begin, sizes = self._words([raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[wanted].tolist(), words.ends[wanted].tolist(), strict=True)])
            held = int(lengths[one].sum())
            if self.used + len(ids) > self.POOL or self.bytes_used + held > self.BYTES:  # begins anew; the ids found above stay in the old pool
                old = pool[: self.used].copy()
                self._clear()
                pool, base = np.concatenate((old, ids)), len(old)
            else:
                base = self.used
            if len(ids) <= self.POOL and held <= self.BYTES:
                self._keep(new, ids, begin[: len(one)], sizes[: len(one)], words.data, words.starts[one], lengths[one])
            start[missed], n[missed] = (base + begin)[back], sizes[back]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return pool[np.arange(total) + np.repeat(start - (ends - n), n)], np.diff(np.concatenate(([0], ends))[words.firsts])

    def _keep(self, keys: np.ndarray, ids: np.ndarray, begin: np.ndarray, sizes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.pool[self.used : self.used + len(ids)] = ids
        slot = (keys & np.uint64(self.SLOTS - 1)).astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1])
        self.bytes[self.bytes_used : self.bytes_used + total] = data[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]
        # where two of them share a slot, all of the last one's entries count, as numpy assigns in order
        self.key[slot] = keys
        self.at[slot], self.size[slot] = self.used + begin, sizes
        self.word_at[slot], self.word_size[slot] = self.bytes_used + ends - lengths, lengths
        self.used, self.bytes_used = self.used + len(ids), self.bytes_used + total


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """Compressed planes of 32-bit ids, the lowest byte (bit) first."""
    columns = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = [np.packbits(columns[:, i // 8] >> (i % 8) & 1).tobytes() for i in range(32)]
    else:
        planes = [columns[:, i].tobytes() for i in range(4)]
    c = zstandard.ZstdCompressor(level=level)
    return [c.compress(p) for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    d = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(d.decompress(p), np.uint8) for p in planes]
    out = np.zeros((n, 4), np.uint8)
    for i, p in enumerate(raw):
        if kind == "bit":
            out[:, i // 8] |= np.unpackbits(p, count=n) << (i % 8)
        else:
            out[:, i] = p
    return out.view("<u4").ravel()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, chunk_ids: int = CHUNK_IDS, kind: str = "byte") -> None:
    """Encodes the texts of docs (doc_id, text) into the folder path."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        ids: list[np.ndarray] = []  # of the chunk in the making
        inside: list[dict] = []
        held, chunk, ordinal = 0, 0, 0

        def close() -> pa.RecordBatch:
            block = np.concatenate(ids)
            row = {"shard": shard, "chunk": chunk, "n_ids": len(block), "kind": kind, "crc32": zlib.crc32(block.astype("<u4").tobytes()), "planes": to_planes(block, kind), "docs": inside}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for part in _text.slices(batch, "text"):
                found, counts = encoder.encode(part.column("text"))
                ends = np.cumsum(counts)
                stream = np.insert(found, ends, end_id).astype(np.uint32)
                at = 0
                for doc_id, size in zip(part.column("doc_id").to_pylist(), (counts + 1).tolist(), strict=True):
                    while size:
                        n = min(size, chunk_ids - held)
                        inside.append({"ordinal": ordinal, "doc_id": doc_id, "begin": held, "n": n})
                        ids.append(stream[at : at + n])
                        at, held, size = at + n, held + n, size - n
                        if held == chunk_ids:
                            yield close()
                            ids, inside, held, chunk = [], [], 0, chunk + 1
                    ordinal += 1
        if held:
            yield close()

    _store.small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    dealt = own.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    dealt.mapInArrow(encode, SCHEMA).write.option("compression", "none").parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The chunks, with start: the number of ids in all chunks before."""
    chunks = spark.read.schema(SCHEMA).parquet(path)
    # one row for each shard, of which there are as many as partitions
    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.max("n_ids").alias("full"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("base"), "full")
    return chunks.join(F.broadcast(shards), "shard").withColumn("start", F.col("base") + F.col("chunk") * F.col("full")).drop("base", "full")


def index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index: shard, chunk, start (ids in all chunks before), n_ids, crc32, docs."""
    return _placed(spark, path).select("shard", "chunk", "start", "n_ids", "crc32", "docs")


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """shard, ordinal, doc_id, n_tokens of each document, from the chunk index alone."""
    docs = spark.read.schema(SCHEMA).parquet(path).select("shard", F.explode("docs").alias("d"))
    return docs.groupBy("shard", "d.ordinal", "d.doc_id").agg(F.sum("d.n").cast("long").alias("n_tokens"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of documents in the files' order: shard, ordinal, doc_id, chunk, begin, ids. A document is one piece, or a piece a chunk."""

    _store.small_batches(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _checked(row)
                out = [(row["shard"], d["ordinal"], d["doc_id"], row["chunk"], d["begin"], block[d["begin"] : d["begin"] + d["n"]].astype(np.int64)) for d in row["docs"]]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "ordinal", "doc_id", "chunk", "begin", "ids"])

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(decode, "shard int, ordinal long, doc_id long, chunk long, begin int, ids array<long>")


def _checked(row: dict) -> np.ndarray:
    block = from_planes(row["planes"], row["n_ids"], row["kind"])
    if zlib.crc32(block.tobytes()) != row["crc32"]:
        raise ValueError(f"shard {row['shard']}, chunk {row['chunk']} is damaged")
    return block


def _crc_join(a: int, b: int, n: int) -> int:
    """The crc32 of two strings put together, from theirs and the second's length: a is carried over n zero bytes."""
    row = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit, as a matrix of GF(2)
    times = lambda m, v: _xor(m[i] for i in range(32) if v >> i & 1)
    square = lambda m: [times(m, x) for x in m]
    m = square(square(square(row)))  # one zero byte
    while n:
        if n & 1:
            a = times(m, a)
        n >>= 1
        if n:
            m = square(m)
    return a ^ b


def _xor(values) -> int:
    out = 0
    for v in values:
        out ^= v
    return out


def digest(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of each document."""

    _store.small_batches(spark)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = memoryview(_checked(row).tobytes())
                out = [(row["shard"], d["ordinal"], d["doc_id"], row["start"] + d["begin"], d["n"], zlib.crc32(raw[4 * d["begin"] : 4 * (d["begin"] + d["n"])])) for d in row["docs"]]
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "ordinal", "doc_id", "start", "n", "crc"])

    @F.udf("long")
    def whole(pieces):
        total = pieces[0]["crc"]
        for p in pieces[1:]:
            total = _crc_join(total, p["crc"], 4 * p["n"])
        return total

    pieces = _placed(spark, path).mapInArrow(sums, "shard int, ordinal long, doc_id long, start long, n long, crc long")
    docs = pieces.groupBy("shard", "ordinal", "doc_id").agg(F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("pieces"))
    # by themselves, as Spark would run the function on all rows of one table; both read the same exchange
    single = docs.filter(F.size("pieces") == 1).withColumn("ids_crc32", F.col("pieces")[0]["crc"])
    spread = docs.filter(F.size("pieces") > 1).withColumn("ids_crc32", whole("pieces"))
    return single.unionByName(spread).select("doc_id", "start", "n_tokens", "ids_crc32")
