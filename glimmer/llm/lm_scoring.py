"""Language-model scores from a weighted backoff automaton.

States are contexts of up to `order` - 1 words that training texts have, the text's start among them; an arc is a
training n-gram: from its first words as a context to its last word. With counts c of N training tokens of V kinds, the
empty context gives p(w) = (c(w) + 1) / (N + V + 1), also for the one unknown word. From state h the arc of w has the
weight (c(hw) + K p'(w)) / (c(h) + K), where p' is what the next shorter context gives and K the order's `strength`.
Without such an arc the failure arc leads to that shorter context, a state itself, with the weight K / (c(h) + K), and
there the same holds. So weights from each state sum to one. A text is read once from left to right: the state carried
is the longest context that training has of the words just read (none after an unknown one), and log10 weights of
failure arcs and the arc taken are added up.

Training documents are those whose crc32(doc_id as text) mod 7 is not 2 (null doc_id: empty text). Tokens are words
`[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end. The automaton grows with the corpus and is never in one place:
documents are read in blocks; each block asks for the totals of the n-grams that it has (`_packed`), which are the
automaton's part that its texts can reach. All n-grams are told apart by 63 bits of hashes.

Null and empty texts are the end token alone. Repeated rows are counted and scored one by one. Without training
documents all counts are 0. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store, _text
from ._packed import ASK_SQL, asked, fan_bits, spans, totals, unzipped, unzipped_sorted, zipped, zipped_sorted

HELD_OUT_OF, HELD_OUT = 7, 2
#: K of bigrams, trigrams and longer n-grams: what a context's own counts are weighed against.
STRENGTH = (300.0, 10.0)
ORDER = 3
BLOCK_TOKENS = 5 << 18
_END, _START = np.uint64(0x656E64), np.uint64(0x7374617274)
#: The lowest bit of a hash marks single words; the other 63 tell n-grams apart.
_KEPT, _ONE = ~np.uint64(1), np.uint64(1)


_BLOCK = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("trained", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("counts", pa.list_(pa.int32())), ("keys", pa.binary()), ("tokens", pa.binary())])
_BLOCK_SQL = "block long, size long, trained long, doc_id array<long>, held array<boolean>, counts array<int>, keys binary, tokens binary"


def _by_rank(tokens: np.ndarray, n: int) -> bytes:
    """Indexes below n, packed as ranks by frequency, which are mostly small; frequencies go along and give the ranks' meaning."""
    often = np.bincount(tokens, minlength=n).astype(np.uint32)
    rank = np.empty(n, np.uint32)
    rank[np.argsort(-often.astype(np.int64), kind="stable")] = np.arange(n, dtype=np.uint32)
    head = zipped(often)
    return len(head).to_bytes(8, "little") + head + zipped(rank[tokens], 9)


def _from_ranks(packed: bytes) -> np.ndarray:
    cut = 8 + int.from_bytes(packed[:8], "little")
    often = unzipped(packed[8:cut], np.uint32)
    return np.argsort(-often.astype(np.int64), kind="stable")[unzipped(packed[cut:], np.uint32)]


def _blocks(block_tokens: int):
    """Blocks of documents: their words' sorted hashes, and their tokens as indexes of these."""

    def close(block: int, ids: list, held: list, counts: list, hashes: list) -> pa.RecordBatch:
        keys, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        sizes = np.concatenate(counts)
        row = {"block": block, "size": len(tokens), "trained": int(sizes[~np.array(held, bool)].sum()), "doc_id": ids, "held": held, "counts": sizes.tolist()}
        return pa.RecordBatch.from_pylist([row | {"keys": zipped_sorted(keys), "tokens": _by_rank(tokens, len(keys))}], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids, held, counts, hashes, n = [], [], [], [], 0
        for batch in batches:
            for part in _text.slices(batch, "text"):
                w = _text.split(part.column("text"), _text.WORDS_LOWER)
                h = np.insert(w.hashes(), np.cumsum(w.counts), _END)
                ids += part.column("doc_id").to_pylist()
                held += part.column("held").to_pylist()
                counts.append(w.counts + 1)
                hashes.append(h)
                n += len(h)
                if n >= block_tokens:
                    yield close(block, ids, held, counts, hashes)
                    ids, held, counts, hashes, n, block = [], [], [], [], 0, block + 1
        if n:
            yield close(block, ids, held, counts, hashes)

    return run


class Block:
    """A block read again: the n-grams that it has of each length, and where they end.

    Of length k: `gram` is each token's n-gram (-1 where the text's start is too near), `context` that of the k - 1 words
    before it. The start stands before a text's first token. Hashes of single words are odd, longer ones even.
    """

    def __init__(self, held: list[bool], counts: list[int], keys: bytes, tokens: bytes, order: int) -> None:
        self.counts = np.array(counts, np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        words, token = unzipped_sorted(keys), _from_ranks(tokens)
        trains = np.repeat(~np.array(held, bool), self.counts)
        begins = np.zeros(len(token), bool)
        begins[self.first] = True
        self.gram, self.context, self.hashes = [token], [np.full(len(token), -1)], [words | _ONE]
        self.own = [np.bincount(token[trains], minlength=len(words))]
        for k in range(2, order + 1):
            context = np.concatenate(([-1], self.gram[-1][:-1]))
            hashes = self.hashes[-1]
            if k == 2:  # contexts are single words, and the start as the last of them
                context[begins] = len(words)
                hashes = np.append(words, _START)
            else:
                context[begins] = -1
            at = np.flatnonzero(context >= 0)
            pairs, back = np.unique(context[at] * len(words) + token[at], return_inverse=True)
            with np.errstate(over="ignore"):
                new = _text.mix(hashes[pairs // len(words)] * np.uint64(0xA24BAED4963EE407 + 2 * k) + words[pairs % len(words)]) & _KEPT
            gram = np.full(len(token), -1)
            gram[at] = back
            self.gram.append(gram)
            self.context.append(context)
            self.hashes.append(new)
            self.own.append(np.bincount(back[trains[at]], minlength=len(new)))
        self.end = int(np.searchsorted(words, _END))  # each text has one, so it is a word of the block
        every = np.concatenate(self.hashes)
        self.order = np.argsort(every)
        self.sorted = every[self.order]

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of all n-grams, and the block's own training counts."""
        return self.sorted, np.concatenate(self.own)[self.order]

    def totals(self, given: dict[int, bytes], bits: int) -> list[np.ndarray]:
        """Counts of the n-grams of each length from the answers to ranges."""
        every = np.empty(len(self.sorted), np.int64)
        for path, lo, hi in spans(self.sorted, bits):
            every[self.order[lo:hi]] = unzipped(given[path], np.int64)
        return np.split(every, np.cumsum([len(x) for x in self.hashes])[:-1])


def _requests(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield asked(row["block"], *Block(row["held"], row["counts"], row["keys"], row["tokens"], order).counted(), bits)

    return run


def _scores(order: int, bits: int, n_tokens: int, n_types: int, strength: tuple[float, ...]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        given = dict(zip(right.column("path").to_pylist(), right.column("totals").to_pylist(), strict=True))
        out = []
        for row in left.to_pylist():
            block = Block(row["held"], row["counts"], row["keys"], row["tokens"], order)
            count = block.totals(given, bits)
            base = ((count[0] + 1) / (n_tokens + n_types + 1))[block.gram[0]]
            known = count[0][block.gram[0]] > 0
            count[0] = np.append(count[0], count[0][block.end])  # each training text has a start, as it has an end
            p, step = base, np.log10(base)
            for k in range(2, order + 1):
                gram, context, weight = block.gram[k - 1], block.context[k - 1], strength[min(k - 2, len(strength) - 1)]
                state = np.where(context >= 0, count[k - 2][context], 0)  # 0: training has no such state, so it isn't carried
                arc = np.where(gram >= 0, count[k - 1][gram], 0)
                p = np.where(state > 0, (arc + weight * p) / (state + weight), p)
                fail = np.log10(weight / (state + weight))
                step = np.where(arc > 0, np.log10(p), step + fail)
            add = lambda x: np.add.reduceat(x, block.first)  # noqa: E731, B023
            out.append(
                pa.table(
                    [
                        pa.array(row["doc_id"], pa.int64()),
                        pa.array(row["held"], pa.bool_()),
                        pa.array(block.counts, pa.int64()),
                        pa.array(add(known.astype(np.int64)), pa.int64()),
                        pa.array(np.full(len(block.counts), n_tokens), pa.int64()),
                        pa.array(add(np.log10(base)), pa.float64()),
                        pa.array(add(step), pa.float64()),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, order: int = ORDER, strength: tuple[float, ...] = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (words alone), score (the automaton's log10 probability).

    order: words of the longest n-grams, 2 at least; strength: K of each order from 2 on, the last one for all further.
    """
    if order < 2:
        raise ValueError(order)
    _store.small_batches(docs.sparkSession)
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(HELD_OUT_OF)) == HELD_OUT
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
    blocks = _store.written(own.mapInArrow(_blocks(BLOCK_TOKENS), _BLOCK_SQL), "lm-blocks")
    size = blocks.agg(F.sum("size").alias("tokens"), F.sum("trained").alias("trained")).first()
    keys = order * (size["tokens"] or 0)  # n-grams of all blocks, at most
    bits = fan_bits(keys)
    rows = blocks.select("block", "held", "counts", "keys", "tokens").mapInArrow(_requests(order, bits), ASK_SQL)
    answers = _store.written(totals(rows, keys, bits), "lm-counts")
    types = answers.agg(F.sum("types")).first()[0] or 0
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asks = answers.select(F.col("child").alias("block"), "path", "totals").groupBy("block")
    return blocks.drop("size", "trained").groupBy("block").cogroup(asks).applyInArrow(_scores(order, bits, size["trained"] or 0, types, strength), schema)
