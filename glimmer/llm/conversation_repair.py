"""Repair of conversations' structure, with tables of blocks as in the Four Russians' method.

Rows of a conversation, in order of turn (nulls first), role and text, are to become turns whose roles' initials are
`(s?(ua)+)?`. Keeping a row is free, giving it the role user or assistant costs 3, deleting it 4; an empty turn of either
role may be inserted anywhere for 3. Rows that stay although they are truncated add 3; blank rows and those whose role and
text were there before have to go. Of all cheapest repairs the one whose edits' initials (D, I, K, R) come first in ASCII
is taken.

A state says which role is due: at the start, after system, user or assistant. The due role, and so the new state, follows
from the edit alone, so a string of edits stands for one repair. Costs from each state to the end, taken before some row
and less their minimum, differ by little, so only some dozens of such vectors exist. A row is one of ten symbols; for each
vector after a block of `BLOCK` symbols, and each block, tables hold the vector before it and what was taken off
(`Tables.before`, `Tables.off`). A conversation is read from its end by lookups, a block each; then, from its start, each
block is expanded backward from the vector after it into its rows' costs, and at each row the first letter is taken that
lies on a cheapest way, so that ties are told apart exactly (`Tables.expand`).

No task holds a conversation: rows are sorted by ranges and cut into segments of bounded size. Those of conversations that
lie within a range as one segment are repaired at once. Others are first turned into functions, from the vector after
a segment and the state before it to the vector before and the state after it, by the same tables; functions are composed
in one small row a segment, and then each segment is repaired by itself. First copies of rows across segments are found by
128-bit hashes.

Null role or text is one space, as are such in damage's keys. Null conv_id is a conversation. Rows alike in all columns are
duplicates of each other. Very long texts stand in a segment of their own. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _store

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that is due in each state, and the state to which it leads.
DUE, NEXT = ("user", "user", "assistant", "user"), (USER, USER, ASSISTANT, USER)
#: Where rows kept as they are lead, by their role's initial.
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Symbols: 0 has to go, then two for each initial, whole and truncated, with other initials last; 9 is no row.
SYMBOLS, NOTHING = 10, 9
BLOCK = 4
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 18
LEGAL = {"su", "ua", "au"}
#: Costs from each state to the end, where no row is left.
AT_END = (0, 6, 3, 0)


def _before(after: tuple, symbol: int) -> tuple:
    """Costs from each state to the end before a row, from those after it."""
    if symbol == NOTHING:
        return after
    costs = [x + DELETE for x in after]
    if symbol:
        kind, cut = divmod(symbol - 1, 2)
        for s in range(4):
            costs[s] = min(costs[s], after[NEXT[s]] + REROLE + TRUNCATED * cut)
            to = KEEPS.get("sua "[kind], {}).get(s)
            if to is not None:
                costs[s] = min(costs[s], after[to] + TRUNCATED * cut)
    for _ in range(2):
        costs = [min(c, costs[NEXT[s]] + INSERT) for s, c in enumerate(costs)]
    return tuple(costs)


class Tables:
    """Vectors of costs less their minimum, and transitions of all blocks between them."""

    def __init__(self) -> None:
        self.vectors, number, step, off, at = [AT_END], {AT_END: 0}, [], [], 0
        while at < len(self.vectors):
            to, less = [], []
            for symbol in range(SYMBOLS):
                costs = _before(self.vectors[at], symbol)
                low = min(costs)
                vector = tuple(c - low for c in costs)
                if vector not in number:
                    number[vector] = len(self.vectors)
                    self.vectors.append(vector)
                to.append(number[vector])
                less.append(low)
            step.append(to)
            off.append(less)
            at += 1
        one, less = np.array(step), np.array(off)
        before, taken = one, less
        for _ in range(BLOCK - 1):  # another row in front of the block
            taken = (taken[:, None, :] + less[before].swapaxes(1, 2)).reshape(len(one), -1)
            before = one[before].swapaxes(1, 2).reshape(len(one), -1)
        self.before, self.off = before, taken
        self.rows = before.tolist()  # for single lookups
        self.known: dict[tuple[int, int, int], tuple[str, int]] = {}

    def expand(self, after: int, code: int, state: int) -> tuple[str, int]:
        """The edits of a block, from the vector after it and the state before it, and the state after it."""
        key = (after, code, state)
        if key not in self.known:
            symbols = [code // SYMBOLS ** (BLOCK - 1 - i) % SYMBOLS for i in range(BLOCK)]
            costs = [self.vectors[after]]
            for symbol in reversed(symbols):
                costs.append(_before(costs[-1], symbol))
            costs.reverse()
            out, i, s = "", 0, state
            while i < BLOCK:
                here, later, symbol = costs[i][s], costs[i + 1], symbols[i]
                if symbol == NOTHING:
                    i += 1
                    continue
                kind, cut = divmod(symbol - 1, 2)
                extra = TRUNCATED * cut
                to = KEEPS.get("sua "[kind], {}).get(s) if symbol else None
                if later[s] + DELETE == here:
                    out, i = out + "D", i + 1
                elif costs[i][NEXT[s]] + INSERT == here:
                    out, s = out + "I", NEXT[s]
                elif to is not None and later[to] + extra == here:
                    out, s, i = out + "K", to, i + 1
                else:
                    out, s, i = out + "R", NEXT[s], i + 1
            self.known[key] = out, s
        return self.known[key]

    def trace(self, codes: list[int], after: int, state: int) -> tuple[str, int]:
        """The edits of some blocks from the vector after them and the state before them, and the state after them."""
        behind = [after]
        for code in reversed(codes[1:]):
            behind.append(self.rows[behind[-1]][code])
        out = []
        for code, vector in zip(codes, reversed(behind), strict=True):
            edits, state = self.expand(vector, code, state)
            out.append(edits)
        return "".join(out), state

    def function(self, codes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of some blocks: for each vector after them the one before, and the state after them for each state before."""
        vector = np.arange(len(self.vectors))
        for code in reversed(codes):
            vector = self.before[vector, code]
        states = [[self.trace(codes, v, s)[1] for s in range(4)] for v in range(len(self.vectors))]
        return vector, np.array(states)


@functools.lru_cache(1)
def tables() -> Tables:
    return Tables()


def finish(state: int) -> tuple[str, list[str]]:
    """Edits after the last row, and the roles that they insert."""
    roles = []
    while state not in (START, ASSISTANT):
        roles.append(DUE[state])
        state = NEXT[state]
    return "I" * len(roles), roles


def damaged(talks: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage, by crc32 of `conv_id:turn` modulo 20 (nulls: one space): 0 drops a row, 1 empties
    its text, 2 takes its `[.!?]` away, 3 repeats it, 4 makes its role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))), F.lit(20))
    said = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    rows = talks.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        said.alias("text"),
        F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"),
        kind.alias("kind"),
    ).filter("kind != 0")
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


_SEGMENT = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("whole", pa.bool_()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_SEGMENT_SQL = "conv_id long, segment long, whole boolean, turns array<long>, roles array<string>, texts array<string>"


def _cut(rows: int, chars: int):
    """Segments of sorted rows, numbered in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, ready, first, split = TaskContext.get().partitionId() << 32, [], 0, [], True, False

        def close(whole: bool) -> None:
            nonlocal number, held, size
            conv, turns, roles, texts = zip(*held, strict=True)
            ready.append({"conv_id": conv[0], "segment": number, "whole": whole, "turns": turns, "roles": roles, "texts": texts})
            number, held, size = number + 1, [], 0

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")], strict=True):
                if held and held[0][0] != row[0]:
                    close(not first and not split)  # the first and the last of a range may go on in the next one
                    first = split = False
                elif held and (len(held) >= rows or size >= chars):
                    split = True
                    close(False)
                held.append(row)
                size += len(row[3])
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=_SEGMENT)
                ready.clear()
        if held:
            close(False)
            yield pa.RecordBatch.from_pylist(ready, schema=_SEGMENT)

    return run


def _faults(roles: list[str], texts: list[str], firsts: set[int] | None) -> list[str]:
    """Each row's first fault: blank, duplicate, truncated or none. firsts: rows that were not there before, unless all before are here."""
    out, seen = [], set()
    for i, said in enumerate(zip(roles, texts, strict=True)):
        end = said[1].rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        if not end:
            out.append("blank")
        elif i not in firsts if firsts is not None else said in seen:
            out.append("duplicate")
        else:
            out.append("" if end[-1] in ".!?" else "truncated")
        seen.add(said)
    return out


def _codes(roles: list[str], faults: list[str]) -> list[int]:
    """Rows as symbols, in blocks."""
    kind = {"s": 0, "u": 1, "a": 2}
    symbols = [0 if f in ("blank", "duplicate") else 1 + 2 * kind.get(role[:1], 3) + (f != "") for role, f in zip(roles, faults, strict=True)]
    symbols += [NOTHING] * (-len(symbols) % BLOCK)
    return [functools.reduce(lambda code, s: code * SYMBOLS + s, symbols[k : k + BLOCK], 0) for k in range(0, len(symbols), BLOCK)]


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments: their functions, in one row each."""
    for batch in batches:
        for row in batch.to_pylist():
            vector, states = tables().function(_codes(row["roles"], _faults(row["roles"], row["texts"], set(row["firsts"] or ()))))
            yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "segment": row["segment"], "vectors": vector.tolist(), "states": states.ravel().tolist()}], schema=_FUNCTION)


_FUNCTION = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("vectors", pa.list_(pa.int32())), ("states", pa.list_(pa.int32()))])
_FUNCTION_SQL = "conv_id long, segment long, vectors array<int>, states array<int>"
_PLACE = pa.schema([("part", pa.int64()), ("after", pa.int32()), ("state", pa.int32()), ("last", pa.bool_())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            yield from batch.slice(k, 64).to_pylist()


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted functions: the vector after each segment and the state before it."""
    for _, rows in groupby(_rows(batches), lambda r: r["conv_id"]):
        held = [(r["segment"], np.array(r["vectors"], np.int16), np.array(r["states"], np.int8)) for r in rows]
        after = [0]
        for _, vectors, _ in reversed(held[1:]):
            after.append(int(vectors[after[-1]]))
        state, out = START, []
        for (segment, _, states), vector in zip(held, reversed(after), strict=True):
            out.append({"part": segment, "after": vector, "state": state, "last": segment == held[-1][0]})
            state = int(states[4 * vector + state])
        yield pa.RecordBatch.from_pylist(out, schema=_PLACE)


_REPAIRED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("segment", pa.int64()),
        ("edits", pa.string()),
        *[(c, pa.list_(pa.string())) for c in ("faults", "roles", "texts")],
        *[(c, pa.int64()) for c in ("cost", "illegal", "low", "high", "distinct")],
        ("first", pa.string()),
        ("final", pa.string()),
    ]
)
_REPAIRED_SQL = "conv_id long, segment long, edits string, faults array<string>, roles array<string>, texts array<string>, cost long, illegal long, low long, high long, distinct long, first string, final string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments repaired: an edit, a fault, a role and a text for each row read or inserted (a deleted row keeps its own)."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            whole = row["whole"]
            faults = _faults(row["roles"], row["texts"], None if whole else set(row["firsts"] or ()))
            after, state, last = (0, START, True) if whole else (row["after"], row["state"], row["last"])
            edits, end = tables().trace(_codes(row["roles"], faults), after, state)
            new = {"faults": [], "roles": [], "texts": []}
            i, cost = 0, 0
            for e in edits:
                role, text, fault = (DUE[state], "", "") if e == "I" else (row["roles"][i], row["texts"][i], faults[i])
                if e == "R":
                    role = DUE[state]
                if e == "K":
                    state = KEEPS[role[0]][state]
                elif e != "D":
                    state = NEXT[state]
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[e] + TRUNCATED * (e in "KR" and fault != "")
                i += e != "I"
                for k, v in (("faults", fault), ("roles", role), ("texts", text)):
                    new[k].append(v)
            if last:
                more, roles = finish(end)
                edits, cost = edits + more, cost + INSERT * len(more)
                for k, v in (("faults", [""] * len(more)), ("roles", roles), ("texts", [""] * len(more))):
                    new[k] += v
            initials = [r[:1] for r in row["roles"]]
            turns = [t for t in row["turns"] if t is not None]
            illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
            out.append({"conv_id": row["conv_id"], "segment": row["segment"], "edits": edits, **new, "cost": cost, "illegal": illegal, "low": min(turns, default=None), "high": max(turns, default=None), "distinct": len(set(turns)), "first": initials[0], "final": initials[-1]})
        yield pa.RecordBatch.from_pylist(out, schema=_REPAIRED)


_REPORT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_REPORT_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, of whose sorted segments one is held at a time."""
    ready = []
    for conv, rows in groupby(_rows(batches), lambda r: r["conv_id"]):
        n, audit, sha, before, any_row = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "distinct"), 0), [], hashlib.sha256(), None, False
        low = high = None
        for r in rows:
            for e, fault, role, text in zip(r["edits"], r["faults"], r["roles"], r["texts"], strict=True):
                if fault:
                    n[fault] += 1
                if e != "D":
                    sha.update(("\n" * any_row + f"{role}:{text}").encode())
                    any_row = True
            audit.append(r["edits"])
            for k in ("illegal", "cost", "distinct"):
                n[k] += r[k]
            n["illegal"] += before is not None and before + r["first"] not in LEGAL
            n["distinct"] -= high is not None and r["low"] == high  # the segment goes on with the turn before
            before, low, high = r["final"], r["low"] if low is None else low, r["high"] if r["high"] is not None else high
        gaps = 0 if low is None else high - low + 1 - n.pop("distinct")
        n.pop("distinct", None)
        ready.append({"conv_id": conv, "gaps": gaps, **n, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()})
        if len(ready) >= 1000:
            yield pa.RecordBatch.from_pylist(ready, schema=_REPORT)
            ready = []
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=_REPORT)


def _segments(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired segments of conversations that have one, and of all others."""
    _store.small_batches(talks.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    ordered = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = _store.written(ordered.mapInArrow(_cut(SEGMENT_ROWS, SEGMENT_CHARS), _SEGMENT_SQL), "talk-segments")
    parts = cut.filter("NOT whole")
    key = F.zip_with("roles", "texts", lambda r, t: F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)))
    said = parts.select("conv_id", "segment", F.posexplode(key).alias("pos", "key"))
    first = said.groupBy("conv_id", "key").agg(F.min(F.struct("segment", "pos")).alias("f"))
    firsts = first.groupBy(F.col("f.segment").alias("part")).agg(F.collect_list("f.pos").alias("firsts"))
    parts = parts.join(firsts, F.col("segment") == F.col("part"), "left").drop("part")
    functions = parts.select("conv_id", "segment", "roles", "texts", "firsts").mapInArrow(_functions, _FUNCTION_SQL)
    places = functions.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_composed, "part long, after int, state int, last boolean")
    placed = parts.join(places, F.col("segment") == F.col("part")).drop("part")
    return cut.filter("whole").mapInArrow(_repaired, _REPAIRED_SQL), placed.mapInArrow(_repaired, _REPAIRED_SQL)


def repair(talks: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R, I), role, text: the turns of each repaired conversation; place orders them."""
    whole, parts = _segments(talks)
    turns = F.posexplode(F.arrays_zip(F.split("edits", "").alias("edit"), F.col("roles").alias("role"), F.col("texts").alias("text"))).alias("pos", "turn")
    rows = whole.unionByName(parts).select("conv_id", "segment", turns).filter("turn.edit != 'D'")
    return rows.select("conv_id", F.struct("segment", "pos").alias("place"), "turn.edit", "turn.role", "turn.text")


def digest(talks: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation with rows."""
    whole, parts = _segments(talks)
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return whole.mapInArrow(_report, _REPORT_SQL).unionByName(ordered.mapInArrow(_report, _REPORT_SQL))


def with_all(found: DataFrame, talks: DataFrame) -> DataFrame:
    """digest()'s rows, and one of zeros for each conv_id of talks without any."""
    ids = talks.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
