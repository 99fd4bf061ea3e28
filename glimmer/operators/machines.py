"""Small state machines of one key's events, and their walk over a table: what is in flight, and how often work may run.

A machine's step takes its state and an event and gives the new state and what comes out. Streams keep the state in Spark's
state store, with timers (`glimmer.streaming.machines`); `walked` gives the same rows from a table, whose rows of a key one task
reads in order, holding nothing but the state. Times are microseconds. An event that comes with an older time than the one
before counts as at that one's time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.shipping import ship

NEVER = -(2**62)


class Event(NamedTuple):
    """kind: begin or end (of work), which `Gate` does not tell apart; named: the work belongs to a batch with a name."""

    at: int
    id: int
    kind: str = "begin"
    named: bool = False


class Out(NamedTuple):
    """The event that is served, when, and how many requests it stands for."""

    id: int
    at: int
    merged: int = 1


class Hold:
    """A key that work has begun on takes no other request until that work ends, nor for `echo` after it if the work is of a
    named batch, as its file then still causes events. A request that is not taken is an echo. An end without a beginning is
    nothing. State: whether work is in flight, until when the key is held, and the last time."""

    START = (False, NEVER, NEVER)
    FIELDS = "busy boolean, until long, last long"

    def __init__(self, echo: int) -> None:
        self.echo = echo

    def step(self, state: tuple, e: Event) -> tuple[tuple, list[Out]]:
        busy, until, last = state
        at = max(e.at, last)
        if e.kind == "end":
            return (False, (at + self.echo if e.named else at) if busy else until, at), []
        taken = not busy and at >= until
        return (busy or taken, until, at), [Out(e.id, at)] if taken else []

    def timer(self, state: tuple) -> int | None:
        """When the state can be forgotten."""
        busy, until, last = state
        return None if busy else max(until, last)

    def expire(self, state: tuple, now: int) -> tuple[tuple | None, list[Out]]:
        due = self.timer(state)
        return (None, []) if due is not None and now >= due else (state, [])

    def end(self, state: tuple) -> list[Out]:
        """What comes out after the last event of a table."""
        return []


class Gate:
    """Work that runs at most once in `every`: a request after a quiet time runs at once; others wait for the end of the time
    since the last run, when the latest of them runs for all. State: the last run, the request that waits (0 for none), how many
    it stands for, and the last time."""

    START = (NEVER, 0, 0, NEVER)
    FIELDS = "ran long, waits long, merged long, last long"

    def __init__(self, every: int) -> None:
        self.every = every

    def step(self, state: tuple, e: Event) -> tuple[tuple, list[Out]]:
        at = max(e.at, state[3])
        state, out = self.expire(state, at)
        ran, _, merged, _ = state or self.START
        if ran == NEVER or at >= ran + self.every:
            return (at, 0, 0, at), [*out, Out(e.id, at)]
        return (ran, e.id, merged + 1, at), out

    def timer(self, state: tuple) -> int | None:
        """When the waiting request runs, or the state can be forgotten."""
        return state[0] + self.every

    def expire(self, state: tuple, now: int) -> tuple[tuple | None, list[Out]]:
        ran, waits, merged, last = state
        due = ran + self.every
        if ran == NEVER or now < due:
            return state, []
        if not merged:
            return None, []
        return (due, 0, 0, max(last, due)), [Out(waits, due, merged)]

    def end(self, state: tuple) -> list[Out]:
        return self.expire(state, 2**62)[1]


class Rerun:
    """Work that runs one at a time: a request during a run lets one more follow at its end, however many there were. State:
    whether a run is on, whether one more is asked for, the request that it stands for, and how many they are."""

    START = (False, False, 0, 0)
    FIELDS = "running boolean, pending boolean, waits long, merged long"

    def step(self, state: tuple, e: Event) -> tuple[tuple, list[Out]]:
        running, pending, waits, merged = state
        if e.kind == "begin":
            return ((True, True, e.id, merged + 1), []) if running else ((True, False, 0, 0), [Out(e.id, e.at)])
        return ((True, False, 0, 0), [Out(waits, e.at, merged)]) if running and pending else ((False, False, 0, 0), [])

    def timer(self, state: tuple) -> int | None:
        return None

    def expire(self, state: tuple, now: int) -> tuple[tuple | None, list[Out]]:
        return state, []

    def end(self, state: tuple) -> list[Out]:
        return []


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def walked(rows: DataFrame, key: str, machine: Hold | Gate | Rerun) -> DataFrame:
    """key, id, at, merged: what comes out of each key's machine for rows (key, at, id, kind, named), in order of time and id."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    ordered = rows.select(key, "at", "id", "kind", "named").repartition(key).sortWithinPartitions(key, "at", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, own, begun, given = machine.START, None, False, None

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], given), *[pa.array(c, pa.int64()) for c in columns[1:]]], [key, "id", "at", "merged"])

        for batch in batches:
            given, out = batch.schema.field(0).type, []
            for k, *event in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if not begun or k != own:
                    if begun:
                        out += [(own, *o) for o in machine.end(state)]
                    state, own, begun = machine.START, k, True
                state, served = machine.step(state, Event(*event))
                out += [(k, *o) for o in served]
            yield table(out)
        if begun:
            yield table([(own, *o) for o in machine.end(state)])

    return ordered.mapInArrow(run, f"`{key}` {kind}, id long, at long, merged long")


def served(rows: DataFrame, key: str, time: Column, id_column: str, begins: Column, named: Column, echo_seconds: float) -> DataFrame:
    """key, id, at: the requests that are served, of rows that begin work or end it (`Hold`)."""
    events = rows.select(key, micros(time).alias("at"), F.col(id_column).cast("long").alias("id"), F.when(begins, "begin").otherwise("end").alias("kind"), F.coalesce(named, F.lit(False)).alias("named"))
    return walked(events.filter("at IS NOT NULL"), key, Hold(round(echo_seconds * 1e6))).drop("merged")


def rerun(rows: DataFrame, key: str, time: Column, id_column: str, begins: Column) -> DataFrame:
    """key, id, at, merged: the runs that requests start, at once or at the end of the run before (`Rerun`)."""
    events = rows.select(key, micros(time).alias("at"), F.col(id_column).cast("long").alias("id"), F.when(begins, "begin").otherwise("end").alias("kind"), F.lit(False).alias("named"))
    return walked(events.filter("at IS NOT NULL"), key, Rerun())


def throttled(rows: DataFrame, key: str, time: Column, id_column: str, every_seconds: float) -> DataFrame:
    """key, id, at, merged: the runs of each chain of requests (`Gate`)."""
    events = rows.select(key, micros(time).alias("at"), F.col(id_column).cast("long").alias("id"), F.lit("begin").alias("kind"), F.lit(False).alias("named"))
    return walked(events.filter("at IS NOT NULL"), key, Gate(round(every_seconds * 1e6)))
