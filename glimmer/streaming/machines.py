"""State machines on streams: Spark keeps each key's state and wakes it by timers in event time.

The stream has the columns key, ts, id, kind and named, with a watermark on ts; events of a key that come in one trigger are
taken in order of time. The state store has to be RocksDB's (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glimmer.operators.machines import Event, Gate, Hold, micros
from glimmer.shipping import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, id long, at long, merged long"


class Machine(StatefulProcessor):
    """One key's machine: its state, and a timer for when it would do something by itself."""

    def __init__(self, machine: Hold | Gate) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.machine.FIELDS)

    def _keep(self, key: Any, state: tuple | None, out: list) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is None:
            self.state.clear()
        else:
            self.state.update(tuple(state))
            due = self.machine.timer(state)
            if due is not None:
                self.handle.registerTimer(max(0, -(-due // 1000)))  # in milliseconds
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["key", "id", "at", "merged"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, out = self.state.get() if self.state.exists() else self.machine.START, []
        events = pd.concat(list(rows)).sort_values(["at", "id"])[["at", "id", "kind", "named"]]
        for event in events.itertuples(index=False):
            state, served = self.machine.step(tuple(state), Event(int(event[0]), int(event[1]), event[2], bool(event[3])))
            out += served
        yield from self._keep(key, state, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        state, out = self.machine.expire(tuple(self.state.get()), expiredTimerInfo.getExpiryTimeInMs() * 1000)
        yield from self._keep(key, state, out)

    def close(self) -> None:
        pass


def running(stream: DataFrame, machine: Hold | Gate) -> DataFrame:
    """key, id, at, merged: what the keys' machines let through."""
    ship(stream.sparkSession)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.withColumn("at", micros(F.col("ts")))
    return rows.groupBy("key").transformWithStateInPandas(Machine(machine), OUT, "Append", "EventTime")
