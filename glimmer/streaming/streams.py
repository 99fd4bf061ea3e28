"""The library's moving parts as Structured Streaming: arrivals, sessions, throttles, retries and standing views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glimmer.functions.scalars import RETRY_MINUTES
from glimmer.operators.sync import reconcile


def arriving_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """New files below a folder. Removals don't come as events; `scan_difference` finds them in a batch job."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder).drop("content")


def upload_batches(stream: DataFrame, key: str, time: str = "ts", idle: str = "6 seconds", late: str = "30 seconds") -> DataFrame:
    """A batch of each key's events closes when nothing has come for `idle`: its start, end, count and total size."""
    rows = stream.withWatermark(time, late).groupBy(key, F.session_window(time, idle).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n", "bytes")


def fresh_files(stream: DataFrame, catalog: DataFrame) -> DataFrame:
    """Arrivals that the catalog doesn't have with the same size and time, nor with the same content."""
    known = catalog.select("path", "size", "modified")
    return stream.join(known, ["path", "size", "modified"], "left_anti").join(catalog.select("checksum").filter("checksum IS NOT NULL"), "checksum", "left_anti")


def published(stream: DataFrame, bucket: float = 0.01, pause_ms: int = 500) -> DataFrame:
    """Of updates (id, ts_ms, status, progress) those worth telling: the first, a new status, another hundredth, or after a pause."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = []
        for pdf in frames:
            for ts, status, progress in pdf.sort_values("ts_ms")[["ts_ms", "status", "progress"]].itertuples(index=False):
                step = int(progress / bucket)
                if last is None or last[1] != status or last[2] != step or ts - last[0] >= pause_ms:
                    last = (int(ts), str(status), step)
                    rows.append((key[0], int(ts), str(status), float(progress)))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(rows, columns=["id", "ts_ms", "status", "progress"])

    return stream.groupBy("id").applyInPandasWithState(run, "id string, ts_ms long, status string, progress double", "ts_ms long, status string, step int", "append", GroupStateTimeout.NoTimeout)


def retries(stream: DataFrame) -> DataFrame:
    """The ledger of attempts (id, ts_ms, ok): fail_count since the last success and next_retry_at, 0 once it succeeds."""
    ladder = [m * 60_000 for m in RETRY_MINUTES]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, rows = (state.get[0] if state.exists else 0), []
        for pdf in frames:
            for ts, ok in pdf.sort_values("ts_ms")[["ts_ms", "ok"]].itertuples(index=False):
                count = 0 if ok else count + 1
                rows.append((key[0], count, int(ts) + ladder[min(count, len(ladder)) - 1] if count else 0))
        state.update((count,))
        yield pd.DataFrame(rows, columns=["id", "fail_count", "next_retry_at"])

    return stream.groupBy("id").applyInPandasWithState(run, "id string, fail_count int, next_retry_at long", "fail_count int", "append", GroupStateTimeout.NoTimeout)


def stale_tasks(stream: DataFrame, after_ms: int = 300_000) -> DataFrame:
    """Tasks (id, ts) without an update for `after_ms` of event time, once each. The stream needs a watermark on ts."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "status": ["done"]})
            return
        latest = max(int(pdf["ts"].max().timestamp() * 1000) for pdf in frames)
        state.update((max(latest, state.get[0] if state.exists else 0),))
        state.setTimeoutTimestamp(max(state.get[0] + after_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [], "status": []})

    return stream.groupBy("id").applyInPandasWithState(run, "id string, status string", "ts_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def standing_view(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], load: Callable[[], DataFrame], save: Callable[[DataFrame, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Evaluates a view again on each batch of arrivals, and hands over the new state and what changed.

    save(state, changes, batch) has to be repeatable, as a batch may come again after a failure.
    """

    def each(batch: DataFrame, number: int) -> None:
        changes = reconcile(load(), evaluate(batch))
        save(changes.filter("action <> 'delete'").drop("action"), changes.filter("action <> 'keep'"), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
