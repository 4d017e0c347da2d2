"""Incremental jobs. Each one keeps its result in a table and equals its batch twin.

Every run takes what is available and stops, so jobs can be scheduled. Tables are written per micro-batch; a batch
that is run again after a failure overwrites its own directory, so results count once. After each run the finished
batches are merged (``tables.compact``), so a table grows with its keys and not with its batches. Nothing is
collected on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from coldledger.constants import IDLE_RUNS, SAMPLE_SECONDS
from coldledger.operators.activity import COUNTERS, window_sums, with_busy
from coldledger.operators.catalogue import keep_latest
from coldledger.operators.inventory import folder_rollup
from coldledger.streaming.tables import Merge, batch_path, compact, read_table


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> None:
    query = (stream.writeStream.foreachBatch(write).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def write_batches(table: str, reduce: Callable[[DataFrame], DataFrame] = lambda rows: rows,
                  ) -> Callable[[DataFrame, int], None]:
    """Writer that keeps each micro-batch, reduced first, in a directory of its own."""
    def write(rows: DataFrame, batch: int) -> None:
        reduce(rows).write.mode("overwrite").parquet(batch_path(table, batch))
    return write


def latest_changes(changes: DataFrame, *keys: str) -> DataFrame:
    """Newest version of each key over all batches."""
    return keep_latest(changes, list(keys), "batch").drop("batch")


def _merged(stream: DataFrame, table: str, schema: StructType, merge: Merge) -> DataFrame:
    """The table after compaction, as ``merge`` gives it."""
    compact(stream.sparkSession, table, schema, merge)
    return merge(read_table(stream.sparkSession, table, schema))


def _streaks(heartbeats: DataFrame) -> DataFrame:
    """(host, runs, streak) of every host with new heartbeats, kept in Spark's state store."""
    def add(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, streak = state.get if state.exists else (0, 0)
        busy, idle = None, []  # the last busy heartbeat of this batch, and the idle ones after it
        for chunk in chunks:
            runs += len(chunk)
            chunk = chunk.sort_values(["ts", "seq"])
            at = list(zip(chunk["ts"], chunk["seq"], strict=True))
            is_busy = np.flatnonzero(chunk["idle"].to_numpy() == 0)
            if len(is_busy):
                busy = at[is_busy[-1]] if busy is None else max(busy, at[is_busy[-1]])
            idle = [t for t in idle + at if busy is None or t > busy]
        streak = len(idle) if busy is not None else streak + len(idle)
        state.update((runs, streak))
        yield pd.DataFrame({"host": [key[0]], "runs": [runs], "streak": [streak]})

    return heartbeats.select("host", "ts", "seq", "idle").groupBy("host").applyInPandasWithState(
        add, "host bigint, runs bigint, streak bigint", "runs bigint, streak bigint", "update", GroupStateTimeout.NoTimeout)


def stream_idle_streak(heartbeats: DataFrame, table: str, checkpoint: str, n: int = IDLE_RUNS) -> DataFrame:
    """Idle streak per host over batches in arrival order.

    A host's count is in Spark's state store; a batch costs what its hosts send, and a batch with a busy heartbeat
    restarts the streak. The table holds the newest counts of each host.
    """
    counts = _streaks(heartbeats)
    run_available(counts, write_batches(table), checkpoint, "update")
    return _merged(counts, table, counts.schema, lambda rows: latest_changes(rows, "host")).select(
        "host", "runs", "streak", (F.col("streak") >= n).alias("is_idle"))


def stream_activity(samples: DataFrame, table: str, checkpoint: str, seconds: int = SAMPLE_SECONDS,
                    delay: str | None = None) -> DataFrame:
    """Bytes per host and window against the limits.

    By default every batch adds its part of each window, so no row comes too late and no state
    is held. With a ``delay`` windows are kept in state and closed by the watermark; rows later
    than that are not counted, and the table holds the newest total of each window.
    """
    schema = window_sums(samples, seconds).schema
    if delay is not None:
        totals = window_sums(samples.withWatermark("ts", delay), seconds)
        run_available(totals, write_batches(table), checkpoint, "update")
        return with_busy(_merged(samples, table, schema, lambda rows: latest_changes(rows, "host", "window_start")), seconds)
    run_available(samples, write_batches(table, lambda rows: window_sums(rows, seconds)), checkpoint)
    return with_busy(_merged(samples, table, schema, lambda rows: rows.groupBy("host", "window_start").agg(
        *[F.sum(c).alias(c) for c in COUNTERS])), seconds)


def restore_events_state(events: DataFrame) -> DataFrame:
    """Latest state per object, and per folder whether anything is still pending.

    ``events`` has folder, name, ts, seq, state.
    """
    latest = keep_latest(events, ["folder", "name"], "ts", "seq")
    open_states = F.col("state").isin("triggered", "restoring")
    return latest.groupBy("folder").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(open_states).alias("open"),
        F.bool_or(open_states).alias("pending"))


def stream_restore_state(events: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Restore progress from status rows that may come late or twice.

    The newest row by event time decides, so neither needs a watermark: a late row loses
    against a newer one and a copy changes nothing.
    """
    newest = lambda rows: keep_latest(rows, ["folder", "name"], "ts", "seq")
    run_available(events, write_batches(table, newest), checkpoint)
    return restore_events_state(_merged(events, table, events.schema, newest))


def stream_folder_rollup(files: DataFrame, table: str, checkpoint: str) -> DataFrame:
    """Folder count and bytes as crawl files arrive: each batch adds its part of every folder."""
    run_available(files, write_batches(table, folder_rollup), checkpoint)
    return _merged(files, table, folder_rollup(files).schema, lambda rows: rows.groupBy("folder").agg(
        F.sum("fcount").alias("fcount"), F.sum("dirsum").alias("dirsum")))
