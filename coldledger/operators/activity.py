"""Host activity: idle streaks and I/O rates.

``heartbeats`` has host, ts, seq, idle (1 or 0); ``counters`` has host, ts, seq and running byte counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.constants import DISK_WRITE_LIMIT, IDLE_RUNS, NET_RECV_LIMIT, NET_SENT_LIMIT, SAMPLE_SECONDS
from coldledger.skew import ordered_previous

COUNTERS = ("write_bytes", "sent_bytes", "recv_bytes")


def idle_summary(heartbeats: DataFrame) -> DataFrame:
    """Per host: heartbeats seen, and how many idle ones followed the last busy one.

    The last busy one is a partial aggregate, one small row per host that joins back; a host with a third
    of all heartbeats is split by the adaptive skew join, or not moved at all where the hosts fit a broadcast.
    """
    at = F.struct("ts", "seq")
    last = heartbeats.groupBy(F.col("host").alias("_host")).agg(F.max(F.when(F.col("idle") == 0, at)).alias("_busy_at"))
    idle_since = F.col("_busy_at").isNull() | (F.col("_at") > F.col("_busy_at"))
    return (heartbeats.select("host", at.alias("_at")).join(last, F.col("host").eqNullSafe(F.col("_host")))
            .groupBy("host").agg(
                F.count(F.lit(1)).alias("runs"), F.bool_or(F.col("_busy_at").isNotNull()).alias("was_busy"),
                F.count_if(idle_since).alias("streak")))


def idle_streak(heartbeats: DataFrame, n: int = IDLE_RUNS) -> DataFrame:
    """Hosts with their current idle streak and whether it reached ``n`` heartbeats."""
    return idle_summary(heartbeats).select(
        "host", "runs", "streak", (F.col("streak") >= n).alias("is_idle"))


def io_rates(counters: DataFrame, partitions: int | None = None) -> DataFrame:
    """Bytes per second between consecutive samples of a host, and whether any limit is passed."""
    paired = ordered_previous(counters, "host", ["ts", "seq"], ["ts", *COUNTERS], partitions=partitions)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros("ts") - micros("prev_ts")) / F.lit(1e6)
    rates = {c.replace("bytes", "rate"): F.try_divide((F.col(c) - F.col(f"prev_{c}")).cast("double"), seconds)
             for c in COUNTERS}
    busy = (F.col("write_rate") > DISK_WRITE_LIMIT) | (F.col("sent_rate") > NET_SENT_LIMIT) \
        | (F.col("recv_rate") > NET_RECV_LIMIT)
    return (paired.where(F.col("prev_ts").isNotNull())
            .select("host", "ts", "seq", *[F.round(v, 3).alias(k) for k, v in rates.items()])
            .withColumn("is_busy", F.coalesce(busy, F.lit(False))))


def window_sums(samples: DataFrame, seconds: int = SAMPLE_SECONDS) -> DataFrame:
    """Bytes per host and tumbling window. Works on batches and streams.

    ``samples`` has host, ts and byte deltas write_bytes, sent_bytes, recv_bytes.
    """
    return samples.groupBy("host", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        *[F.sum(c).alias(c) for c in COUNTERS]).select("host", F.col("w.start").alias("window_start"), *COUNTERS)


def with_busy(sums: DataFrame, seconds: int = SAMPLE_SECONDS) -> DataFrame:
    """Whether a window passes any limit."""
    busy = (F.col("write_bytes") > DISK_WRITE_LIMIT * seconds) | (F.col("sent_bytes") > NET_SENT_LIMIT * seconds) \
        | (F.col("recv_bytes") > NET_RECV_LIMIT * seconds)
    return sums.withColumn("is_busy", busy)


def activity_windows(samples: DataFrame, seconds: int = SAMPLE_SECONDS) -> DataFrame:
    """Bytes per host and window against the limits."""
    return with_busy(window_sums(samples, seconds), seconds)
