"""Change tables of streams: one directory per micro-batch, and compaction of finished ones.

A table below ``root`` is its newest ``upto=<k>`` directory, which holds what batches 0 to k come to, and all
``batch=<id>`` directories with id > k. Compaction writes the merged rows aside and gives them their name in one
step: before that step readers see the batches, after it the merged rows, and never both. What a job that died left
behind is never read: rows aside keep a hidden name, and batches that are merged already go with the next compaction.
A reader that has started before a compaction must be run again if its files are gone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from coldledger.sinks.storage import is_complete, names_below, remove, rename_new

Merge = Callable[[DataFrame], DataFrame]


def batch_path(root: str, batch: int) -> str:
    return f"{root.rstrip('/')}/batch={batch:012d}"


def _number(name: str) -> int:
    return int(name.split("=")[1])


def _parts(spark: SparkSession, root: str) -> tuple[int, list[int]]:
    """The newest merged batch (-1: none) and the finished batches after it."""
    merged = max(map(_number, names_below(spark, root, "upto=")), default=-1)
    later = [n for n in map(_number, names_below(spark, root, "batch=")) if n > merged and is_complete(spark, batch_path(root, n))]
    return merged, later


def read_table(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All rows with their ``batch``; merged rows have the number of the last batch merged."""
    merged, later = _parts(spark, root)
    read = lambda path, n: spark.read.schema(schema).parquet(path).withColumn("batch", F.lit(n).cast("long"))
    parts = [read(f"{root.rstrip('/')}/upto={merged:012d}", merged)] if merged >= 0 else []
    if later:
        # One scan for all batches: the number is part of the path.
        paths = [batch_path(root, n) for n in later]
        number = F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("long")
        parts.append(spark.read.schema(schema).parquet(*paths).select("*", number.alias("batch")))
    if not parts:
        return spark.createDataFrame([], StructType([*schema.fields, StructField("batch", LongType())]))
    return reduce(DataFrame.unionByName, parts)


def compact(spark: SparkSession, root: str, schema: StructType, merge: Merge, keep: int = 1) -> int:
    """Merge all finished batches but the newest ``keep``; returns the last batch merged, -1 if none is.

    ``merge`` gets rows with ``batch`` and returns rows of ``schema`` that stand for them. The newest batch is kept,
    as a stream that starts again may write it anew.
    """
    merged, later = _parts(spark, root)
    done = later[:len(later) - keep] if keep else later
    if done:
        rows = merge(read_table(spark, root, schema).where(F.col("batch") <= done[-1])).select(*schema.fieldNames())
        aside = f"{root.rstrip('/')}/.staged-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        if not rename_new(spark, aside, f"{root.rstrip('/')}/upto={done[-1]:012d}"):
            remove(spark, aside)  # another compaction was first
        merged = max(merged, done[-1])
    clean(spark, root)
    return merged


def clean(spark: SparkSession, root: str) -> None:
    """Remove what the newest merged directory stands for."""
    merged, _ = _parts(spark, root)
    for kind, last in (("upto=", merged - 1), ("batch=", merged)):
        for name in names_below(spark, root, kind):
            if _number(name) <= last:
                remove(spark, f"{root.rstrip('/')}/{name}")
