"""Ordered sums and neighbours that hold when one key owns a large share of all rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from coldledger.session import work_dir


def _bucket(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts))


def bucketed_previous(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str],
                      unit: str = "day", prefix: str = "prev_") -> DataFrame:
    """Previous row's ``values`` per ``key`` in ``order``; null on the first row.

    A plain ``lag`` puts a whole key in one task. Here a key is cut in time buckets: the
    lag runs inside each bucket, and only one summary row per bucket meets its neighbours.
    ``order[0]`` must be the time column; ``unit`` is any ``date_trunc`` unit.
    """
    rows = df.withColumn("_bucket", _bucket(order[0], unit))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    packed = F.struct(*values)
    last = rows.groupBy(key, "_bucket").agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    over_buckets = Window.partitionBy(key).orderBy("_bucket")
    carried = last.select(key, "_bucket", F.lag("_last").over(over_buckets).alias("_carried"))
    joined = (
        rows.withColumn("_in", F.lag(packed).over(inside))
        .join(carried, [key, "_bucket"], "left")
        .withColumn("_prev", F.coalesce("_in", "_carried"))
    )
    return joined.select(*df.columns, *[F.col(f"_prev.{v}").alias(prefix + v) for v in values])


def bucketed_running_sum(df: DataFrame, key: str, order: Sequence[str],
                         sums: dict[str, str], unit: str = "day") -> DataFrame:
    """Running sums per ``key`` in ``order``: ``sums`` maps a value column to its output name.

    Like ``bucketed_previous``: sums run inside time buckets, then bucket totals are carried.
    """
    rows = df.withColumn("_bucket", _bucket(order[0], unit))
    inside = (Window.partitionBy(key, "_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = rows.groupBy(key, "_bucket").agg(*[F.sum(v).alias(f"_t_{v}") for v in sums])
    before = (Window.partitionBy(key).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(
        key, "_bucket", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_c_{v}") for v in sums])
    running = rows
    for v in sums:
        running = running.withColumn(f"_r_{v}", F.sum(v).over(inside))
    return (
        running.join(carried, [key, "_bucket"], "left")
        .select(*df.columns, *[(F.col(f"_r_{v}") + F.col(f"_c_{v}")).alias(name) for v, name in sums.items()])
    )


def _in_order(df: DataFrame, key: str, order: Sequence[str], partitions: int | None) -> DataFrame:
    """Rows of all keys in one order, cut into partitions of like size wherever a cut falls."""
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(count, key, *order).sortWithinPartitions(key, *order)


def _kept(df: DataFrame) -> DataFrame:
    """The rows from a table, so that every reader sees the same cuts."""
    path = work_dir(df.sparkSession, "ordered")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_previous(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str], prefix: str = "prev_",
                     partitions: int | None = None) -> DataFrame:
    """Previous row's ``values`` per ``key`` in ``order``; null on the first row.

    The rows are range-partitioned by key and order and streamed, each partition carrying its last row along; only
    one row per partition is handed on to the next. A key, or one of its days, may thus fill any number of tasks.
    """
    last_row = F.struct(*[F.col(f"`{c}`") for c in (key, *values)])
    kinds = {f.name: f for f in df.schema.fields}
    schema = StructType([*df.schema.fields, *[StructField(prefix + v, kinds[v].dataType) for v in values],
                         StructField("_part", IntegerType()), StructField("_row", LongType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            before = pa.concat_tables([rows.slice(0, 1) if last is None else last, rows.slice(0, rows.num_rows - 1)])
            now, then = rows[key].combine_chunks(), before[key].combine_chunks()
            same = pc.or_(pc.fill_null(pc.equal(now, then), False), pc.and_(pc.is_null(now), pc.is_null(then))).to_numpy(False).copy()
            same[0] &= last is not None
            for v in values:
                old = before[v].combine_chunks()
                rows = rows.append_column(prefix + v, pc.if_else(pa.array(same), old, pa.scalar(None, old.type)))
            last = rows.slice(batch.num_rows - 1).select(batch.schema.names)
            rows = rows.append_column("_part", pa.array(np.full(batch.num_rows, part, np.int32)))
            yield from rows.append_column("_row", pa.array(np.arange(done, done + batch.num_rows))).combine_chunks().to_batches()
            done += batch.num_rows

    rows = _kept(_in_order(df, key, order, partitions).mapInArrow(stream, schema))
    last = rows.groupBy("_part").agg(F.max_by(last_row, "_row").alias("_last"))
    # One row per partition.
    handed = last.select(F.lead("_part").over(Window.orderBy("_part")).alias("_to"), "_last")
    joined = rows.join(F.broadcast(handed), (F.col("_row") == 0) & (F.col("_part") == F.col("_to"))
                       & F.col(f"`{key}`").eqNullSafe(F.col(f"_last.`{key}`")), "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(f"_last.`{v}`"), F.col(prefix + v)).alias(prefix + v) for v in values])


def ordered_running_sum(df: DataFrame, key: str, order: Sequence[str], sums: dict[str, str],
                        partitions: int | None = None) -> DataFrame:
    """Running sums of whole numbers per ``key`` in ``order``: ``sums`` maps a value column to its output name.

    As ``ordered_previous``: what a partition hands on is the sum of the key that it ends with.
    """
    schema = StructType([*df.schema.fields, *[StructField(name, LongType()) for name in sums.values()],
                         StructField("_part", IntegerType()), StructField("_row", LongType()), StructField("_head", BooleanType())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, done, head, carry = TaskContext.get().partitionId(), None, 0, True, dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            keys = rows[key].combine_chunks()
            before = pa.concat_arrays([keys.slice(0, 1) if last is None else last, keys.slice(0, len(keys) - 1)])
            same = pc.or_(pc.fill_null(pc.equal(keys, before), False), pc.and_(pc.is_null(keys), pc.is_null(before))).to_numpy(False)
            starts = np.flatnonzero(~same)  # rows where another key begins
            run = np.cumsum(~same)
            for v, name in sums.items():
                numbers = pc.fill_null(rows[v], 0).to_numpy().astype(np.int64)
                total = np.cumsum(numbers)
                base = np.concatenate(([-carry[v]], total[starts] - numbers[starts]))
                running = total - base[run]
                carry[v] = int(running[-1])
                rows = rows.append_column(name, pa.array(running))
            in_head = (run == 0) & head
            head = head and not len(starts)
            last = keys.slice(len(keys) - 1)
            rows = rows.append_column("_part", pa.array(np.full(batch.num_rows, part, np.int32)))
            rows = rows.append_column("_row", pa.array(np.arange(done, done + batch.num_rows)))
            yield from rows.append_column("_head", pa.array(in_head)).combine_chunks().to_batches()
            done += batch.num_rows

    rows = _kept(_in_order(df, key, order, partitions).mapInArrow(stream, schema))
    names = list(sums.values())
    column = F.col(f"`{key}`").alias("_key")
    # Two rows per partition: the key it begins with, and the key it ends with and that key's sums.
    begins = rows.where("_head").select("_part", column).distinct().select("_part", "_key", F.lit(0).alias("_side"), *[F.lit(0).cast("long").alias(n) for n in names])
    ends = (rows.groupBy("_part").agg(F.max_by(F.struct(column, *names), "_row").alias("_end"))
            .select("_part", "_end._key", F.lit(1).alias("_side"), *[f"_end.{n}" for n in names]))
    earlier = Window.partitionBy("_key").orderBy("_part", "_side").rowsBetween(Window.unboundedPreceding, -1)
    handed = (begins.unionByName(ends).select("_part", "_side", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_c_{n}") for n in names])
              .where("_side = 0").drop("_side").withColumnRenamed("_part", "_to"))
    joined = rows.join(F.broadcast(handed), F.col("_head") & (F.col("_part") == F.col("_to")), "left")
    return joined.select(*df.columns, *[(F.col(n) + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in names])
