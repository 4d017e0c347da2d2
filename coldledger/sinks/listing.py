"""An object listing kept by place, so that verification plans neither re-key nor shuffle it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.operators.verify import archived_digests
from coldledger.session import shuffles_freed, work_dir

KEYS = ("place", "name")
MORE = ("bucket", "key", "size", "storage_class", "restore")


def store_listing(objects: DataFrame, table: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write a listing (bucket, key, size, storage_class, restore, md5) once and return the stored table.

    The place that a key lies at and the file's name become columns, and the table is bucketed by both: a join or
    aggregation on them reads buckets side by side, and a place with a third of all objects fills many buckets.
    A row per object; listings that repeat one are reduced, and a digest that differs between them is lost.
    ``buckets`` should not be fewer than the partitions of the shuffles that meet the table.
    """
    spark = objects.sparkSession
    count = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = archived_digests(objects, MORE)
    if count != int(spark.conf.get("spark.sql.shuffle.partitions")):  # else the rows lie by bucket already
        rows = rows.repartition(count, *KEYS)
    with shuffles_freed(spark):  # the table stands for them, and plans that read it need the disk
        (rows.write.format("parquet").bucketBy(count, *KEYS).sortBy(*KEYS).option("compression", "zstd")
         .option("path", path or work_dir(spark, "listing")).mode("overwrite").saveAsTable(table))
    return spark.table(table)


def place_summary(listing: DataFrame) -> DataFrame:
    """Objects and bytes at each place."""
    return listing.groupBy("place").agg(
        F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
