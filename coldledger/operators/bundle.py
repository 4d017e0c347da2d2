"""Small files: classify them, plan their bundling, pack and unpack them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldledger.constants import KIB, META, MIB, OBJECT_OVERHEAD_BYTES, SMALL_FILE_KIB
from coldledger.operators.inventory import non_meta

BUNDLE_BYTES = 64 * MIB


def is_small(size: Column, kib: int | None = None, tar: bool = True) -> Column:
    """Below the limit (not equal to it). None means the default; 0 or ``tar=False`` bundle nothing."""
    limit = (SMALL_FILE_KIB if kib is None else kib) * KIB
    return (size < F.lit(limit)) & F.lit(tar)


def classify_small(files: DataFrame, kib: int | None = None, tar: bool = True) -> DataFrame:
    return files.withColumn("tarred", F.when(is_small(F.col("size"), kib, tar), F.lit("Yes")).otherwise(F.lit("No")))


def small_file_plan(files: DataFrame, kib: int | None = None, tar: bool = True) -> DataFrame:
    """Per folder: what bundling would pack, the objects before and after, the overhead saved."""
    small = is_small(F.col("size"), kib, tar)
    planned = non_meta(files, (META.manifest,)).groupBy("folder").agg(
        F.count_if(small).alias("bundled"),
        F.coalesce(F.sum(F.when(small, F.col("size"))), F.lit(0)).alias("bundled_bytes"),
        F.count(F.lit(1)).alias("objects_before"))
    after = F.col("objects_before") - F.col("bundled") + F.when(F.col("bundled") > 0, 1).otherwise(0)
    return planned.select("*", after.alias("objects_after"),
                          ((F.col("objects_before") - after) * OBJECT_OVERHEAD_BYTES).alias("overhead_saved"))


def even_part(name: Column, parts: Column) -> Column:
    """Stable part number of a name, even over ``parts`` parts."""
    number = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")
    return F.pmod(number, parts)


def bundle_small(files: DataFrame, kib: int | None = None, target_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Pack each folder's small files (folder, name, size, content) into containers.

    A folder gets as many containers as its bytes need, and names are spread evenly over
    them, so no container grows with the folder.
    """
    small = files.where(is_small(F.col("size"), kib)).select("folder", "name", "size", "content")
    parts = small.groupBy("folder").agg(
        F.greatest(F.ceil(F.sum("size") / F.lit(target_bytes)), F.lit(1)).cast("long").alias("_parts"))
    placed = (small.join(parts, "folder")
              .withColumn("bundle", even_part(F.col("name"), F.col("_parts"))))
    return (placed.groupBy("folder", "bundle")
            .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
                 F.array_sort(F.collect_list(F.struct("name", "size", "content"))).alias("entries")))


def unbundle(bundles: DataFrame) -> DataFrame:
    """The packed files again, of all folders."""
    return bundles.select("folder", F.inline("entries"))
