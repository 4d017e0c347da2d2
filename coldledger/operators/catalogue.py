"""The archive catalogue: lookups through ancestors, overlap checks, updates, exports.

A catalogue row has ``folder_key`` (the folder it is filed under) and the record columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldledger.functions.paths import ancestors, build_destination, clean_path, rebase
from coldledger.sources.catalogue import KEY

RECORD = ("local_folder", "archive_folder", "s3_storage_class", "profile", "provider", "endpoint",
          "archive_mode", "timestamp", "user")


def catalogue_lookup(folders: DataFrame, catalogue: DataFrame) -> DataFrame:
    """For each distinct folder its own entry, else that of the nearest recursive ancestor.

    The prefix test is an equi-join on expanded ancestors; the same grouping that takes the nearest
    match also removes repeated folders, so each input is read once. A top directory is an ancestor
    of most folders: the adaptive skew join splits it. Unmatched folders stay, with null record columns.
    ``destination`` is where the folder itself lies: its rest of the path below the archive of its entry.
    """
    exploded = folders.select("folder", F.posexplode_outer(ancestors(F.col("folder"))).alias("_depth", KEY))
    entries = catalogue.select(KEY, F.struct(*RECORD).alias("_entry"))
    valid = F.col("_entry").isNotNull() & (
        (F.col(KEY) == F.col("folder")) | (F.col("_entry.archive_mode") == "Recursive"))
    best = F.max_by(F.struct(KEY, "_entry"), F.when(valid, F.col("_depth")))
    return exploded.join(entries, KEY, "left").groupBy("folder").agg(best.alias("_best")).select(
        "folder", F.col(f"_best.{KEY}").alias("matched_folder"),
        F.when(F.col("_best").isNull(), F.lit("none"))
        .when(F.col(f"_best.{KEY}") == F.col("folder"), F.lit("exact"))
        .otherwise(F.lit("ancestor")).alias("match"),
        rebase(F.col("folder"), F.col("_best._entry.local_folder"), F.col("_best._entry.archive_folder")).alias("destination"),
        *[F.col(f"_best._entry.{c}").alias(c) for c in RECORD])


def path_overlaps(folders: DataFrame) -> DataFrame:
    """Folders that are listed twice or lie below another listed folder: (ancestor, folder, copies).

    Each folder carries its number of copies, so equal paths are counted, not paired.
    """
    listed = folders.groupBy("folder").agg(F.count(F.lit(1)).alias("copies"))
    below = listed.select("folder", F.explode(ancestors(F.col("folder"))).alias("ancestor")).where(
        F.col("ancestor") != F.col("folder"))
    keys = listed.select(F.col("folder").alias("ancestor"))
    nested = (below.join(keys, "ancestor")
              .select("ancestor", "folder", F.lit(1).cast("long").alias("copies")))
    twice = listed.where("copies > 1").select(F.col("folder").alias("ancestor"), "folder", "copies")
    return nested.unionByName(twice)


def destination(bucket: str, archive_dir: str) -> Column:
    """Place of a looked-up folder: below its archived parent, else its own."""
    return F.coalesce("destination", build_destination(F.lit(bucket), F.lit(archive_dir), F.col("folder")))


def destination_paths(folders: DataFrame, catalogue: DataFrame, bucket: str, archive_dir: str) -> DataFrame:
    """Where each folder lies or would be put."""
    return catalogue_lookup(folders, catalogue).select(
        "folder", "match", destination(bucket, archive_dir).alias("destination"))


def keep_latest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Newest row per key. An aggregate, so copies of a hot key shrink before the shuffle."""
    packed = F.struct(*df.columns)
    return (df.groupBy(*keys).agg(F.max_by(packed, F.struct(*order)).alias("_row"))
            .select("_row.*"))


def catalogue_upsert(catalogue: DataFrame, entries: DataFrame) -> DataFrame:
    """Catalogue with ``entries`` added or replaced; the last write wins per cleaned key."""
    both = (catalogue.withColumn("_new", F.lit(0))
            .unionByName(entries.withColumn("_new", F.lit(1)), allowMissingColumns=True)
            .withColumn(KEY, clean_path(F.col(KEY))))
    return keep_latest(both, [KEY], "_new", "timestamp", "archive_folder").drop("_new")


def catalogue_export(catalogue: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wanted columns that exist, newest entry first."""
    present = [c for c in columns if c in catalogue.columns]
    return catalogue.orderBy(F.desc("timestamp"), KEY).select(*present)


def unarchived_hotspots(hotspot_rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Hotspots that no catalogue entry covers."""
    found = catalogue_lookup(hotspot_rows, catalogue).where("match <> 'none'")
    return hotspot_rows.join(found.select("folder"), "folder", "left_anti")
