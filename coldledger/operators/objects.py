"""Object listings: sizes by prefix, retrieval states, tier changes and their cost.

``objects`` has bucket, key, size, storage_class, restore; a location is ':s3:bucket/prefix'.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldledger.constants import EGRESS_USD_PER_TIB, GLACIER_CLASSES, META, RETRIEVAL_OPTIONS, STORAGE_TIERS, TIB
from coldledger.functions.objects import is_glacier, placed, restore_class
from coldledger.functions.paths import ancestors, basename
from coldledger.functions.units import to_gib
from coldledger.operators.catalogue import catalogue_lookup

STATES = ("triggered", "restoring", "restored", "not_glacier", "unsupported", "ignored")


def object_rollup(objects: DataFrame, keep: Sequence[str] = META.keep_standard) -> DataFrame:
    """Objects, bytes and kept metadata files per location, direct objects only."""
    return objects.groupBy(placed(objects)[0].alias("location")).agg(
        F.count(F.lit(1)).alias("objects"),
        F.sum(F.coalesce("size", F.lit(0))).alias("bytes"),
        F.count_if(basename(F.col("key")).isin(*keep)).alias("kept"))


def subtree_rollup(rollup: DataFrame) -> DataFrame:
    """Roll locations up to all their parents."""
    sums = [F.sum(c).alias(c) for c in ("objects", "bytes", "kept")]
    return (rollup.withColumn("location", F.explode(ancestors(F.col("location"))))
            .groupBy("location").agg(*sums))


def prefix_size(objects: DataFrame, prefixes: DataFrame, recursive: bool = True) -> DataFrame:
    """Objects and bytes below each location; an object without a size counts as 0 bytes."""
    rollup = object_rollup(objects)
    if recursive:
        rollup = subtree_rollup(rollup)
    return (prefixes.select("location").distinct().join(rollup, "location", "left")
            .select("location", F.coalesce("objects", F.lit(0)).alias("objects"),
                    F.coalesce("bytes", F.lit(0)).alias("bytes"),
                    to_gib(F.coalesce("bytes", F.lit(0))).alias("gib")))


def restore_status(objects: DataFrame, option: str = "Bulk") -> DataFrame:
    """Retrieval state of every object."""
    state = restore_class(F.col("storage_class"), F.col("restore"), F.col("key"), option)
    return objects.withColumn("state", state)


def restore_status_counts(objects: DataFrame, option: str = "Bulk") -> DataFrame:
    """Objects per retrieval state and location."""
    return (restore_status(objects, option)
            .groupBy(placed(objects)[0].alias("location"))
            .agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES]))


def restore_readiness(counts: DataFrame) -> DataFrame:
    """Per location: pending while anything is triggered or restoring, and the mix of running ones."""
    running, done = F.col("restoring"), F.col("restored")
    mix = (F.when((running > 0) & (done > 0), F.lit("mixed"))
           .when(running > 0, F.lit("all_running"))
           .when(done > 0, F.lit("all_done"))
           .otherwise(F.lit("none")))
    return counts.select("*", (F.col("triggered") + running > 0).alias("pending"), mix.alias("progress"))


def running_restores(objects: DataFrame) -> DataFrame:
    """Retrievals per location: how many run, at which options, until when at the latest; and what is back until when.

    Needs storage_class, restore, restore_tier (the option of the last request) and restore_requested beside the
    place. The end of a running retrieval is its request plus the longest time its class and option take, null where
    the class does not offer the option. ``kept_until`` is the first date on which a restored copy expires.
    """
    waits = retrieval_options(objects.sparkSession).select(  # a fixed handful of rows
        F.col("storage_class").alias("_class"), F.col("option").alias("_option"), F.col("hours_hi").alias("_hours"))
    state = F.coalesce("restore", F.lit(""))
    running, back = state.contains('ongoing-request="true"'), state.contains('ongoing-request="false"')
    known = objects.join(F.broadcast(waits), (F.col("storage_class") == F.col("_class")) & (F.col("restore_tier") == F.col("_option")), "left")
    end = F.col("restore_requested") + F.make_dt_interval(secs=F.round(F.col("_hours") * 3600, 0).cast("decimal(18,6)"))
    expiry = F.try_to_timestamp(F.regexp_extract(state, 'expiry-date="[A-Za-z]*,? *([^"]*?)(?: GMT)?"', 1), F.lit("d MMM yyyy HH:mm:ss"))
    place = placed(objects)[0].alias("location")
    return known.groupBy(place).agg(
        F.count_if(running).alias("running"),
        F.array_join(F.array_sort(F.collect_set(F.when(running, F.col("restore_tier")))), "+").alias("tiers"),
        F.max(F.when(running, end)).alias("expected_end"), F.count_if(back).alias("restored"),
        F.min(F.when(back, expiry)).alias("kept_until"))


def tier_change_plan(folders: DataFrame, catalogue: DataFrame, objects: DataFrame, new_class: str) -> DataFrame:
    """What moving the archives of the given folders to another storage class would touch.

    One row for each archive (catalogue entry), with the number of folders that asked for it; folders
    without an archive have a row of their own. An object counts for the nearest archive above it in the
    catalogue only, so the rows add up to the objects. Archives that need a retrieval first are rejected.
    Metadata files keep their class; they count as skipped but their bytes belong to the total.
    """
    asked = catalogue_lookup(folders, catalogue).groupBy(
        F.coalesce("matched_folder", "folder").alias("archive"), F.col("archive_folder").alias("location"),
        F.col("s3_storage_class").alias("old_class")).agg(F.count(F.lit(1)).alias("folders"))
    decision = (F.when(F.col("location").isNull(), F.lit("not_archived"))
                .when(is_glacier(F.col("old_class")), F.lit("rejected")).otherwise(F.lit("change")))
    moves = F.col("decision") == "change"
    count = lambda c: F.when(moves, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long")
    return (asked.join(archive_sizes(catalogue, objects), "location", "left").withColumn("decision", decision).select(
        "archive", "location", "folders", "decision", "old_class", F.lit(new_class).alias("new_class"),
        count("objects").alias("total"), count(F.col("objects") - F.col("kept")).alias("changed"),
        count("kept").alias("skipped"), count("bytes").alias("bytes")))


def archive_sizes(catalogue: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects, bytes and kept files of each archive; each object belongs to the nearest archive above it.

    Objects are one row per location before the ancestors are expanded.
    """
    archives = catalogue.select(F.col("archive_folder").alias("above"), "archive_mode").distinct()
    at = object_rollup(objects).select("*", F.posexplode(ancestors(F.col("location"))).alias("_depth", "above"))
    valid = (F.col("above") == F.col("location")) | (F.col("archive_mode") == "Recursive")
    nearest = (at.join(archives, "above").where(valid).groupBy("location", "objects", "bytes", "kept")
               .agg(F.max_by("above", "_depth").alias("archive")))
    return nearest.groupBy(F.col("archive").alias("location")).agg(
        *[F.sum(c).alias(c) for c in ("objects", "bytes", "kept")])


def storage_tiers(spark: SparkSession) -> DataFrame:
    """Price list of the storage classes; a fixed handful of rows."""
    money = lambda x: Decimal(x)
    rows = [(c, n, money(lo), money(hi), t, money(r)) for c, n, lo, hi, t, r in STORAGE_TIERS]
    return spark.createDataFrame(rows, "storage_class string, tier_name string, "
                                 "storage_lo decimal(10,2), storage_hi decimal(10,2), "
                                 "retrieval_time string, retrieval decimal(10,2)")


def retrieval_options(spark: SparkSession) -> DataFrame:
    """Retrieval prices and hours of the classes that need one; a fixed handful of rows."""
    rows = [(c, o, None if p is None else Decimal(p), lo, hi, ok) for c, o, p, lo, hi, ok in RETRIEVAL_OPTIONS]
    return spark.createDataFrame(rows, "storage_class string, option string, usd_per_tib decimal(10,2), "
                                 "hours_lo double, hours_hi double, supported boolean")


def tier_cost_estimate(sizes: DataFrame, option: str = "Bulk",
                       egress_usd_per_tib: float = EGRESS_USD_PER_TIB) -> DataFrame:
    """Monthly storage, retrieval and download cost of ``sizes`` (storage_class, bytes, ...).

    Both price lists are constants of this package, so broadcasting them is bounded.
    """
    spark = sizes.sparkSession
    prices = retrieval_options(spark).where(F.col("option") == option).drop("option")
    tib = F.col("bytes").cast("double") / F.lit(float(TIB))
    cost = lambda c: F.round(tib * c.cast("double"), 4)
    frozen = F.col("storage_class").isin(*GLACIER_CLASSES)
    return (sizes.join(F.broadcast(storage_tiers(spark)), "storage_class", "left")
            .join(F.broadcast(prices), "storage_class", "left")
            .select(*sizes.columns, F.round(tib, 3).alias("tib"),
                    cost(F.col("storage_lo")).alias("storage_lo_usd"),
                    cost(F.col("storage_hi")).alias("storage_hi_usd"),
                    F.when(frozen, F.col("supported")).otherwise(F.lit(True)).alias("supported"),
                    cost(F.when(frozen, F.col("usd_per_tib")).otherwise(F.col("retrieval"))).alias("retrieval_usd"),
                    cost(F.lit(egress_usd_per_tib)).alias("egress_usd"),
                    F.when(frozen, F.col("hours_hi")).otherwise(F.lit(0.0)).alias("hours_hi")))
