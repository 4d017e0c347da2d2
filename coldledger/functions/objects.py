"""Classification of archived objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldledger.constants import GLACIER_CLASSES, META
from coldledger.functions.paths import basename


def location(bucket: Column, key: Column) -> Column:
    """Location of the folder that holds an object; each input is named once, as it may be a long expression."""
    return F.regexp_replace(F.concat(F.lit(":s3:"), bucket, F.lit("/"), key), "/[^/]*$", "")


def placed(objects: DataFrame) -> tuple[Column, Column]:
    """Place and name of each object: the columns of a stored listing, else cut from bucket and key.

    Never null, so that no test for null is pushed into the plan that makes the listing.
    """
    if "place" in objects.columns:
        return F.col("place"), F.col("name")
    return (F.coalesce(location(F.col("bucket"), F.col("key")), F.lit("")).alias("place"),
            F.coalesce(basename(F.col("key")), F.lit("")).alias("name"))


def packed_digest(md5: Column) -> Column:
    """A digest text as bytes, half as many to shuffle where it is 32 hex digits; different texts stay different."""
    return F.when(md5.rlike(r"\A[0-9a-f]{32}\z"), F.unhex(md5)).otherwise(F.encode(F.concat(F.lit("text:" + " " * 16), md5), "UTF-8"))


def digest_text(packed: Column) -> Column:
    """The text that ``packed_digest`` was given."""
    return F.when(F.octet_length(packed) == 16, F.lower(F.hex(packed))).otherwise(
        F.decode(F.substring(packed, 22, 1 << 30), "UTF-8"))


def is_glacier(storage_class: Column) -> Column:
    return storage_class.isin(*GLACIER_CLASSES)


def restore_class(storage_class: Column, restore: Column, key: Column, option: str = "Bulk",
                  manifest_name: str = META.manifest) -> Column:
    """State of one object for a retrieval request with the given option."""
    running = F.coalesce(restore, F.lit(""))
    rejected = (storage_class == "DEEP_ARCHIVE") & F.lit(option == "Expedited")
    return (
        F.when(storage_class.isNull(), F.lit("ignored"))
        .when(running.contains('ongoing-request="true"'), F.lit("restoring"))
        .when(running.contains('ongoing-request="false"'), F.lit("restored"))
        .when(~is_glacier(storage_class) & key.endswith(manifest_name), F.lit("ignored"))
        .when(~is_glacier(storage_class), F.lit("not_glacier"))
        .when(rejected, F.lit("unsupported"))
        .otherwise(F.lit("triggered"))
    )
