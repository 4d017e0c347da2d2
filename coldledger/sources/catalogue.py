"""Scans of the archive catalogue and of object inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldledger.schemas import ARCHIVE_RECORD

KEY = "folder_key"
_MAP = T.MapType(T.StringType(), ARCHIVE_RECORD)


def parse_catalogue(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON maps folder -> record, one row per entry. A corrupt document gives no rows."""
    return (documents.select(F.explode(F.from_json(column, _MAP)).alias(KEY, "record"))
            .select(KEY, "record.*"))


def read_catalogue_json(spark: SparkSession, path: str, one_map_per_file: bool = False) -> DataFrame:
    """Catalogue files with one JSON map to a line, as ``write_catalogue_json`` leaves them.

    A line that is no JSON map ends the job instead of losing entries. ``one_map_per_file`` reads small
    files of another tool, which are one map over many lines.
    """
    lines = spark.read.text(path, wholetext=one_map_per_file).where(F.trim("value") != "")
    body = F.trim(F.regexp_replace("value", r"\s+$", ""))
    whole = body.startswith("{") & body.endswith("}") & F.from_json("value", _MAP).isNotNull()
    checked = F.when(whole, F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("not a catalogue map: "), F.left("value", F.lit(80)))))
    return parse_catalogue(lines.select(checked.alias("value")))


def read_objects(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """Parquet object inventory; the prefix filter is pushed to the scan."""
    objects = spark.read.parquet(path)
    return objects if prefix is None else objects_under(objects, prefix)


def objects_under(objects: DataFrame, prefix: str) -> DataFrame:
    """Objects below a prefix, whole path components only."""
    return objects.where(F.col("key").startswith(prefix.rstrip("/") + "/"))


def is_direct_child(key: Column, prefix: str) -> Column:
    stem = prefix.rstrip("/") + "/"
    return key.startswith(stem) & (F.instr(F.substring(key, len(stem) + 1, 1 << 30), "/") == 0)


def direct_children(objects: DataFrame, prefix: str) -> DataFrame:
    return objects.where(is_direct_child(F.col("key"), prefix))
