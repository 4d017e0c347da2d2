"""Report, manifest and crawl writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldledger.operators.permissions import writable_hotspots
from coldledger.operators.reports import note_text
from coldledger.sinks.storage import remove, rename_new
from coldledger.sources.crawl import read_hotspots

_CSV = {"header": "true", "quote": '"', "escape": '"'}
BUCKETS = 16  # directories of a partitioned report; large ones hold several files


def write_hotspots(report: DataFrame, path: str, force: bool = False) -> None:
    """CSV report; an existing one is kept unless ``force``."""
    report.write.mode("overwrite" if force else "ignore").options(**_CSV).csv(path)


def last_modified(spark: SparkSession, path: str) -> object:
    """Newest modification time below a path, or None when nothing is there."""
    from pyspark.errors import AnalysisException

    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                 .select("modificationTime"))
    except AnalysisException:
        return None
    return files.agg(F.max("modificationTime")).first()[0]


def write_user_hotspots(spark: SparkSession, report_path: str, path: str, folders: DataFrame,
                        uid: int, gids: Sequence[int], force: bool = False) -> bool:
    """Report rows one user may write to. Returns False when an up-to-date copy was reused."""
    have, source = last_modified(spark, path), last_modified(spark, report_path)
    if not force and have is not None and source is not None and have >= source:
        return False
    report = read_hotspots(spark, report_path)
    allowed = writable_hotspots(report.withColumnRenamed("Folder", "folder"), folders, uid, gids)
    allowed.withColumnRenamed("folder", "Folder").select(*report.columns).write.mode("overwrite").options(**_CSV).csv(path)
    return True


def write_crawl(crawl: DataFrame, path: str) -> None:
    """Keep the crawl as Parquet, one directory per root."""
    crawl.write.mode("overwrite").partitionBy("root").parquet(path)


def _by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of a bucket together for a partitioned write; adaptive execution splits large buckets."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("folder"), F.lit(buckets))).hint("rebalance", "bucket")


def write_manifest(manifest: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """CSV manifests of all folders, in one directory for each hash bucket of folders.

    The folder is a column: paths may be longer than a directory name, and folders are too many for
    one directory each.
    """
    _by_bucket(manifest, buckets).write.mode("overwrite").partitionBy("bucket").options(**_CSV, compression="gzip").csv(path)


def write_md5_manifest(digests: DataFrame, folders: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """'<folder> TAB <md5>  <name>' lines in hash buckets of folders. Fails when a folder has nothing to list.

    The digests are evaluated once: the lines are written aside, tested there, and then take the place of ``path``.
    """
    spark = digests.sparkSession
    lines = digests.select("folder", F.concat("folder", F.lit("\t"), "md5", F.lit("  "), "name").alias("value"))
    aside = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    _by_bucket(lines, buckets).drop("folder").write.partitionBy("bucket").text(aside)
    listed = spark.read.schema("value string").option("recursiveFileLookup", "true").text(aside).select(
        F.substring_index("value", "\t", 1).alias("folder")).distinct()
    missing = folders.select("folder").join(listed, "folder", "left_anti").agg(
        F.countDistinct("folder").alias("n"), F.min("folder").alias("first")).first()
    if missing["n"]:
        remove(spark, aside)
        raise ValueError(f"no checksums for {missing['n']} folders, first: {missing['first']}")
    remove(spark, path)
    rename_new(spark, aside, path)


def write_deletion_notes(notes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Notes as JSON lines (folder, note) in hash buckets of folders."""
    facts = [c for c in notes.columns if c != "folder"]
    _by_bucket(notes.select("folder", note_text(facts).alias("note")), buckets).write.mode("overwrite").partitionBy("bucket").json(path)
