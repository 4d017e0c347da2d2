"""Index job: crawl table -> hotspot report, summary and aged-bytes report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.constants import META, SNAPSHOT_DIRS
from coldledger.functions.paths import basename, parent
from coldledger.functions.units import epoch_days_ago
from coldledger.operators.catalogue import path_overlaps
from coldledger.operators.inventory import (
    aged_bytes, aged_bytes_report, crawl_outside_snapshots, index_summary, is_hotspot, locked_folders, mask_locked,
    multi_root_union, size_units, truncate_units)
from coldledger.operators.ownership import resolve_owner


@dataclass(frozen=True)
class IndexResult:
    """Results over the same folders; each one is only planned when it is asked for."""

    folders: DataFrame
    hot: DataFrame
    report: DataFrame
    locked: DataFrame | None = None

    @property
    def summary(self) -> DataFrame:
        return index_summary(self.folders, self.hot)

    @property
    def aged(self) -> DataFrame:
        return aged_bytes_report(aged_bytes(self.hot))


def folder_facts(crawl: DataFrame, names: Sequence[str] = META.all_meta) -> DataFrame:
    """Non-empty folders with the newest time of their own files, from one pass over the crawl.

    A file row counts for its parent folder and a folder row for itself, so one aggregation
    replaces a join of folders with their files, and it shrinks each partition to one row per
    folder before the shuffle.
    """
    is_file = F.col("pw_fcount") == -1
    counted = is_file & ~basename(F.col("filename")).isin(*names)
    own = lambda c: F.max(F.when(~is_file, F.col(c)))
    newest = lambda c: F.coalesce(F.max(F.when(counted, F.col(c))), own(c))
    return (crawl.groupBy(F.when(is_file, parent(F.col("filename"))).otherwise(F.col("filename")).alias("folder"))
            .agg(own("UID").alias("uid"), own("GID").alias("gid"),
                 newest("st_atime").alias("atime"), newest("st_mtime").alias("mtime"),
                 own("pw_fcount").alias("fcount"), own("pw_dirsum").alias("dirsum"))
            .where("fcount > -1 and dirsum > 0"))


def index_job(crawl: DataFrame, users: DataFrame, groups: DataFrame, as_of: str,
              min_gib: float | None = None, min_mib: float | None = None, errors: DataFrame | None = None,
              snapshots: Sequence[str] = SNAPSHOT_DIRS) -> IndexResult:
    """Hotspots of a crawl, largest first, under the report's column names.

    Everything below a snapshot directory is left out. With the crawl's error lines, so is every folder that it
    could not enter, and the report says for the others whether their subtree is ``Complete``.
    """
    folders = folder_facts(crawl_outside_snapshots(crawl, snapshots) if snapshots else crawl)
    locked = None if errors is None else locked_folders(errors)
    if locked is not None:
        folders = mask_locked(folders, locked)
    hot = truncate_units(size_units(folders).where(is_hotspot(min_gib, min_mib))).withColumns({
        "accd": epoch_days_ago(F.col("atime"), as_of), "modd": epoch_days_ago(F.col("mtime"), as_of)})
    named = resolve_owner(hot, users, groups)
    report = named.select(
        F.col("owner").alias("User"), F.col("accd").alias("AccD"), F.col("modd").alias("ModD"),
        F.col("gib").alias("GiB"), F.col("mib_avg").alias("MiBAvg"), F.col("folder").alias("Folder"),
        F.col("group_name").alias("Group"), F.col("tib").alias("TiB"),
        F.col("fcount").alias("FileCount"), F.col("dirsum").alias("DirSize"),
        *([] if locked is None else [F.col("complete").alias("Complete")]),
    ).orderBy(F.desc("DirSize"), "Folder")
    return IndexResult(folders, hot, report, locked)


def index_roots(crawls: dict[str, DataFrame], users: DataFrame, groups: DataFrame, as_of: str,
                min_gib: float | None = None, min_mib: float | None = None) -> IndexResult:
    """Index several roots at once. Roots that contain one another are refused."""
    spark = users.sparkSession
    clash = path_overlaps(spark.createDataFrame([(root,) for root in crawls], "folder string")).first()
    if clash is not None:
        raise ValueError(f"{clash.folder} lies below {clash.ancestor}")
    return index_job(multi_root_union(crawls), users, groups, as_of, min_gib, min_mib)
