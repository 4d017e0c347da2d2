"""Folder inventory: which folders are large, cold and worth archiving.

Tables: ``files`` has folder, name, size, atime, mtime, uid, gid, mode; ``crawl`` has one
row per file (pw_fcount = -1) and one per folder (count and bytes of its direct files).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldledger.constants import (
    AGE_DAYS, GIB, META, MIB, MIN_FOLDER_AVG_MIB, MIN_FOLDER_GIB, SNAPSHOT_DIRS, TIB)
from coldledger.functions.paths import ancestors, clean_path
from coldledger.functions.units import age_years, to_tib


def folder_rows(crawl: DataFrame) -> DataFrame:
    return crawl.where(F.col("pw_fcount") > -1)


def file_rows(crawl: DataFrame) -> DataFrame:
    return crawl.where(F.col("pw_fcount") == -1)


def non_empty(crawl: DataFrame) -> DataFrame:
    return crawl.where(F.col("pw_dirsum") > 0)


def non_meta(files: DataFrame, names: Sequence[str] = META.all_meta) -> DataFrame:
    return files.where(~F.col("name").isin(*names))


def skip_snapshots(files: DataFrame, skip: Sequence[str] = SNAPSHOT_DIRS) -> DataFrame:
    """Drop everything below a snapshot directory at any depth."""
    inside = [F.array_contains(F.split("folder", "/"), s) for s in skip]
    return files.where(~reduce(lambda a, b: a | b, inside))


def crawl_outside_snapshots(crawl: DataFrame, skip: Sequence[str] = SNAPSHOT_DIRS) -> DataFrame:
    """The same for crawl rows, tested on their paths before anything is grouped."""
    path = F.when(F.col("pw_fcount") == -1, F.col("filename")).otherwise(F.concat("filename", F.lit("/")))
    return crawl.where(~reduce(lambda a, b: a | b, [F.contains(path, F.lit(f"/{s}/")) for s in skip]))


def files_and_links(crawl: DataFrame) -> DataFrame:
    """Regular files and links; links to directories are entries too and are never followed."""
    return crawl.where(F.col("type").isin("f", "l"))


def folder_rollup(files: DataFrame) -> DataFrame:
    """Direct files per folder: count and bytes."""
    return files.groupBy("folder").agg(
        F.count(F.lit(1)).alias("fcount"), F.sum("size").alias("dirsum"))


def recursive_rollup(files: DataFrame) -> DataFrame:
    """Count and bytes of whole subtrees.

    Files are first summed per folder, so only one row per folder is repeated for its ancestors.
    """
    return (folder_rollup(files)
            .select(F.explode(ancestors(F.col("folder"))).alias("folder"), "fcount", "dirsum")
            .groupBy("folder").agg(F.sum("fcount").alias("fcount"), F.sum("dirsum").alias("dirsum")))


def size_units(folders: DataFrame, count: str = "fcount", total: str = "dirsum") -> DataFrame:
    """Add unrounded gib, tib and mib_avg; a folder without files has no average."""
    b = F.col(total).cast("double")
    return folders.select(
        "*", (b / GIB).alias("gib"), (b / TIB).alias("tib"),
        F.try_divide(b / MIB, F.col(count).cast("double")).alias("mib_avg"))


def hotspot_base(crawl: DataFrame) -> DataFrame:
    """Non-empty folder rows of a crawl under report names, with sizes in units."""
    rows = non_empty(folder_rows(crawl)).select(
        F.col("filename").alias("folder"), F.col("UID").alias("uid"), F.col("GID").alias("gid"),
        F.col("st_atime").alias("atime"), F.col("st_mtime").alias("mtime"),
        F.col("pw_fcount").alias("fcount"), F.col("pw_dirsum").alias("dirsum"))
    return size_units(rows)


def is_hotspot(min_gib: float | None = None, min_mib: float | None = None) -> Column:
    """Threshold on unrounded sizes. None means the default; 0 means no threshold."""
    gib = MIN_FOLDER_GIB if min_gib is None else min_gib
    mib = MIN_FOLDER_AVG_MIB if min_mib is None else min_mib
    return (F.col("gib") >= F.lit(float(gib))) & (F.col("mib_avg") >= F.lit(float(mib)))


def truncate_units(df: DataFrame) -> DataFrame:
    """Sizes in units cut to whole numbers, toward zero."""
    return df.withColumns({c: F.col(c).cast("long") for c in ("gib", "tib", "mib_avg") if c in df.columns})


def hotspots(base: DataFrame, min_gib: float | None = None, min_mib: float | None = None) -> DataFrame:
    """Folders over both thresholds; reports sort them when they are written."""
    return truncate_units(base.where(is_hotspot(min_gib, min_mib)))


def top_hotspots(hotspot_rows: DataFrame, n: int) -> DataFrame:
    """The n largest hotspots for display."""
    return hotspot_rows.orderBy(F.desc("dirsum"), "folder").limit(n)


def newest_times(files: DataFrame, folders: DataFrame, names: Sequence[str] = META.all_meta) -> DataFrame:
    """Newest atime and mtime of each folder's direct files; the folder's own time when it has none."""
    newest = non_meta(files, names).groupBy("folder").agg(
        F.max("atime").alias("_a"), F.max("mtime").alias("_m"))
    return (folders.join(newest, "folder", "left")
            .withColumns({"atime": F.coalesce("_a", "atime"), "mtime": F.coalesce("_m", "mtime")})
            .drop("_a", "_m"))


def pick(hotspot_rows: DataFrame, larger: float = 0, older: int = 0, newer: int = 0,
         by: str = "accd") -> DataFrame:
    """Hotspots larger than ``larger`` GiB and either older or newer than a number of days."""
    if older and newer:
        raise ValueError("older and newer exclude each other")
    if by not in ("accd", "modd"):
        raise ValueError("by must be accd or modd")
    chosen = hotspot_rows.where(F.col("gib") > larger) if larger else hotspot_rows
    if older:
        chosen = chosen.where(F.col(by) > older)
    if newer:
        chosen = chosen.where(F.col(by) < newer)
    return chosen


def index_summary(folders: DataFrame, hotspot_rows: DataFrame) -> DataFrame:
    """One row: folders processed, hotspots found, their bytes and TiB."""
    seen = folders.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("n").alias("folders"), F.lit(0).cast("long").alias("hotspots"), F.lit(0).cast("long").alias("bytes"))
    hot = hotspot_rows.agg(F.count(F.lit(1)).alias("n"), F.sum("dirsum").alias("b")).select(
        F.lit(0).cast("long").alias("folders"), F.col("n").alias("hotspots"),
        F.coalesce("b", F.lit(0)).cast("long").alias("bytes"))
    return (seen.unionByName(hot)
            .agg(F.sum("folders").alias("folders"), F.sum("hotspots").alias("hotspots"),
                 F.sum("bytes").alias("bytes"))
            .withColumn("tib", to_tib(F.col("bytes"))))


def aged_bytes(hotspot_rows: DataFrame, days: Sequence[int] = AGE_DAYS) -> DataFrame:
    """Bytes of hotspots not accessed for more than each number of days; buckets are cumulative."""
    sums = hotspot_rows.agg(*[
        F.coalesce(F.sum(F.when(F.col("accd") > d, F.col("dirsum"))), F.lit(0)).cast("long").alias(f"d{d}")
        for d in days])
    entries = F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"d{d}").alias("bytes")) for d in days])
    return sums.select(F.inline(entries))


def aged_bytes_report(aged: DataFrame) -> DataFrame:
    """Report lines, oldest first, without empty buckets and those equal to the bucket before.

    ``aged`` holds one row per threshold, so the unpartitioned window sees a handful of rows.
    """
    before = F.coalesce(F.lag("bytes").over(Window.orderBy(F.desc("days"))), F.lit(0))
    return (aged.withColumn("_before", before)
            .where((F.col("bytes") > 0) & (F.col("bytes") != F.col("_before")))
            .select("days", "bytes", to_tib(F.col("bytes")).alias("tib"), age_years(F.col("days")).alias("years")))


def multi_root_union(roots: dict[str, DataFrame]) -> DataFrame:
    """Tables of several roots as one, with a ``root`` column."""
    tagged = [df.withColumn("root", F.lit(root)) for root, df in roots.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def locked_folders(errors: DataFrame) -> DataFrame:
    """Folders that the crawl could not enter, from its error lines (source, pos, line)."""
    path = F.trim(F.substring_index(F.col("line"), "Locked Dir:", -1))
    return errors.where(F.col("line").contains("Locked Dir:") & (path != "")).select(clean_path(path).alias("folder")).distinct()


def mask_locked(folders: DataFrame, locked: DataFrame) -> DataFrame:
    """Folders that the crawl saw whole, with ``complete``: is nothing below them locked?

    Locked folders and all below them are left out: their numbers are those of a part. Both tests are equi-joins
    on expanded ancestors of rows that are one per folder.
    """
    inside = (folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("above"))
              .join(locked.select(F.col("folder").alias("above")), "above", "left_semi").select("folder").distinct())
    above = locked.select(F.explode(ancestors(F.col("folder"))).alias("folder")).distinct().withColumn("_cut", F.lit(True))
    return (folders.join(inside, "folder", "left_anti").join(above, "folder", "left")
            .withColumn("complete", F.col("_cut").isNull()).drop("_cut"))


def crawl_errors(lines: DataFrame) -> DataFrame:
    """Locked directories and, per source, the first permission error.

    ``lines`` has source, pos, line.
    """
    locked = lines.where(F.col("line").contains("Locked Dir:")).select(
        "source", F.lit("locked").alias("kind"), "line")
    denied = (lines.where(F.col("line").contains("Permission denied"))
              .groupBy("source").agg(F.min_by("line", "pos").alias("line"))
              .select("source", F.lit("denied").alias("kind"), "line"))
    return locked.unionByName(denied)
