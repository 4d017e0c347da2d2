"""Who may read and write which files and folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.functions.paths import ancestors, parent
from coldledger.functions.permissions import can_search, mode_flags
from coldledger.session import kept


def rw_permissions(files: DataFrame, uid: int, gids: Sequence[int]) -> DataFrame:
    """Add the access flags of one user to every row (needs mode, uid, gid)."""
    flags = mode_flags(F.col("mode"), F.col("uid"), F.col("gid"), uid, gids)
    return files.withColumns(flags)


def writable_hotspots(hotspot_rows: DataFrame, folders: DataFrame, uid: int,
                      gids: Sequence[int]) -> DataFrame:
    """Hotspots whose folder still exists and that the user may write to."""
    allowed = rw_permissions(folders.select("folder", "mode", "uid", "gid"), uid, gids)
    return hotspot_rows.join(allowed.where("can_write").select("folder"), "folder", "left_semi")


def folder_permission_ok(files: DataFrame, roots: DataFrame, uid: int, gids: Sequence[int],
                         recursive: bool = False) -> DataFrame:
    """Per root: may the user read and write every file in it (or anywhere below it)?

    Rows are reduced to one per folder before the ancestors are expanded. A root without
    files passes.
    """
    checked = rw_permissions(files, uid, gids).groupBy("folder").agg(
        F.bool_and(F.col("can_read") & F.col("can_write")).alias("_ok"))
    if recursive:
        checked = (checked.select(F.explode(ancestors(F.col("folder"))).alias("folder"), "_ok")
                   .groupBy("folder").agg(F.bool_and("_ok").alias("_ok")))
    return (roots.select("folder").distinct().join(checked, "folder", "left")
            .select("folder", F.coalesce("_ok", F.lit(True)).alias("ok")))


def folder_permission_tree(crawl: DataFrame, roots: DataFrame, uid: int, gids: Sequence[int]) -> DataFrame:
    """Per root: direct_ok, recursive_ok and reachable, from the files and directories of a crawl.

    ``crawl`` has filename, UID, GID, st_mode and pw_fcount (-1 for files). A root is ok if it and every file in it,
    or everything below it, directories included, can be read and written; reachable if it and all directories
    above it can be passed through. Entries are reduced to one row per folder before ancestors are expanded; what
    the crawl does not list is not held against a root.
    """
    is_dir = F.col("pw_fcount") > -1
    flags = mode_flags(F.col("st_mode"), F.col("UID"), F.col("GID"), uid, gids)
    granted = flags["can_read"] & flags["can_write"]
    passes = can_search(F.col("st_mode"), F.col("UID"), F.col("GID"), uid, gids)
    # A row per folder, read three times: the crawl is made and reduced once.
    held = kept(crawl.groupBy(F.when(is_dir, F.col("filename")).otherwise(parent(F.col("filename"))).alias("folder")).agg(
        F.bool_and(granted).alias("own"), F.bool_and(F.when(is_dir, passes)).alias("open")), "permissions")
    below = (held.select(F.explode(ancestors(F.col("folder"))).alias("folder"), "own")
             .groupBy("folder").agg(F.bool_and("own").alias("all")))
    wanted = roots.select("folder").distinct()
    above = (wanted.select(F.col("folder").alias("root"), F.explode(ancestors(F.col("folder"))).alias("folder"))
             .join(held.select("folder", "open"), "folder", "left")
             .groupBy(F.col("root").alias("folder")).agg(F.bool_and("open").alias("reach")))
    known = lambda c, name: F.coalesce(c, F.lit(True)).alias(name)
    return (wanted.join(held, "folder", "left").join(below, "folder", "left").join(above, "folder", "left")
            .select("folder", known("own", "direct_ok"), known("all", "recursive_ok"), known("reach", "reachable")))
