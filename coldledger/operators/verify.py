"""Checksum verification and the decisions that depend on it.

Manifests have folder, name, md5. Object listings have bucket, key, md5; which folder an object archives
follows from where it lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldledger.constants import META
from coldledger.operators.catalogue import catalogue_lookup
from coldledger.operators.inventory import non_meta
from coldledger.functions.objects import digest_text, is_glacier, packed_digest, placed
from coldledger.session import kept


def content_md5(files: DataFrame, content: str = "content") -> DataFrame:
    """Digest of content that is already in a column (text counts as UTF-8 bytes)."""
    return files.withColumn("md5", F.md5(F.col(content).cast("binary"))).drop(content)


def md5_manifest(digests: DataFrame, names: Sequence[str] = META.not_hashed) -> DataFrame:
    """Manifest rows without the files that are never hashed."""
    return non_meta(digests.select("folder", "name", "md5"), names)


def archived_digests(objects: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """One row per place and name with its digest; empty where the copies of a row have several, or none.

    A stored listing is that already and is passed through.
    """
    if "place" in objects.columns:
        return objects
    digest = packed_digest(F.coalesce("md5", F.lit("")))
    return objects.select(*placed(objects), digest.alias("_md5"), *more).groupBy("place", "name").agg(
        F.when(F.min("_md5") == F.max("_md5"), digest_text(F.min("_md5"))).otherwise(F.lit("")).alias("md5"),
        *[F.max(c).alias(c) for c in more])


def _compared(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Per folder and name: the least and greatest digest of each side, null where a side has no such file.

    The sides are stacked and aggregated, so each one is read once and copies of a row shrink early.
    """
    sides = {"src": src, "dst": dst}
    rows = None
    for side, df in sides.items():
        part = df.select("folder", "name", F.coalesce("md5", F.lit("")).alias("md5"), F.lit(side).alias("side"))
        rows = part if rows is None else rows.unionByName(part)
    of = lambda side: F.when(F.col("side") == side, F.col("md5"))
    return rows.groupBy("folder", "name").agg(
        *[f(of(side)).alias(f"{side}_{n}") for side in sides for n, f in (("low", F.min), ("high", F.max))])


def _status(side: str) -> Column:
    """How one side of ``_compared`` and the archive agree; null for names that neither has."""
    low, high, dst = F.col(f"{side}_low"), F.col(f"{side}_high"), F.col("dst_low")
    same = (low == high) & (dst == F.col("dst_high")) & (low == dst) & (low != "")
    return (F.when(low.isNull() & dst.isNull(), F.lit(None))
            .when(dst.isNull(), F.lit("missing_on_dst"))
            .when(low.isNull(), F.lit("missing_on_src"))
            .when(same, F.lit("match")).otherwise(F.lit("differ")))


def verify_checksums(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Compare by folder and name: match, differ, missing_on_dst or missing_on_src.

    Both sides hold direct files under their own folder, so only that level is compared. A name that
    comes with several digests, or with none, never matches.
    """
    digest = lambda side: F.nullif(F.col(f"{side}_low"), F.lit("")).alias(f"{side}_md5")
    return _compared(src, dst).select("folder", "name", digest("src"), digest("dst"), _status("src").alias("status"))


def verified_folders(verification: DataFrame) -> DataFrame:
    """Per folder: files compared, those in its manifest, those that fail, and whether all match."""
    failed = F.count_if(F.col("status") != "match")
    return verification.groupBy("folder").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") != "missing_on_src").alias("listed"),
        failed.alias("failed"), (failed == 0).alias("ok"))


def distinct_places(places: DataFrame, *more: str) -> DataFrame:
    """Each folder and its place (empty if it has none) once, so that repeated folders do not multiply their files."""
    return places.select("folder", F.coalesce("destination", F.lit("")).alias("place"), *more).distinct()


def stored_places(places: DataFrame, *more: str) -> DataFrame:
    """``distinct_places`` from a table, whose size Spark knows before it moves files to meet it."""
    return kept(distinct_places(places, *more), "places")


def _listed(src: DataFrame, places: DataFrame, *keep: str) -> DataFrame:
    """Manifest rows with their folder's place: folder, place, name, digest (packed), *keep, more columns of places."""
    digests = src.select("folder", "name", packed_digest(F.coalesce("md5", F.lit(""))).alias("digest"), *keep)
    return digests.join(places, "folder", "left").select(
        "folder", F.coalesce("place", F.lit("")).alias("place"), "name", "digest", *keep, *places.columns[2:])


def _against(listed: DataFrame, objects: DataFrame, *keep: str) -> DataFrame:
    """Each manifest name against what lies at its folder's place: folder, place, name, status, *keep.

    Only manifests move: they meet the listing on place and name, by which a stored listing is bucketed.
    """
    dst = archived_digests(objects).select("place", "name", packed_digest(F.col("md5")).alias("dst_md5"))
    met = listed.join(dst, ["place", "name"], "left")
    same = F.coalesce((F.col("digest") == F.col("dst_md5")) & (F.col("digest") != packed_digest(F.lit(""))), F.lit(False))
    return met.groupBy("place", "name", "folder", *keep).agg(
        F.when(~F.bool_and(F.col("dst_md5").isNotNull()), F.lit("missing_on_dst"))
        .when(F.bool_and(same), F.lit("match")).otherwise(F.lit("differ")).alias("status"))


def asked_of_places(src: DataFrame, places: DataFrame, *keep: str) -> DataFrame:
    """Manifest rows for each folder that shares the place of the one listing them: place, name, folder, digest, own, *keep."""
    at = places.where("destination IS NOT NULL").select("folder", F.col("destination").alias("place"))
    sharing = at.groupBy("place").agg(F.collect_set("folder").alias("sharers")).where(F.size("sharers") > 1)
    # Folders learn who shares their place before the manifests, which are many more rows, meet them.
    shared = places.select("folder", F.coalesce("destination", F.lit("")).alias("destination"), F.lit(True).alias("placed")).join(
        sharing.withColumnRenamed("place", "destination"), "destination", "left")
    listed = _listed(src, stored_places(shared, "sharers", "placed"), *keep)
    asked = listed.withColumn("by", F.col("folder")).withColumn("folder", F.explode(F.coalesce("sharers", F.array("folder"))))
    return asked.select("place", "name", "folder", "digest", (F.col("by") == F.col("folder")).alias("own"), "placed", *keep)


def unnamed_objects(moved: DataFrame, objects: DataFrame, places: DataFrame) -> DataFrame:
    """Folder and name of the objects at folders' places that none of the rows ``asked_of_places`` names."""
    at = places.where("destination IS NOT NULL").select("folder", F.col("destination").alias("place"))
    # Moved once for both joins, as this one, too, names all columns; no manifest row lacks a digest.
    nothing = " AND ".join(f"{c} IS NULL" for c in moved.columns if c not in ("place", "name"))
    unnamed = moved.join(archived_digests(objects).select("place", "name"), ["place", "name"], "full").where(nothing).select("place", "name")
    return unnamed.join(at, "place").select("folder", "name")


def verify_archives(src: DataFrame, objects: DataFrame, places: DataFrame) -> DataFrame:
    """Compare manifests with what lies at their folders' places (folder, destination): folder, name, status.

    As ``verify_checksums``, but for a listing, raw or stored, instead of rows under folders. Objects at a place
    that a folder's manifest does not name are missing_on_src for it. Manifests are moved to the listing once, for what
    they name and for what they do not; only that remainder is looked up by place. Where folders share a place, each name
    that one of them lists is asked of all.
    """
    moved = asked_of_places(src, places).drop("placed")
    found = _against(moved, objects, "own").groupBy("place", "name", "folder").agg(
        F.max_by("status", "own").alias("status"), F.bool_or("own").alias("own"))
    status = F.when(F.col("own"), F.col("status")).when(F.col("status") != "missing_on_dst", F.lit("missing_on_src"))
    others = unnamed_objects(moved, objects, places).withColumn("status", F.lit("missing_on_src"))
    return found.select("folder", "name", status.alias("status")).where("status IS NOT NULL").unionByName(others)


def folder_checks(src: DataFrame, objects: DataFrame, places: DataFrame, restored: DataFrame | None = None) -> DataFrame:
    """Per folder: has_manifest, and ok if its place holds exactly what the manifest lists.

    Folders without an archive-time manifest are judged by the restore-time one, if there is any. Objects that no
    manifest names are found by counting: a place must hold as many names as matched.
    """
    sides = src.select("folder", "name", "md5", F.lit("src").alias("side"))
    if restored is not None:
        sides = sides.unionByName(restored.select("folder", "name", "md5", F.lit("re").alias("side")))
    facts = _against(_listed(sides, distinct_places(places), "side"), objects, "side").groupBy("folder", "place", "side").agg(
        F.count(F.lit(1)).alias("names"), F.bool_and(F.col("status") == "match").alias("match"))
    held = archived_digests(objects).groupBy("place").agg(F.count(F.lit(1)).alias("held"))
    judged = facts.join(held, "place", "left").withColumn("ok", F.col("match") & (F.col("names") == F.col("held")))
    # The archive-time manifest wins where there is one: 's' sorts behind 'r'.
    return judged.groupBy("folder").agg(
        F.lit(True).alias("has_manifest"), F.coalesce(F.max_by("ok", "side"), F.lit(False)).alias("ok"))


def archive_state(folders: DataFrame, catalogue: DataFrame, src: DataFrame, objects: DataFrame) -> DataFrame:
    """archived, mismatch, leftover (a manifest but no entry) or new, per folder."""
    return state_of(catalogue_lookup(folders, catalogue), src, objects).select("folder", "match", "state")


def state_of(found: DataFrame, src: DataFrame, objects: DataFrame) -> DataFrame:
    """``archive_state`` for folders whose catalogue entries are looked up already.

    Only objects at the destination that the catalogue names count as the folder's archive.
    """
    entry = F.col("match") != "none"
    state = (F.when(~F.coalesce("has_manifest", F.lit(False)), F.lit("new"))
             .when(entry & F.col("ok"), F.lit("archived"))
             .when(entry, F.lit("mismatch"))
             .otherwise(F.lit("leftover")))
    found = kept(found, "found")  # small, and known to be so before files meet it
    checks = folder_checks(src, objects, found)
    return found.join(checks, "folder", "left").select(*found.columns, state.alias("state"))


def _content_folders(files: DataFrame, names: Sequence[str]) -> DataFrame:
    """Folders with at least one own file; reduced before any join."""
    return non_meta(files, names).select("folder").distinct()


def folders_with_content(folders: DataFrame, files: DataFrame,
                         names: Sequence[str] = META.all_meta) -> DataFrame:
    return folders.join(_content_folders(files, names), "folder", "left_semi")


def folders_skipped(folders: DataFrame, files: DataFrame,
                    names: Sequence[str] = META.all_meta) -> DataFrame:
    return folders.join(_content_folders(files, names), "folder", "left_anti")


def delete_plan(folders: DataFrame, catalogue: DataFrame, src: DataFrame, objects: DataFrame,
                files: DataFrame, restored: DataFrame | None = None,
                names: Sequence[str] = META.all_meta, moved_note: str = META.moved_note) -> DataFrame:
    """What may be deleted, and why not: one decision per folder with its files and bytes.

    A folder may go only if the objects at its catalogued destination match its manifest; a copy
    anywhere else does not count.
    """
    is_own = ~F.col("name").isin(*names)
    local = files.groupBy("folder").agg(
        F.count_if(is_own).alias("files"),
        F.coalesce(F.sum(F.when(is_own, F.col("size"))), F.lit(0)).alias("bytes"),
        F.bool_or(F.col("name") == moved_note).alias("_moved"))
    decision = (F.when(F.coalesce("_moved", F.lit(False)), F.lit("already_deleted"))
                .when(F.col("match") == "none", F.lit("not_archived"))
                .when(~F.coalesce("has_manifest", F.lit(False)), F.lit("no_manifest"))
                .when(~F.col("ok"), F.lit("checksum_mismatch"))
                .otherwise(F.lit("delete")))
    found = kept(catalogue_lookup(folders, catalogue), "found")  # small, and known to be so before files meet it
    return (found.join(folder_checks(src, objects, found, restored), "folder", "left")
            .join(local, "folder", "left")
            .select("folder", decision.alias("decision"), "destination",
                    "local_folder", "s3_storage_class", "archive_mode", "profile", "provider",
                    "endpoint", "user",
                    F.coalesce("files", F.lit(0)).cast("long").alias("files"),
                    F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")))


def restore_plan(folders: DataFrame, catalogue: DataFrame, files: DataFrame,
                 names: Sequence[str] = META.all_meta) -> DataFrame:
    """Which folders can be restored: archived ones that hold nothing but metadata."""
    occupied = _content_folders(files, names).withColumn("_occupied", F.lit(True))
    decision = (F.when(F.col("match") == "none", F.lit("not_archived"))
                .when(F.col("_occupied"), F.lit("not_empty"))
                .otherwise(F.lit("restore")))
    return (catalogue_lookup(folders, catalogue).join(occupied, "folder", "left")
            .select("folder", decision.alias("decision"), F.col("destination").alias("source"), "s3_storage_class",
                    F.coalesce(is_glacier(F.col("s3_storage_class")), F.lit(False)).alias("needs_retrieval")))
