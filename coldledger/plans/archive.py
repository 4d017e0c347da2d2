"""Archive, delete, restore, tier-change and selection jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.constants import META
from coldledger.functions.paths import ancestors
from coldledger.operators.bundle import small_file_plan
from coldledger.operators.catalogue import KEY, catalogue_lookup, destination, path_overlaps
from coldledger.operators.inventory import non_meta, pick
from coldledger.operators.objects import (
    restore_readiness, restore_status_counts, running_restores, tier_change_plan, tier_cost_estimate)
from coldledger.operators.reports import archive_batch
from coldledger.functions.objects import digest_text
from coldledger.session import kept
from coldledger.operators.verify import (
    archived_digests, asked_of_places, folder_checks, restore_plan, state_of, unnamed_objects, verify_archives)


@dataclass(frozen=True)
class Target:
    """Where and under whose name new archives are filed."""

    bucket: str
    archive_dir: str
    storage_class: str
    profile: str = "default"
    provider: str = "AWS"
    endpoint: str = ""
    user: str = ""
    nih_project: str | None = None


def archive_plan(folders: DataFrame, files: DataFrame, catalogue: DataFrame, src: DataFrame,
                 objects: DataFrame, target: Target, kib: int | None = None, force: bool = False,
                 recursive: bool = False) -> DataFrame:
    """What archiving each folder would do.

    Overlapping folders collide only in a recursive run; folders with a manifest are left
    alone unless forced; folders without own files are skipped.
    """
    state = state_of(catalogue_lookup(folders, catalogue), src, objects).select(
        "folder", "state", destination(target.bucket, target.archive_dir).alias("destination"))
    small = small_file_plan(non_meta(files), kib).select(
        "folder", "bundled", "bundled_bytes", "objects_before", "objects_after")
    plan = state.join(small, "folder", "left")
    collides = F.lit(False)
    if recursive:
        overlaps = path_overlaps(folders)
        clash = (overlaps.select("folder").unionByName(overlaps.select(F.col("ancestor").alias("folder")))
                 .distinct().withColumn("_clash", F.lit(True)))
        plan = plan.join(clash, "folder", "left")
        collides = F.coalesce("_clash", F.lit(False))
    decision = (F.when(collides, F.lit("collision"))
                .when((F.col("state") != "new") & F.lit(not force), F.col("state"))
                .when(F.col("objects_before").isNull(), F.lit("skip"))
                .otherwise(F.lit("archive")))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return plan.select("folder", "state", decision.alias("decision"), "destination",
                       number("bundled"), number("bundled_bytes"), number("objects_before"), number("objects_after"))


def rearchive_files(local: DataFrame, src: DataFrame, objects: DataFrame, places: DataFrame,
                    names: Sequence[str] = META.all_meta, bundle_name: str = META.bundle) -> DataFrame:
    """What a forced archive does with each file: folder, name, size, action.

    Three sides meet: files on disk (folder, name, size, md5), the manifest of the last archive (folder, name, md5)
    and what lies at the folder's place. keep: all agree; upload_new, upload_changed: not, or otherwise, in the
    manifest; upload_missing: the archive lost or altered it; remove: archived but gone from disk; unbundle: the
    packed file, which is unpacked first; drop: other metadata, which is deleted and written anew.
    """
    here = local.select("folder", "name", "md5", F.lit(1).alias("side"), "size")
    then = src.select("folder", "name", "md5", F.lit(2).alias("side"), F.lit(None).cast("long").alias("size"))
    # Both sides move to the listing once, with their digests packed.
    moved = asked_of_places(here.unionByName(then), places, "side", "size")
    own = lambda side, c: F.when(F.col("own") & (F.col("side") == side), c)
    digest = digest_text(F.col("digest"))
    dst = archived_digests(objects).select("place", "name", F.col("md5").alias("there"))
    three = moved.join(dst, ["place", "name"], "left").groupBy("place", "name", "folder").agg(
        F.max(own(1, F.col("size"))).alias("size"), F.max(own(1, digest)).alias("disk"), F.max(own(2, digest)).alias("listed"),
        F.max("there").alias("there"), F.bool_or("own").alias("own"), F.bool_or(F.col("own") & F.col("placed")).alias("placed"))
    unnamed = unnamed_objects(moved, objects, places).select(
        "folder", "name", F.lit("remove").alias("action"), F.lit(None).cast("long").alias("size"))
    same = lambda a, b: (F.col(a) == F.col(b)) & (F.col(a) != "")
    on_disk, meta = F.col("disk").isNotNull(), F.col("name").isin(*names)
    action = (F.when(~F.col("own"), F.when(F.col("there").isNotNull() & ~meta, F.lit("remove")))
              .when(~F.coalesce("placed", F.lit(False)), F.lit(None))
              .when(on_disk & (F.col("name") == bundle_name), F.lit("unbundle"))
              .when(on_disk & meta, F.lit("drop"))
              .when(~on_disk & (meta | F.col("there").isNull()), F.lit(None))
              .when(~on_disk, F.lit("remove"))
              .when(F.col("listed").isNull(), F.lit("upload_new"))
              .when(~same("disk", "listed"), F.lit("upload_changed"))
              .when(F.coalesce(same("disk", "there"), F.lit(False)), F.lit("keep")).otherwise(F.lit("upload_missing")))
    acted = three.select("folder", "name", action.alias("action"), "size").where("action IS NOT NULL")
    return acted.unionByName(unnamed.where(~F.col("name").isin(*names))).select("folder", "name", "size", "action")


def rearchive_plan(folders: DataFrame, local: DataFrame, catalogue: DataFrame, src: DataFrame, objects: DataFrame,
                   names: Sequence[str] = META.all_meta, bundle_name: str = META.bundle) -> DataFrame:
    """Steps of a forced archive for each folder with anything to do: unbundle, files by action, bytes to upload."""
    places = catalogue_lookup(folders, catalogue).select("folder", "destination")
    files = rearchive_files(local, src, objects, places, names, bundle_name)
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return files.groupBy("folder").agg(
        F.bool_or(F.col("action") == "unbundle").alias("unbundle"),
        *[count(a) for a in ("drop", "keep", "upload_new", "upload_changed", "upload_missing", "remove")],
        F.coalesce(F.sum(F.when(F.col("action").startswith("upload"), F.col("size"))), F.lit(0)).cast("long").alias("upload_bytes"))


def catalogue_entries(archived: DataFrame, target: Target, mode: str, timestamp: str) -> DataFrame:
    """Catalogue rows for folders (folder, destination) whose archive was verified."""
    if mode not in ("Single", "Recursive"):
        raise ValueError("mode must be Single or Recursive")
    text = lambda v, n: F.lit(v).cast("string").alias(n)
    return archived.select(
        F.col("folder").alias(KEY), F.col("folder").alias("local_folder"),
        F.col("destination").alias("archive_folder"), text(target.storage_class, "s3_storage_class"),
        text(target.profile, "profile"), text(target.provider, "provider"), text(target.endpoint, "endpoint"),
        text(mode, "archive_mode"), text(timestamp, "timestamp"), text(timestamp, "timestamp_archive"),
        text(target.user, "user"), text(target.nih_project, "nih_project"))


def restore_job(folders: DataFrame, catalogue: DataFrame, files: DataFrame, objects: DataFrame,
                option: str = "Bulk") -> DataFrame:
    """Restore decisions with the retrieval state of each folder's objects.

    Objects whose class does not support the retrieval option make the step ``unsupported``.
    """
    status = restore_readiness(restore_status_counts(objects, option))
    plan = restore_plan(folders, catalogue, files)
    pending = F.coalesce("pending", F.lit(False)) & F.col("needs_retrieval")
    refused = (F.coalesce("unsupported", F.lit(0)) > 0) & F.col("needs_retrieval")
    step = (F.when(F.col("decision") != "restore", F.col("decision"))
            .when(refused, F.lit("unsupported")).when(pending, F.lit("wait")).otherwise(F.lit("download")))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in (
        "triggered", "restoring", "restored", "not_glacier", "unsupported")]
    return (plan.join(status.withColumnRenamed("location", "source"), "source", "left")
            .select("folder", "source", step.alias("step"), "needs_retrieval", *counts,
                    F.coalesce("progress", F.lit("none")).alias("progress")))


def restore_watch(folders: DataFrame, catalogue: DataFrame, objects: DataFrame) -> DataFrame:
    """Archived folders with a retrieval under way: source, running, tiers, expected_end."""
    places = catalogue_lookup(folders, catalogue).where("match <> 'none'").select("folder", F.col("destination").alias("location"))
    return (places.join(running_restores(objects).where("running > 0"), "location")
            .select("folder", F.col("location").alias("source"), "running", "tiers", "expected_end"))


def tier_change_job(folders: DataFrame, catalogue: DataFrame, objects: DataFrame, new_class: str) -> DataFrame:
    """Tier-change plan with the monthly cost before and after."""
    plan = tier_change_plan(folders, catalogue, objects, new_class)
    keys = ["archive", "folders", "decision", "old_class", "new_class", "total", "changed", "skipped", "bytes"]
    before = tier_cost_estimate(plan.select(*keys, F.col("old_class").alias("storage_class")))
    before = before.select(*keys, F.col("storage_lo_usd").alias("old_usd"))
    after = tier_cost_estimate(before.withColumn("storage_class", F.col("new_class")))
    return after.select(*keys, "old_usd", F.col("storage_lo_usd").alias("new_usd"))


def tier_change_entries(plan: DataFrame, catalogue: DataFrame, timestamp: str) -> DataFrame:
    """Catalogue rows to upsert once a planned change was carried out: one for each changed archive."""
    changed = plan.where("decision = 'change'").select(F.col("archive").alias(KEY), F.col("new_class").alias("_class"))
    return (catalogue.join(changed, KEY)
            .withColumns({"s3_storage_class": F.col("_class"), "timestamp": F.lit(timestamp)}).drop("_class"))


def archive_commit(uploaded: DataFrame, src: DataFrame, objects: DataFrame, target: Target, timestamp: str,
                   roots: DataFrame | None = None) -> DataFrame:
    """Catalogue rows for what was uploaded (folder, destination) and passes its checksums there.

    A single archive is recorded if it matches. ``roots`` (folder, destination) are recursive archives:
    each is recorded only if no folder below it fails and at least one matches.
    """
    uploaded = kept(uploaded.select("folder", "destination"), "uploaded")  # known to be small before files meet it
    checks = uploaded.join(folder_checks(src, objects, uploaded), "folder", "left").select(
        "folder", "destination", F.coalesce("has_manifest", F.lit(False)).alias("has_manifest"),
        F.coalesce("ok", F.lit(False)).alias("ok"))
    if roots is None:
        return catalogue_entries(checks.where("has_manifest and ok"), target, "Single", timestamp)
    below = (checks.select(F.explode(ancestors(F.col("folder"))).alias("folder"), "has_manifest", "ok")
             .groupBy("folder").agg(F.count_if(F.expr("has_manifest and ok")).alias("good"),
                                    F.count_if(F.expr("has_manifest and not ok")).alias("bad")))
    done = roots.join(below.where("good > 0 and bad = 0").select("folder"), "folder", "left_semi")
    return catalogue_entries(done, target, "Recursive", timestamp)


def restore_verified(restored: DataFrame, fetched: DataFrame, objects: DataFrame,
                     bundle_name: str = META.bundle) -> DataFrame:
    """Next step of each restored folder (folder, source), judged by the digests of what was fetched.

    ``fetched`` has folder, name, md5 of the files that arrived. mismatch: fetch again; unbundle: files are
    packed; done: the note about the move can go; nothing: no file arrived and none should have.
    """
    places = restored.select("folder", F.col("source").alias("destination"))
    compared = verify_archives(fetched, objects, places)
    counts = compared.groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") != "match").alias("failed"),
        F.bool_or(F.col("name") == bundle_name).alias("packed"))
    step = (F.when(F.col("files").isNull(), F.lit("nothing")).when(F.col("failed") > 0, F.lit("mismatch"))
            .when(F.col("packed"), F.lit("unbundle")).otherwise(F.lit("done")))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return restored.join(counts, "folder", "left").select(
        "folder", "source", number("files"), number("failed"), step.alias("step"))


def pick_and_batch(hotspot_rows: DataFrame, command: str, larger: float = 0, older: int = 0,
                   newer: int = 0, by: str = "accd", per_batch: int = 500) -> DataFrame:
    """Select old and large folders and write the commands that archive them."""
    return archive_batch(pick(hotspot_rows, larger, older, newer, by), command, per_batch)
