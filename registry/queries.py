"""One registered query per operator; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldledger.constants import META
from coldledger.functions import paths, units
from coldledger.functions import text
from coldledger.functions.objects import location as object_location
from coldledger.operators import (
    activity, bundle, capacity, catalogue as cat, entitlements as ent, inventory as inv, objects as obj,
    ownership, permissions as perm, reports, search, verify)
from coldledger.plans import archive as jobs
from coldledger.plans import index
from coldledger.session import kept, work_dir
from coldledger.sinks import catalogue as cat_sink, listing as listing_sink, reports as sink
from coldledger.sources import catalogue as cat_src, crawl as crawl_src, grants as grant_src, text as text_src
from coldledger.streaming import jobs as stream
from registry import views as v

AGED_AS_OF = "2011-10-26 00:00:00"
USER_ID, USER_GROUPS = 7, [1, 2, 3, 4, 5]
COST_DAY = date(1998, 6, 15)
ROOTS = ("/AFRICA", "/AMERICA", "/ASIA", "/EUROPE", "/MIDDLE EAST")
TARGET = jobs.Target("bkt", "arch", "DEEP_ARCHIVE", user="me")

Query = Callable[[SparkSession, str], DataFrame]


# Folder inventory


def folder_ages(spark: SparkSession, sf: str, as_of: str = v.AS_OF) -> DataFrame:
    """Folders with sizes in units and ages, before any threshold."""
    found = v.files(spark, sf).groupBy("folder").agg(
        F.count(F.lit(1)).alias("fcount"), F.sum("size").alias("dirsum"),
        F.max("atime").alias("atime"), F.max("mtime").alias("mtime"))
    return inv.size_units(found).withColumns({
        "accd": units.days_ago(F.col("atime"), as_of), "modd": units.days_ago(F.col("mtime"), as_of)})


def hotspots(spark: SparkSession, sf: str, min_gib: float | None = None, as_of: str = v.AS_OF) -> DataFrame:
    return inv.hotspots(folder_ages(spark, sf, as_of), min_gib).select(
        "folder", "fcount", "dirsum", "gib", "tib", "mib_avg", "accd", "modd")


def hotspots_selective(spark: SparkSession, sf: str) -> DataFrame:
    return hotspots(spark, sf, 10)


def folder_rows(spark: SparkSession, sf: str) -> DataFrame:
    return inv.folder_rows(v.crawl(spark, sf)).select("filename", "UID", "GID", "pw_fcount", "pw_dirsum")


def hotspot_base(spark: SparkSession, sf: str) -> DataFrame:
    base = inv.hotspot_base(v.crawl(spark, sf))
    return base.select("folder", "uid", "gid", "atime", "mtime", "fcount", "dirsum",
                       *[F.round(c, 6).alias(c) for c in ("gib", "tib", "mib_avg")])


def folder_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return inv.folder_rollup(v.files(spark, sf))


def recursive_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return inv.recursive_rollup(v.files(spark, sf))


def newest_times(spark: SparkSession, sf: str) -> DataFrame:
    own = v.folders(spark, sf).selectExpr(
        "folder", "timestamp_ntz'1999-01-01 00:00:00' AS atime", "timestamp_ntz'1998-01-01 00:00:00' AS mtime")
    return inv.newest_times(v.local_files(spark, sf), own)


def index_summary(spark: SparkSession, sf: str) -> DataFrame:
    ages = folder_ages(spark, sf)
    return inv.index_summary(ages, inv.hotspots(ages, 10))


def aged_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return inv.aged_bytes(hotspots(spark, sf, as_of=AGED_AS_OF))


def aged_bytes_report(spark: SparkSession, sf: str) -> DataFrame:
    return inv.aged_bytes_report(aged_bytes(spark, sf))


def pick_old_large(spark: SparkSession, sf: str) -> DataFrame:
    return inv.pick(hotspots(spark, sf), larger=9, older=64)


def pick_newer(spark: SparkSession, sf: str) -> DataFrame:
    return inv.pick(hotspots(spark, sf), newer=62, by="modd")


def top_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return inv.top_hotspots(hotspots(spark, sf), 20)


def non_meta_files(spark: SparkSession, sf: str) -> DataFrame:
    return inv.non_meta(v.local_files(spark, sf)).select("folder", "name", "size")


def skip_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    found = v.all_files(spark, sf).selectExpr(
        "CASE WHEN qty = 2 THEN concat(folder, '/.snapshot/weekly') ELSE folder END AS folder", "name", "size")
    return inv.skip_snapshots(found)


def files_and_links(spark: SparkSession, sf: str) -> DataFrame:
    return inv.files_and_links(v.crawl(spark, sf)).select("filename", "type", "st_size")


def crawl_errors(spark: SparkSession, sf: str) -> DataFrame:
    lines = v.table(spark, sf, "events").selectExpr(
        "user_id AS source", "event_id AS pos",
        "CASE event_type WHEN 'error' THEN concat('Locked Dir: /data/', event_id) "
        "WHEN 'purchase' THEN concat('opendir /data/', event_id, ': Permission denied') "
        "ELSE concat('read ', event_id) END AS line")
    return inv.crawl_errors(lines)


def multi_root_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = inv.folder_rollup(v.files(spark, sf))
    return inv.multi_root_union({r: rows.where(paths.is_under(F.col("folder"), F.lit(r))) for r in ROOTS})


# Ownership and permissions


def resolve_owner(spark: SparkSession, sf: str) -> DataFrame:
    named = ownership.resolve_owner(v.files(spark, sf), v.users(spark, sf), v.groups(spark, sf))
    return named.select("folder", "name", "owner", "group_name")


def rw_permissions(spark: SparkSession, sf: str) -> DataFrame:
    flags = ["is_owner", "is_group_member", "owner_read", "owner_write", "group_read", "group_write",
             "is_444", "is_666_or_777", "can_read", "can_write"]
    return perm.rw_permissions(v.files(spark, sf), USER_ID, USER_GROUPS).select("folder", "name", *flags)


def folder_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Folder rows of the crawl as a permission table; /ASIA was removed since."""
    return inv.folder_rows(v.crawl(spark, sf)).where("root <> '/ASIA'").selectExpr(
        "filename AS folder", "st_mode AS mode", "UID AS uid", "GID AS gid")


def writable_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return perm.writable_hotspots(hotspots(spark, sf), folder_stats(spark, sf), USER_ID, USER_GROUPS)


def folder_permission_ok(spark: SparkSession, sf: str) -> DataFrame:
    found = v.all_files(spark, sf).selectExpr(
        "folder", "CASE WHEN bal > 2000 THEN 33206 ELSE mode END AS mode", "uid", "gid")
    roots = v.folders(spark, sf)
    direct = perm.folder_permission_ok(found, roots, USER_ID, USER_GROUPS)
    deep = perm.folder_permission_ok(found, roots, USER_ID, USER_GROUPS, recursive=True)
    return direct.withColumnRenamed("ok", "direct_ok").join(deep.withColumnRenamed("ok", "recursive_ok"), "folder")


def entitlements(spark: SparkSession, sf: str) -> DataFrame:
    return ent.entitlements(v.principals(spark, sf), v.policies(spark, sf)).select(
        "principal", "resource", F.array_join("options", ",").alias("options"))


def entitlement_policies(spark: SparkSession, sf: str) -> DataFrame:
    return ent.open_policies(v.principals(spark, sf), v.policies(spark, sf)).select(
        "resource", "rule", F.array_join("names", ",").alias("names"), "principals", "excluded")


def entitlement_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return ent.exceptions(v.principals(spark, sf), v.policies(spark, sf))


def folder_permission_tree(spark: SparkSession, sf: str) -> DataFrame:
    return perm.folder_permission_tree(v.crawl(spark, sf), v.folders(spark, sf), USER_ID, USER_GROUPS)


# Catalogue


def catalogue_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return cat.catalogue_lookup(v.folders(spark, sf), v.catalogue(spark, sf)).select(
        "folder", "matched_folder", "match", "archive_mode", "s3_storage_class")


def path_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    listed = v.folders(spark, sf).unionByName(
        v.page_paths(spark, sf).select(paths.clean_path(F.col("path")).alias("folder")))
    return cat.path_overlaps(listed)


def destination_paths(spark: SparkSession, sf: str) -> DataFrame:
    return cat.destination_paths(v.folders(spark, sf), v.catalogue(spark, sf), "bkt2", "new")


def new_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A later tier change of all GLACIER archives and a first archive of poor suppliers."""
    known = v.catalogue(spark, sf)
    changed = known.where("s3_storage_class = 'GLACIER'").withColumns({
        "s3_storage_class": F.lit("STANDARD_IA"), "timestamp": F.lit("2023-01-01T00:00:00"),
        "folder_key": F.concat("folder_key", F.lit("/"))})
    first = jobs.catalogue_entries(
        v.supplier_folders(spark, sf).where("bal < 3000").select(
            "folder", F.concat(F.lit(":s3:bkt/arch"), "folder").alias("destination")),
        TARGET, "Single", "2023-02-01T00:00:00")
    return changed.unionByName(first)


CATALOGUE_OUT = ("folder_key", "archive_folder", "s3_storage_class", "archive_mode", "timestamp", "user")


def catalogue_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return cat.catalogue_upsert(v.catalogue(spark, sf), new_entries(spark, sf)).select(*CATALOGUE_OUT)


def catalogue_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    root = work_dir(spark, "catalogue")
    cat_sink.write_snapshot(v.catalogue(spark, sf), root, 1)
    cat_sink.upsert_snapshot(spark, root, new_entries(spark, sf))
    return cat_sink.read_snapshot(spark, root).select(*CATALOGUE_OUT)


def catalogue_export(spark: SparkSession, sf: str) -> DataFrame:
    return cat.catalogue_export(
        v.catalogue(spark, sf), ["local_folder", "s3_storage_class", "no_such_column", "archive_mode", "timestamp"])


def unarchived_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return cat.unarchived_hotspots(hotspots(spark, sf), v.catalogue(spark, sf))


# Verification and plans


def verify_checksums(spark: SparkSession, sf: str) -> DataFrame:
    return _verification(spark, sf).select("folder", "name", "status")


def _verification(spark: SparkSession, sf: str) -> DataFrame:
    places = cat.catalogue_lookup(v.folders(spark, sf), v.catalogue(spark, sf))
    return verify.verify_archives(v.src_manifest(spark, sf), v.listing(spark, sf), places)


def verified_folders(spark: SparkSession, sf: str) -> DataFrame:
    return verify.verified_folders(_verification(spark, sf))


def archive_state(spark: SparkSession, sf: str) -> DataFrame:
    return verify.archive_state(
        v.folders(spark, sf), v.catalogue(spark, sf), v.src_manifest(spark, sf), v.listing(spark, sf))


def store_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The listing written anew by place and name, and what it holds at each place."""
    stored = listing_sink.store_listing(v.objects(spark, sf), "listing_written")
    return listing_sink.place_summary(stored)


def folders_with_content(spark: SparkSession, sf: str) -> DataFrame:
    return verify.folders_with_content(v.folders(spark, sf), v.local_files(spark, sf))


def folders_skipped(spark: SparkSession, sf: str) -> DataFrame:
    return verify.folders_skipped(v.folders(spark, sf), v.local_files(spark, sf))


def _delete_plan(spark: SparkSession, sf: str) -> DataFrame:
    restored = v.all_files(spark, sf).where("flag = 'A' AND bal >= 500 AND bal < 1000").selectExpr(
        "folder", "name", "md5(concat(folder, '/', name, ':', size)) AS md5")
    return verify.delete_plan(
        v.folders(spark, sf), v.catalogue(spark, sf), v.src_manifest(spark, sf), v.listing(spark, sf),
        v.local_files(spark, sf), restored)


def delete_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _delete_plan(spark, sf).select("folder", "decision", "destination", "files", "bytes")


def deletion_report(spark: SparkSession, sf: str) -> DataFrame:
    # The plan is used twice, so it is stored once instead of being verified twice.
    path = work_dir(spark, "delete-plan")
    _delete_plan(spark, sf).write.parquet(path)
    return reports.deletion_report(spark.read.parquet(path), v.local_files(spark, sf), "coldledger restore")


def restore_plan(spark: SparkSession, sf: str) -> DataFrame:
    return verify.restore_plan(v.folders(spark, sf), v.catalogue(spark, sf), v.local_files(spark, sf))


def restore_job(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.restore_job(
        v.folders(spark, sf), v.catalogue(spark, sf), v.local_files(spark, sf), v.listing(spark, sf), "Expedited")


def archive_plan(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.archive_plan(
        v.folders(spark, sf), v.local_files(spark, sf), v.catalogue(spark, sf), v.src_manifest(spark, sf),
        v.listing(spark, sf), TARGET, kib=20 * 1024)


def rearchive_plan(spark: SparkSession, sf: str) -> DataFrame:
    """All folders archived by force; some files on disk were altered since, some are gone."""
    local = v.local_files(spark, sf).where("uid % 90 <> 4").selectExpr(
        "folder", "name", "size",
        "md5(concat(folder, '/', name, ':', size, CASE WHEN uid % 40 = 3 THEN '!' ELSE '' END)) AS md5")
    return jobs.rearchive_plan(
        v.folders(spark, sf), local, v.catalogue(spark, sf), v.src_manifest(spark, sf), v.listing(spark, sf))


def _uploaded(spark: SparkSession, sf: str) -> DataFrame:
    return v.folders(spark, sf).select("folder", F.concat(F.lit(":s3:bkt/arch"), "folder").alias("destination"))


def archive_commit(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of all folders whose upload to bkt/arch passes its checksums."""
    entries = jobs.archive_commit(
        _uploaded(spark, sf), v.src_manifest(spark, sf), v.listing(spark, sf), TARGET, "2024-06-01T00:00:00")
    return entries.select(*CATALOGUE_OUT)


def archive_commit_recursive(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as recursive archives, recorded only if nothing below them fails."""
    uploaded = _uploaded(spark, sf)
    entries = jobs.archive_commit(
        uploaded, v.src_manifest(spark, sf), v.listing(spark, sf), TARGET, "2024-06-01T00:00:00",
        roots=uploaded.where(paths.depth(F.col("folder")) >= 2))
    return entries.select(*CATALOGUE_OUT)


def restore_verified(spark: SparkSession, sf: str) -> DataFrame:
    """Restored folders against their archive; a few files arrived altered, some bundles came along."""
    plan = restore_plan(spark, sf).where("source IS NOT NULL")
    fetched = v.all_files(spark, sf).where("flag = 'A'").selectExpr(
        "folder", "name", "md5(concat(folder, '/', name, ':', size, CASE WHEN uid % 50 = 7 THEN '?' ELSE '' END)) AS md5")
    lists = v.supplier_folders(spark, sf).where("bal >= 0").selectExpr(
        "folder", f"'{META.manifest}' AS name", "md5(folder) AS md5")
    return jobs.restore_verified(plan, fetched.unionByName(lists), v.listing(spark, sf), bundle_name=META.manifest)


def content_md5(spark: SparkSession, sf: str) -> DataFrame:
    return verify.content_md5(v.content_files(spark, sf))


# Objects


def scan_objects_prefix(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "objects")
    v.objects(spark, sf).write.mode("overwrite").parquet(path)
    return cat_src.read_objects(spark, path, "arch/AFRICA").select("bucket", "key", "size", "storage_class")


def direct_children(spark: SparkSession, sf: str) -> DataFrame:
    return cat_src.direct_children(v.objects(spark, sf), "arch/AFRICA/").select("bucket", "key", "size")


def _prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return v.folders(spark, sf).select(F.concat(F.lit(":s3:bkt/arch"), "folder").alias("location"))


def prefix_size(spark: SparkSession, sf: str) -> DataFrame:
    return obj.prefix_size(v.objects(spark, sf), _prefixes(spark, sf))


def prefix_size_direct(spark: SparkSession, sf: str) -> DataFrame:
    return obj.prefix_size(v.objects(spark, sf), _prefixes(spark, sf), recursive=False)


def restore_status(spark: SparkSession, sf: str) -> DataFrame:
    return obj.restore_status(v.objects(spark, sf), "Expedited").select("key", "state")


def restore_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return obj.restore_status_counts(v.objects(spark, sf))


def restore_readiness(spark: SparkSession, sf: str) -> DataFrame:
    return obj.restore_readiness(obj.restore_status_counts(v.objects(spark, sf))).select(
        "location", "pending", "progress")


def restore_watch(spark: SparkSession, sf: str) -> DataFrame:
    """Folders whose retrieval is under way, at which options and until when."""
    asked = v.listing(spark, sf).withColumns({
        "restore_tier": F.expr("element_at(array('Bulk', 'Standard', 'Expedited'), CAST(size % 3 + 1 AS INT))"),
        "restore_requested": F.expr("timestamp_ntz'2001-12-01 00:00:00' + make_dt_interval(0, 0, 0, size % 100000)")})
    return jobs.restore_watch(v.folders(spark, sf), v.catalogue(spark, sf), asked)


def tier_change_plan(spark: SparkSession, sf: str) -> DataFrame:
    return obj.tier_change_plan(v.folders(spark, sf), v.catalogue(spark, sf), v.objects(spark, sf), "GLACIER_IR")


def tier_change_job(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.tier_change_job(v.folders(spark, sf), v.catalogue(spark, sf), v.objects(spark, sf), "GLACIER_IR")


def tier_change_update(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue after the planned changes were carried out."""
    known = v.catalogue(spark, sf)
    entries = jobs.tier_change_entries(tier_change_plan(spark, sf), known, "2024-05-01T00:00:00")
    return cat.catalogue_upsert(known, entries).select(*CATALOGUE_OUT)


def tier_cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    sizes = v.objects(spark, sf).groupBy(
        object_location(F.col("bucket"), F.col("key")).alias("location"), "storage_class").agg(F.sum("size").alias("bytes"))
    return obj.tier_cost_estimate(sizes, "Expedited").withColumn("hours_hi", F.round("hours_hi", 4))


def best_fit_capacity(spark: SparkSession, sf: str) -> DataFrame:
    needs = inv.folder_rollup(v.files(spark, sf)).select("folder", units.to_gib(F.col("dirsum"), 2).alias("need"))
    return capacity.best_fit_capacity(needs)


# Small files


def classify_small(spark: SparkSession, sf: str) -> DataFrame:
    return bundle.classify_small(v.files(spark, sf)).select("folder", "name", "size", "tarred")


def small_file_plan(spark: SparkSession, sf: str) -> DataFrame:
    return bundle.small_file_plan(v.local_files(spark, sf), kib=20 * 1024)


def _bundles(spark: SparkSession, sf: str) -> DataFrame:
    return bundle.bundle_small(v.content_files(spark, sf), kib=1, target_bytes=2048)


def bundle_small(spark: SparkSession, sf: str) -> DataFrame:
    return _bundles(spark, sf).select(
        "folder", "bundle", "files", "bytes", F.array_join(F.col("entries.name"), ",").alias("names"),
        F.md5(F.array_join(F.col("entries.content"), "")).alias("digest"))


def unbundle_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return bundle.unbundle(_bundles(spark, sf)).select("folder", "name", "size", F.md5("content").alias("md5"))


# Reports


def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return reports.file_manifest(v.local_files(spark, sf), v.users(spark, sf), v.groups(spark, sf))


def archive_batch(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.pick_and_batch(hotspots(spark, sf), "coldledger archive", larger=9, older=60, per_batch=10)


def cost_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.cost_report(v.cost_lines(spark, sf), COST_DAY)


def transfer_errors(spark: SparkSession, sf: str) -> DataFrame:
    lines = v.transfer_lines_of(v.table(spark, sf, "events"))
    return reports.transfer_errors(text_src.parse_transfer_log(lines))


# Scalar functions


def days_ago(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "events").select(
        "event_id", units.days_ago(F.col("ts"), "2024-01-15 12:00:00").alias("days"))


def human_size(spark: SparkSession, sf: str) -> DataFrame:
    powers = F.pow(F.lit(10), F.col("l_linenumber"))
    return v.table(spark, sf, "lineitem").select(
        (F.col("l_extendedprice") * powers).cast("long").alias("size")).withColumn(
        "text", units.human_size(F.col("size"))).distinct()


def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat("folder", F.lit("/"), "name")
    return v.files(spark, sf).select(
        path.alias("path"), paths.basename(path).alias("base"), paths.parent(path).alias("parent"),
        paths.depth(path).alias("depth"))


def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return v.page_paths(spark, sf).select("page_id", F.posexplode(paths.ancestors(F.col("path"))).alias("pos", "ancestor"))


def clean_paths(spark: SparkSession, sf: str) -> DataFrame:
    return v.page_paths(spark, sf).select(
        "page_id", paths.clean_path(F.col("path")).alias("path"))


def report_slug(spark: SparkSession, sf: str) -> DataFrame:
    # The page text gives some paths that are longer than a file name may be.
    long_path = F.concat("url", F.lit("/"), F.regexp_replace("html", "[^a-z]", ""))
    return v.table(spark, sf, "pages").select(
        "page_id", paths.report_slug(F.col("url")).alias("slug"),
        paths.report_slug(long_path, shorten=True).alias("short_slug"))


def parse_destination(spark: SparkSession, sf: str) -> DataFrame:
    uri = F.concat(F.lit(":s3:bkt/arch"), "folder")
    return v.folders(spark, sf).select(
        "folder", paths.destination_bucket(uri).alias("bucket"), paths.destination_prefix(uri).alias("prefix"),
        paths.build_destination(F.lit("b"), F.lit("d"), F.col("folder")).alias("built"))


def clean_search(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = text.clean_search(F.col("text"))
    return v.table(spark, sf, "documents").select(
        "doc_id", F.md5(cleaned).alias("digest"), F.length(cleaned).cast("long").alias("chars"),
        text.is_number(F.col("n_chars").cast("string")).alias("chars_is_number"), text.is_number(F.col("source")).alias("is_number"))


# Search and deduplication


def scan_grants(spark: SparkSession, sf: str) -> DataFrame:
    found = grant_src.parse_grants(v.grant_lines(spark, sf)).drop("text")
    return found.withColumn("pi_profile_ids", F.array_join("pi_profile_ids", ","))


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return search.dedup_first(scan_grants(spark, sf), "project_num", "seq").select(
        "project_num", "seq", "contact_pi_name", "project_title")


def _search(spark: SparkSession, sf: str, query: str) -> DataFrame:
    return search.cascade_search(grant_src.parse_grants(v.grant_lines(spark, sf)), query)


def cascade_search(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "SRC3, en")


def cascade_search_org(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "fr institute")


def cascade_search_project(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "en-src3-5")


def cascade_search_text(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "the 1")


def cascade_search_blank(spark: SparkSession, sf: str) -> DataFrame:
    """Punctuation only: no words, no hits."""
    return _search(spark, sf, ", :")


# Activity


def idle_streak(spark: SparkSession, sf: str) -> DataFrame:
    return activity.idle_streak(v.heartbeats(spark, sf), 5)


def io_rates(spark: SparkSession, sf: str) -> DataFrame:
    return activity.io_rates(v.io_counters(spark, sf))


def activity_windows(spark: SparkSession, sf: str) -> DataFrame:
    return activity.activity_windows(v.samples_of(v.table(spark, sf, "events")))


def restore_state(spark: SparkSession, sf: str) -> DataFrame:
    return stream.restore_events_state(v.restore_events_of(v.table(spark, sf, "events")))


# Scans and sinks: data is derived, written to the shared folder and read back


def _with_broken(rows: DataFrame) -> DataFrame:
    """Each folder's line a second time with a UID that does not parse; the crawl is made once for both."""
    return rows.withColumn("UID", F.explode(
        F.when(F.col("type") == "d", F.array(F.col("UID"), F.lit("not a number"))).otherwise(F.array("UID"))))


def scan_crawl_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Latin-1 CSV with lines that do not parse, as a crawler may leave them."""
    path = work_dir(spark, "crawl-csv")
    names = [f.name for f in crawl_src.CRAWL.fields]
    rows = v.crawl(spark, sf).withColumn("filename", F.concat("filename", F.lit("_é"))).select(
        *[F.col(n).cast("string").alias(n) for n in names])
    _with_broken(rows).write.option("encoding", "ISO-8859-1").option("header", "true").csv(path)
    return crawl_src.good_rows(crawl_src.read_crawl_csv(spark, path)).select(
        "filename", "UID", "GID", "st_atime", "pw_fcount", "pw_dirsum", "type")


def scan_crawl_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "crawl-csv")
    names = [f.name for f in crawl_src.CRAWL.fields]
    rows = v.crawl(spark, sf).select(*[F.col(n).cast("string").alias(n) for n in names])
    _with_broken(rows).write.option("header", "true").csv(path)
    return crawl_src.bad_lines(crawl_src.read_crawl_csv(spark, path, "UTF-8"))


def _index(spark: SparkSession, sf: str):
    return index.index_job(v.crawl(spark, sf), v.users(spark, sf), v.groups(spark, sf), v.AS_OF)


def index_job(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).report


def index_job_locked(spark: SparkSession, sf: str) -> DataFrame:
    """Hotspots of a crawl that could not enter some folders."""
    return index.index_job(v.crawl(spark, sf), v.users(spark, sf), v.groups(spark, sf), v.AS_OF,
                           errors=v.crawl_lines(spark, sf)).report.select("Folder", "FileCount", "DirSize", "Complete")


def index_roots(spark: SparkSession, sf: str) -> DataFrame:
    # Kept by root, so that each root's crawl is read from its own directory and not made anew.
    made, path = v.crawl(spark, sf), work_dir(spark, "crawl")
    sink.write_crawl(made, path)
    crawled = spark.read.schema(made.schema).parquet(path)
    return index.index_roots(
        {r: crawled.where(F.col("root") == r).drop("root") for r in ROOTS},
        v.users(spark, sf), v.groups(spark, sf), v.AS_OF, min_gib=9).report


def index_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).summary


def scan_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "report")
    sink.write_hotspots(index_job(spark, sf), path)
    return crawl_src.read_hotspots(spark, path)


def _stored_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report, made once for several writers; each of them sorts its rows anew."""
    return kept(index_job(spark, sf), "report").orderBy(F.desc("DirSize"), "Folder")


def sink_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """A second write without force keeps the first report; with force it replaces it."""
    path = work_dir(spark, "report")
    report = _stored_report(spark, sf)
    sink.write_hotspots(report.where("GiB >= 10"), path)
    sink.write_hotspots(report, path)
    kept = crawl_src.read_hotspots(spark, path).groupBy().agg(F.count(F.lit(1)).alias("kept_rows"))
    copy = work_dir(spark, "report")
    kept.write.parquet(copy)
    sink.write_hotspots(report, path, force=True)
    after = crawl_src.read_hotspots(spark, path).groupBy().agg(F.count(F.lit(1)).alias("forced_rows"))
    return spark.read.parquet(copy).select("kept_rows", after.scalar().alias("forced_rows"))


def sink_user_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    source, path = work_dir(spark, "report"), work_dir(spark, "user-report")
    sink.write_hotspots(index_job(spark, sf), source)
    stats = folder_stats(spark, sf)
    sink.write_user_hotspots(spark, source, path, stats, USER_ID, USER_GROUPS)
    sink.write_user_hotspots(spark, source, path, stats, USER_ID, USER_GROUPS)
    return crawl_src.read_hotspots(spark, path)


def sink_crawl(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "crawl")
    sink.write_crawl(v.crawl(spark, sf), path)
    return spark.read.parquet(path).groupBy("root", "type").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("st_size").alias("bytes"))


def sink_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "manifest")
    sink.write_manifest(file_manifest(spark, sf), path)
    return crawl_src.read_manifest(spark, path).groupBy("folder").agg(
        F.count(F.lit(1)).alias("files"), F.sum("Size(bytes)").alias("bytes"))


def scan_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "manifest")
    sink.write_manifest(file_manifest(spark, sf), path)
    return crawl_src.read_manifest(spark, path)


def sink_md5_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The lines as they are on storage."""
    path = work_dir(spark, "md5")
    digests = verify.md5_manifest(v.src_manifest(spark, sf))
    sink.write_md5_manifest(digests, v.folders(spark, sf, 1000), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def scan_md5_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "md5")
    digests = verify.md5_manifest(v.src_manifest(spark, sf))
    sink.write_md5_manifest(digests, digests.select("folder"), path)
    return text_src.read_md5_manifest(spark, path)


def scan_catalogue_json(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "catalogue-json")
    cat_sink.write_catalogue_json(v.catalogue(spark, sf), path)
    return cat_src.read_catalogue_json(spark, path).select(*CATALOGUE_OUT)


def parse_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of which some are cut off; those must not add rows."""
    record = F.struct(*[c for c in v.catalogue(spark, sf).columns if c != "folder_key"])
    lines = v.catalogue(spark, sf).select(F.to_json(F.create_map(F.col("folder_key"), record)).alias("value"))
    cut = lines.select(F.left("value", F.length("value") - 5).alias("value"))
    return cat_src.parse_catalogue(lines.unionByName(cut)).select(*CATALOGUE_OUT)


def sink_catalogue_export(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "catalogue-csv")
    cat_sink.write_catalogue_export(v.catalogue(spark, sf), path, ["local_folder", "timestamp", "missing"])
    return spark.read.schema("local_folder string, timestamp string").option("header", "true").csv(path)


def scan_transfer_log(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "transfer-log")
    v.transfer_lines_of(v.table(spark, sf, "events")).select("line").write.text(path)
    return text_src.read_transfer_log(spark, path).select(
        "kind", "msg", F.col("stats.bytes").alias("bytes"), F.col("stats.lastError").alias("last_error"))


def scan_key_value(spark: SparkSession, sf: str) -> DataFrame:
    lines = v.table(spark, sf, "part").selectExpr(
        "concat('Brand=old Part=', p_partkey, ' Brand=', p_brand, '  Expr=a=', p_size, ' Type=', p_type) AS line")
    kv = text_src.parse_key_values(F.col("line"))
    kv, parsed = F.col("kv"), lines.select(kv.alias("kv"))
    return parsed.select(kv["Part"].cast("long").alias("part"), kv["Brand"].alias("brand"),
                         kv["Expr"].alias("expr"), kv["Type"].alias("type"))


def scan_delimited(spark: SparkSession, sf: str) -> DataFrame:
    lines = v.table(spark, sf, "customer").selectExpr(
        "concat(c_custkey, '| \"', c_name, '|x\"| ', c_mktsegment) AS line")
    row = text_src.parse_delimited(F.col("line"), "id BIGINT, name STRING, segment STRING")
    return lines.select(row.alias("r")).select("r.id", "r.name", "r.segment")


def report_listing(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "reports")
    report = _stored_report(spark, sf)
    for root in ROOTS:
        rows = report.where(paths.is_under(F.col("Folder"), F.lit(root)))
        sink.write_hotspots(rows, f"{path}/{root.replace('/', '+')}.csv")
    newest_first = Window.orderBy(F.desc("mtime"), "report")  # one row per report
    return crawl_src.read_report_listing(spark, path).select("report", "rows", F.row_number().over(newest_first).alias("place"))


def sink_deletion_notes(spark: SparkSession, sf: str) -> DataFrame:
    path = work_dir(spark, "notes")
    sink.write_deletion_notes(deletion_report(spark, sf), path)
    return spark.read.schema("folder string, note string").option("recursiveFileLookup", "true").json(path)


# Streams: the given table is the file source; the result equals the batch twin


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return (spark.readStream.schema(v.SCHEMAS[name])
            .option("pathGlobFilter", f"{name}.parquet").parquet(sf))


def _with_instant(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_idle_streak(spark: SparkSession, sf: str) -> DataFrame:
    return stream.stream_idle_streak(
        v.heartbeats_of(_stream(spark, sf, "events")), work_dir(spark, "idle"), work_dir(spark, "idle-progress"), 5)


def stream_activity(spark: SparkSession, sf: str) -> DataFrame:
    samples = v.samples_of(_with_instant(_stream(spark, sf, "events")))
    out = stream.stream_activity(samples, work_dir(spark, "activity"), work_dir(spark, "activity-progress"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_restore_state(spark: SparkSession, sf: str) -> DataFrame:
    events = v.restore_events_of(_with_instant(_stream(spark, sf, "events")))
    return stream.stream_restore_state(events, work_dir(spark, "restore"), work_dir(spark, "restore-progress"))


def stream_folder_rollup(spark: SparkSession, sf: str) -> DataFrame:
    arriving = v.joined_files(_stream(spark, sf, "lineitem"), spark, sf)
    return stream.stream_folder_rollup(arriving, work_dir(spark, "rollup"), work_dir(spark, "rollup-progress"))


_HELPERS = {"folder_ages", "folder_stats", "new_entries", "registered"}


def registered() -> dict[str, Query]:
    """All query functions of this module by name."""
    return {name: fn for name, fn in globals().items()
            if not name.startswith("_") and name not in _HELPERS and getattr(fn, "__module__", "") == __name__}
