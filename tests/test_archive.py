from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from coldledger.constants import META
from coldledger.operators import bundle, catalogue as cat, objects as obj, reports, verify
from coldledger.plans import archive as jobs
from coldledger.sinks import catalogue as cat_sink, listing as listing_sink
from coldledger.sources import catalogue as cat_src

KEYS = "folder_key string, local_folder string, archive_folder string, s3_storage_class string, profile string, " \
       "provider string, endpoint string, archive_mode string, timestamp string, timestamp_archive string, user string"


def entry(folder, mode="Single", cls="GLACIER", ts="2024-01-01T00:00:00", dest=None):
    return (folder, folder, dest or ":s3:b/arch" + folder, cls, "p", "AWS", "", mode, ts, ts, "me")


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame([
        entry("/s"), entry("/r", "Recursive"), entry("/r/deep", "Recursive"), entry("/r/deep/one", "Single"), entry("/a/b", "Recursive")],
        KEYS)


OBJECTS = "bucket string, key string, md5 string"


def objects_of(spark, rows, top="arch"):
    """Objects where the catalogue and the target of these tests place a folder's archive."""
    return spark.createDataFrame([("b", top + folder + "/" + name, md5) for folder, name, md5 in rows], OBJECTS)


def folders_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "folder string")


def test_lookup_decisions(spark, catalogue):
    found = cat.catalogue_lookup(
        folders_of(spark, "/s", "/s/x", "/r", "/r/x", "/r/deep/x/y", "/r/deep/one", "/r/deep/one/z", "/a/bc", "/a/b/c", "/"),
        catalogue)
    got = {r.folder: (r.match, r.matched_folder) for r in found.collect()}
    assert got == {
        "/s": ("exact", "/s"), "/s/x": ("none", None), "/r": ("exact", "/r"), "/r/x": ("ancestor", "/r"),
        "/r/deep/x/y": ("ancestor", "/r/deep"), "/r/deep/one": ("exact", "/r/deep/one"),
        "/r/deep/one/z": ("ancestor", "/r/deep"), "/a/bc": ("none", None), "/a/b/c": ("ancestor", "/a/b"), "/": ("none", None)}


def test_root_in_the_catalogue_covers_everything(spark):
    root = spark.createDataFrame([entry("/", "Recursive")], KEYS)
    assert cat.catalogue_lookup(folders_of(spark, "/x/y"), root).first().match == "ancestor"


paths_strategy = st.lists(
    st.lists(st.sampled_from(["a", "b", "ab"]), min_size=1, max_size=3).map(lambda p: "/" + "/".join(p)), min_size=1, max_size=7)


@settings(max_examples=8, deadline=None)
@given(paths_strategy)
def test_overlaps_brute_force(spark, listed):
    got = {(r.ancestor, r.folder) for r in cat.path_overlaps(folders_of(spark, *listed)).collect()}
    want = set()
    for i, x in enumerate(listed):
        for y in listed[i + 1:]:
            for top, low in ((x, y), (y, x)):
                if os.path.commonpath([top, low]) == top:
                    want.add((top, low))
    assert got == want


def test_upsert_is_idempotent_and_last_write_wins(spark, catalogue):
    new = spark.createDataFrame([entry("/s/", cls="STANDARD_IA", ts="2023-01-01T00:00:00"), entry("/new")], KEYS)
    once = cat.catalogue_upsert(catalogue, new)
    twice = cat.catalogue_upsert(once, new)
    listed = lambda df: sorted(map(tuple, df.select(*catalogue.columns).collect()))
    assert listed(once) == listed(twice)
    assert once.count() == 6 and once.where("folder_key = '/s'").first().s3_storage_class == "STANDARD_IA"


def test_snapshot_versions(spark, catalogue, tmp_path):
    root = str(tmp_path / "cat")
    cat_sink.write_snapshot(catalogue, root, 1)
    cat_sink.upsert_snapshot(spark, root, spark.createDataFrame([entry("/new")], KEYS))
    assert cat_sink.read_snapshot(spark, root).count() == 6
    assert len(cat_sink.read_snapshot(spark, root).inputFiles()) <= 8
    assert all("version=0000000002" in f for f in cat_sink.read_snapshot(spark, root).inputFiles())
    with pytest.raises(AnalysisException):
        cat_sink.write_snapshot(catalogue, root, 2)
    assert cat_sink.read_snapshot(spark, root).count() == 6


def test_catalogue_json(spark, catalogue, tmp_path, rows):
    path = str(tmp_path / "json")
    cat_sink.write_catalogue_json(catalogue, path)
    (tmp_path / "pretty.json").write_text('{\n  "/p": {\n "local_folder": "/p", "archive_mode": "Single"}\n}')
    lines = spark.read.text(path)
    assert rows(cat_src.parse_catalogue(lines), "folder_key") == rows(catalogue, "folder_key")
    listed = lambda df: sorted(map(str, df.select(*catalogue.columns).collect()))
    assert listed(cat_src.read_catalogue_json(spark, path)) == listed(catalogue)
    (tmp_path / "cut.json").write_text('{"/x": {"local_folder": ')
    with pytest.raises(Exception, match="not a catalogue map"):
        cat_src.read_catalogue_json(spark, str(tmp_path / "cut.json")).collect()
    one = cat_src.read_catalogue_json(spark, str(tmp_path / "pretty.json"), one_map_per_file=True).first()
    assert (one.folder_key, one.archive_mode, one.nih_project) == ("/p", "Single", None)


def test_prefix_is_whole_components(spark):
    objects = spark.createDataFrame([("a/b/x",), ("a/bc/x",), ("a/b/c/x",)], "key string")
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(cat_src.objects_under(objects, "a/b")) == ["a/b/c/x", "a/b/x"]
    assert keys(cat_src.direct_children(objects, "a/b/")) == ["a/b/x"]


MD5 = "folder string, name string, md5 string"


def test_verify(spark, rows):
    src = spark.createDataFrame([("/f", "a", "1"), ("/f", "b", "2"), ("/f", "c", "3"), ("/g", "a", "1")], MD5)
    dst = spark.createDataFrame([("/f", "a", "1"), ("/f", "b", "9"), ("/f", "d", "4"), ("/g", "a", "1"), ("/h", "a", None)], MD5)
    assert rows(verify.verify_checksums(src, dst), "folder", "name", "status") == [
        ("/f", "a", "match"), ("/f", "b", "differ"), ("/f", "c", "missing_on_dst"), ("/f", "d", "missing_on_src"),
        ("/g", "a", "match"), ("/h", "a", "missing_on_src")]
    assert {r.status for r in verify.verify_checksums(src, src).collect()} == {"match"}


def test_archive_states(spark, catalogue, rows):
    src = spark.createDataFrame([("/s", "a", "1"), ("/r", "a", "1"), ("/x", "a", "1"), ("/y", "a", "1")], MD5)
    dst = objects_of(spark, [("/s", "a", "1"), ("/r", "a", "2"), ("/x", "a", "1"), ("/n", "a", "1")])
    wanted = folders_of(spark, "/s", "/r", "/x", "/y", "/n", "/a/b")
    assert rows(verify.archive_state(wanted, catalogue, src, dst), "folder", "state") == [
        ("/a/b", "new"), ("/n", "new"), ("/r", "mismatch"), ("/s", "archived"), ("/x", "leftover"), ("/y", "leftover")]
    elsewhere = objects_of(spark, [("/s", "a", "1")], "other/place")
    assert rows(verify.archive_state(folders_of(spark, "/s"), catalogue, src, elsewhere), "state") == [("mismatch",)]


def test_a_copy_elsewhere_allows_no_delete(spark, catalogue, rows):
    """Only objects at the destination of the catalogue count, whatever others are called."""
    src = spark.createDataFrame([("/s", "a", "1"), ("/r/x", "a", "1")], MD5)
    local = spark.createDataFrame([("/s", "a", 5), ("/r/x", "a", 5)], FILES)
    plan = lambda dst: rows(verify.delete_plan(
        folders_of(spark, "/s", "/r/x"), catalogue, src, dst, local), "folder", "decision")
    held = [("/s", "a", "1"), ("/r/x", "a", "1")]
    assert plan(objects_of(spark, held)) == [("/r/x", "delete"), ("/s", "delete")]
    for wrong in (objects_of(spark, held, "elsewhere"), objects_of(spark, held, "arch/deeper"),
                  objects_of(spark, held).withColumn("bucket", F.lit("c"))):
        assert plan(wrong) == [("/r/x", "checksum_mismatch"), ("/s", "checksum_mismatch")]


def test_commit_needs_the_checksums(spark, rows):
    src = spark.createDataFrame([("/p/x", "a", "1"), ("/p/y", "a", "2"), ("/q", "a", "3")], MD5)
    up = folders_of(spark, "/p/x", "/p/y", "/q", "/none").withColumn("destination", F.concat(F.lit(":s3:b/arch"), "folder"))
    tops = folders_of(spark, "/p", "/q", "/none").withColumn("destination", F.concat(F.lit(":s3:b/arch"), "folder"))
    target = jobs.Target("b", "arch", "GLACIER")
    recorded = lambda dst, roots=None: [r[0] for r in rows(
        jobs.archive_commit(up, src, objects_of(spark, dst), target, "t", roots), "folder_key")]
    held = [("/p/x", "a", "1"), ("/p/y", "a", "2"), ("/q", "a", "3")]
    assert recorded(held) == ["/p/x", "/p/y", "/q"]
    assert recorded(held, tops) == ["/p", "/q"]
    assert recorded(held[:1] + held[2:]) == ["/p/x", "/q"]
    assert recorded(held[:1] + held[2:], tops) == ["/q"]


def test_restored_files_are_compared(spark, rows):
    asked = folders_of(spark, "/ok", "/bad", "/packed", "/none").withColumn("source", F.concat(F.lit(":s3:b/arch"), "folder"))
    held = [("/ok", "a", "1"), ("/bad", "a", "1"), ("/bad", "b", "2"), ("/packed", META.bundle, "3")]
    fetched = spark.createDataFrame([("/ok", "a", "1"), ("/bad", "a", "1"), ("/packed", META.bundle, "3")], MD5)
    got = jobs.restore_verified(asked, fetched, objects_of(spark, held))
    assert rows(got, "folder", "files", "failed", "step") == [
        ("/bad", 2, 1, "mismatch"), ("/none", 0, 0, "nothing"), ("/ok", 1, 0, "done"), ("/packed", 1, 0, "unbundle")]


FILES = "folder string, name string, size bigint"


def test_delete_and_restore_plans(spark, catalogue, rows):
    src = spark.createDataFrame([("/s", "a", "1"), ("/r", "a", "1"), ("/r/gone", "a", "1")], MD5)
    restored = spark.createDataFrame([("/r/deep", "a", "1"), ("/s", "a", "wrong")], MD5)
    dst = objects_of(spark, [(f, "a", "1") for f in ("/s", "/r/gone", "/r/deep")])
    local = spark.createDataFrame(
        [("/s", "a", 5), ("/s", META.md5, 1), ("/r", "a", 5), ("/r/gone", META.moved_note, 1), ("/r/deep", "a", 7), ("/r/none", "z", 1)],
        FILES)
    asked = folders_of(spark, "/s", "/r", "/r/gone", "/r/deep", "/r/none", "/zz")
    plan = verify.delete_plan(asked, catalogue, src, dst, local, restored)
    assert rows(plan, "folder", "decision", "files", "bytes") == [
        ("/r", "checksum_mismatch", 1, 5), ("/r/deep", "delete", 1, 7), ("/r/gone", "already_deleted", 0, 0),
        ("/r/none", "no_manifest", 1, 1), ("/s", "delete", 1, 5), ("/zz", "not_archived", 0, 0)]
    report = {r.folder: r for r in reports.deletion_report(plan, local, "restore").collect()}
    assert set(report) == {"/s", "/r/deep"} and (report["/s"].first_files, report["/s"].more_files) == ("a", 0)
    assert rows(verify.restore_plan(asked, catalogue, local), "folder", "decision") == [
        ("/r", "not_empty"), ("/r/deep", "not_empty"), ("/r/gone", "restore"), ("/r/none", "not_empty"),
        ("/s", "not_empty"), ("/zz", "not_archived")]


def test_archive_plan_collisions_only_when_recursive(spark, catalogue, rows):
    asked = folders_of(spark, "/n", "/n/m", "/o", "/empty")
    local = spark.createDataFrame([("/n", "a", 5), ("/n/m", "a", 5), ("/o", "a", 5), ("/empty", META.md5, 1)], FILES)
    none, nothing = spark.createDataFrame([], MD5), spark.createDataFrame([], OBJECTS)
    target = jobs.Target("b", "arch", "GLACIER")
    plan = lambda deep: dict(rows(jobs.archive_plan(
        asked, local, catalogue, none, nothing, target, recursive=deep), "folder", "decision"))
    assert plan(False) == {"/n": "archive", "/n/m": "archive", "/o": "archive", "/empty": "skip"}
    assert plan(True) == {"/n": "collision", "/n/m": "collision", "/o": "archive", "/empty": "skip"}
    made = jobs.catalogue_entries(cat.destination_paths(asked, catalogue, "b", "arch"), target, "Single", "t")
    assert cat.catalogue_upsert(catalogue, made).count() == 9


def test_tier_change(spark, catalogue):
    rows_ = [("b", "arch/a/b/x", 10), ("b", "arch/a/b/c/y", 5), ("b", "arch/a/bc/z", 99), ("b", f"arch/a/b/{META.manifest}", 1)]
    objects = spark.createDataFrame(rows_, "bucket string, key string, size bigint")
    warm = catalogue.withColumn("s3_storage_class", F.when(F.col("folder_key") == "/a/b", "STANDARD_IA").otherwise("GLACIER"))
    plan = obj.tier_change_plan(folders_of(spark, "/a/b", "/s", "/no"), warm, objects, "GLACIER_IR")
    got = {r.archive: (r.decision, r.total, r.changed, r.skipped, r.bytes) for r in plan.collect()}
    assert got == {"/a/b": ("change", 3, 2, 1, 16), "/s": ("rejected", 0, 0, 0, 0), "/no": ("not_archived", 0, 0, 0, 0)}
    below = obj.tier_change_plan(folders_of(spark, "/a/b/c", "/a/b/d", "/a/b"), warm, objects, "GLACIER_IR").collect()
    assert [(r.archive, r.folders, r.bytes) for r in below] == [("/a/b", 3, 16)]
    entries = jobs.tier_change_entries(plan, warm, "2025-01-01T00:00:00")
    assert [(r.folder_key, r.s3_storage_class) for r in entries.collect()] == [("/a/b", "GLACIER_IR")]


def test_small_file_plan(spark, rows):
    files = spark.createDataFrame([("/f", "a", 10), ("/f", "b", 20), ("/f", "c", 5000), ("/g", "a", 9000)], FILES)
    assert rows(bundle.small_file_plan(files, kib=1)) == [("/f", 2, 30, 3, 2, 40960), ("/g", 0, 0, 1, 1, 0)]


def test_batches_hold_every_folder_once(spark):
    chosen = spark.range(120).selectExpr("concat('/d/', id) AS folder", "id AS dirsum", "id AS gib")
    listed = reports.archive_batch(chosen, "archive", per_batch=10).collect()
    batches = [b for b in listed if b.batch is not None]
    total, = (b for b in listed if b.batch is None)
    assert (total.folders, total.bytes) == (120, sum(range(120)))
    quoted = [w for b in batches for w in b.command.split('"')[1::2]]
    assert sorted(quoted) == sorted(f"/d/{i}" for i in range(120)) and max(b.folders for b in batches) < 40
    assert sum(b.bytes for b in batches) == sum(range(120))


LISTED = "bucket string, key string, size long, storage_class string, restore string, md5 string"


def _verification_tables(spark):
    """Manifests, a listing and the folders' places: shared places, copies that differ, foreign objects."""
    src = spark.createDataFrame(
        [("/a", "x", "1"), ("/a", "y", "2"), ("/a", "z", None), ("/b", "x", "1"), ("/c", "x", "9"), ("/c", "w", "3"), ("/n", "x", "1"),
         ("/d", "x", "1"), ("/d", "x", "1"), ("/e", "x", "1"), ("/e", "x", "2")], "folder string, name string, md5 string")
    at = lambda key, md5: ("b", key, 5, None, None, md5)
    objects = spark.createDataFrame(
        [at("p/a/x", "1"), at("p/a/y", "2"), at("p/a/z", "3"), at("p/s/x", "1"), at("p/s/q", "7"), at("p/d/x", "1"), at("p/d/x", "1"),
         at("p/e/x", "1"), at("elsewhere/w", "3"), at("top", "1")], LISTED)
    places = spark.createDataFrame(
        [("/a", ":s3:b/p/a"), ("/b", ":s3:b/p/s"), ("/c", ":s3:b/p/s"), ("/d", ":s3:b/p/d"), ("/e", ":s3:b/p/e"), ("/n", None),
         ("/empty", ":s3:b")], "folder string, destination string")
    return src, objects, places


@pytest.mark.parametrize("stored", [False, True])
def test_verification_by_place(spark, rows, stored):
    src, objects, places = _verification_tables(spark)
    listing = listing_sink.store_listing(objects, "listing_test", buckets=4) if stored else objects
    assert rows(verify.verify_archives(src, listing, places), "folder", "name", "status") == [
        ("/a", "x", "match"), ("/a", "y", "match"), ("/a", "z", "differ"), ("/b", "q", "missing_on_src"),
        ("/b", "x", "match"), ("/c", "q", "missing_on_src"), ("/c", "w", "missing_on_dst"),
        ("/c", "x", "differ"), ("/d", "x", "match"), ("/e", "x", "differ"), ("/empty", "top", "missing_on_src"),
        ("/n", "x", "missing_on_dst")]
    restored = src.where("folder = '/b'").unionByName(
        spark.createDataFrame([("/empty", "top", "1"), ("/a", "x", "0")], "folder string, name string, md5 string"))
    assert rows(verify.folder_checks(src, listing, places), "folder", "ok") == [
        ("/a", False), ("/b", False), ("/c", False), ("/d", True), ("/e", False), ("/n", False)]
    assert rows(verify.folder_checks(src.where("folder <> '/b'"), listing, places, restored), "folder", "has_manifest", "ok") == [
        ("/a", True, False), ("/b", True, False), ("/c", True, False), ("/d", True, True), ("/e", True, False), ("/empty", True, True),
        ("/n", True, False)]


def test_a_stored_listing_is_never_shuffled(spark):
    """Exchanges above the listing's scan carry sums per place at most."""
    src, objects, places = _verification_tables(spark)
    listing = listing_sink.store_listing(objects, "listing_plan", buckets=8)
    assert rows_of_place(listing) == {":s3:b/p/a": 3, ":s3:b/p/s": 2, ":s3:b/p/d": 1, ":s3:b/p/e": 1, ":s3:b/elsewhere": 1, ":s3:b": 1}
    plan = verify.folder_checks(src, listing, places)._jdf.queryExecution().executedPlan().toString()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    lines, scans = plan.splitlines(), []
    for n, line in enumerate(lines):
        if "FileScan" in line:
            scans.append(("Bucketed: true" in line, "name" in line.partition("[")[2].partition("]")[0]))
            above, at = [], depth(line)
            for upper in reversed(lines[:n]):
                if depth(upper) < at:
                    at = depth(upper)
                    above.append(upper.strip(" :+-"))
            first = next((k for k, u in enumerate(above) if u.startswith("Exchange")), None)
            assert first is None or any(u.startswith(("HashAggregate", "SortAggregate")) for u in above[:first])
    assert sorted(scans) == [(False, False), (True, True)]  # the rows by bucket, the sums by any split


def rows_of_place(listing):
    return {r["place"]: r["objects"] for r in listing_sink.place_summary(listing).collect()}


def test_forced_archive_compares_three_sides(spark, rows):
    local = spark.createDataFrame(
        [("/a", "same", 1, "1"), ("/a", "edited", 2, "x"), ("/a", "fresh", 4, "9"), ("/a", "lost", 8, "4"), ("/a", META.md5, 16, "m"),
         ("/a", META.bundle, 32, "b"), ("/n", "x", 64, "1")], "folder string, name string, size long, md5 string")
    src = spark.createDataFrame(
        [("/a", "same", "1"), ("/a", "edited", "2"), ("/a", "lost", "4"), ("/a", "gone", "5"), ("/a", "never", "6"), ("/a", META.manifest, "7")],
        "folder string, name string, md5 string")
    at = lambda name, md5: ("b", f"arch/a/{name}", 1, None, None, md5)
    objects = spark.createDataFrame(
        [at("same", "1"), at("edited", "2"), at("lost", "altered"), at("gone", "5"), at("stray", "8"), at(META.manifest, "7")], LISTED)
    catalogue = spark.createDataFrame([entry("/a")], KEYS)
    places = cat.catalogue_lookup(folders_of(spark, "/a", "/n"), catalogue)
    assert rows(jobs.rearchive_files(local, src, objects, places), "folder", "name", "action") == sorted([
        ("/a", "same", "keep"), ("/a", "edited", "upload_changed"), ("/a", "fresh", "upload_new"), ("/a", "lost", "upload_missing"),
        ("/a", "gone", "remove"), ("/a", "stray", "remove"), ("/a", META.md5, "drop"), ("/a", META.bundle, "unbundle"),
        ("/n", "x", "upload_new")], key=repr)
    plan = jobs.rearchive_plan(folders_of(spark, "/a", "/n"), local, catalogue, src, objects)
    assert rows(plan) == [("/a", True, 1, 1, 1, 1, 1, 2, 14), ("/n", False, 0, 0, 1, 0, 0, 0, 64)]


def test_of_two_catalogue_writers_neither_is_lost(spark, catalogue, tmp_path, monkeypatch):
    root = str(tmp_path / "cat")
    cat_sink.write_snapshot(catalogue, root, 1)
    first, second = (spark.createDataFrame([entry(f)], KEYS) for f in ("/first", "/second"))
    merge, raced = cat_sink.catalogue_upsert, []

    def slow_merge(old, entries):
        if not raced:  # while the second writer merges, the first one is done
            raced.append(True)
            cat_sink.upsert_snapshot(spark, root, first)
        return merge(old, entries)

    monkeypatch.setattr(cat_sink, "catalogue_upsert", slow_merge)
    assert cat_sink.upsert_snapshot(spark, root, second) == 3
    keys = {r["folder_key"] for r in cat_sink.read_snapshot(spark, root).collect()}
    assert {"/first", "/second"} <= keys and len(keys) == catalogue.count() + 2


def test_running_restores_tell_tier_and_end(spark):
    from datetime import datetime

    asked, on, off = datetime(2024, 1, 1), 'ongoing-request="true"', 'ongoing-request="false", expiry-date="{}"'
    rows = [("b", "a/1", "GLACIER", on, "Bulk", asked), ("b", "a/2", "GLACIER", on, "Expedited", asked), ("b", "a/3", "GLACIER", None, None, None),
            ("b", "d/1", "DEEP_ARCHIVE", on, "Expedited", asked), ("b", "r/1", "GLACIER", off.format("Fri, 23 Dec 2022 00:00:00 GMT"), "Bulk", asked),
            ("b", "r/2", "GLACIER", off.format("Fri, 3 Feb 2023 00:00:00 GMT"), "Bulk", asked), ("b", "r/3", "GLACIER", off.format("x"), "Bulk", asked)]
    objects = spark.createDataFrame(rows, "bucket string, key string, storage_class string, restore string, restore_tier string, restore_requested timestamp")
    got = {r.location: tuple(r)[1:] for r in obj.running_restores(objects).collect()}
    assert got == {":s3:b/a": (2, "Bulk+Expedited", datetime(2024, 1, 1, 12), 0, None), ":s3:b/d": (1, "Expedited", None, 0, None),
                   ":s3:b/r": (0, "", None, 3, datetime(2022, 12, 23))}
