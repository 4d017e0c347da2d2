"""Plans that must not repeat or widen work as the tables grow."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coldledger.functions.objects import digest_text, packed_digest
from coldledger.operators import entitlements as ent, permissions as perm, verify
from coldledger.plans import archive as jobs
from coldledger.session import kept
from coldledger.sinks import reports as sink
from coldledger.sinks.listing import store_listing
from coldledger.sources.text import parse_key_values
from registry import queries as q


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def crawl(spark, tmp_path):
    rows = [("/a", 1, 1, 0o40777, 1, "d"), ("/a/x", 1, 1, 0o100666, -1, "f"), ("/b", 2, 9, 0o40700, 0, "d")]
    path = str(tmp_path / "crawl-source")
    spark.createDataFrame(rows, "filename string, UID long, GID long, st_mode int, pw_fcount long, type string").write.parquet(path)
    return spark.read.parquet(path)


def test_the_crawl_is_reduced_once_for_the_permission_tree(spark, crawl, rows):
    tree = perm.folder_permission_tree(crawl, spark.createDataFrame([("/a",), ("/b",)], "folder string"), 1, [1])
    assert "st_mode" not in plan_of(tree)
    assert rows(tree) == [("/a", True, True, True), ("/b", False, False, False)]


def test_broken_lines_come_from_the_same_crawl(crawl, rows):
    lines = q._with_broken(crawl.select("filename", F.col("UID").cast("string").alias("UID"), "type"))
    assert plan_of(lines).count("FileScan") == 1
    assert rows(lines) == [("/a", "1", "d"), ("/a", "not a number", "d"), ("/a/x", "1", "f"), ("/b", "2", "d"), ("/b", "not a number", "d")]


@pytest.mark.parametrize("query", [q._stored_report, q.index_roots])
def test_a_report_read_several_times_is_made_once(spark, query):
    assert "lineitem.parquet" not in plan_of(query(spark, "/root/testdata/sf0.001"))


def test_the_pieces_of_a_line_are_made_once(spark):
    kv = parse_key_values(F.col("line"))
    assert "slice" not in str(kv)
    frame = spark.createDataFrame([("b=1 a=x=y b=2 plain c=",), (None,), ("",), ("=v a=1",)], "line string")
    assert [r[0] for r in frame.select(kv).collect()] == [{"a": "x=y", "b": "2", "c": ""}, None, {}, {"": "v", "a": "1"}]


def test_pairs_are_dealt_before_they_are_sorted(spark):
    people = spark.createDataFrame([(1, "A", ["G"], ["o"])], "principal long, account string, groups array<string>, options array<string>")
    rules = spark.createDataFrame([("R", "UP", [], [], [], ["G"], [], ["ALL"])], "resource string, state string, deny_groups array<string>, "
                                  "deny_accounts array<string>, allow_accounts array<string>, allow_groups array<string>, "
                                  "deny_options array<string>, allow_options array<string>")
    found = ent.entitlements(people, rules)
    text = plan_of(found)
    assert text.rindex("SortAggregate") < text.index("Exchange hashpartitioning(principal")
    assert [tuple(r) for r in found.collect()] == [(1, "R", ["o"])]


def test_manifests_are_compressed(spark, tmp_path):
    sink.write_manifest(spark.createDataFrame([("/a", "f")], "folder string, File string"), str(tmp_path / "m"))
    assert all(p.name.endswith(".csv.gz") for p in (tmp_path / "m").rglob("part-*")) and list((tmp_path / "m").rglob("part-*"))


def test_a_packed_digest_is_short_and_exact(spark):
    texts = ["0" * 32, "0123456789abcdef" * 2, "0123456789ABCDEF" * 2, "", "0" * 31, "x" * 32, "0" * 32 + "\n", "é"]
    packed = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", packed_digest(F.col("t")))
    found = packed.select("t", digest_text(F.col("p")).alias("back"), F.octet_length("p").alias("n"), "p").collect()
    assert all(r["t"] == r["back"] for r in found) and len({bytes(r["p"]) for r in found}) == len(texts)
    assert [r["n"] for r in found][:2] == [16, 16] and 16 not in [r["n"] for r in found][2:]


def test_manifests_are_read_and_moved_once(spark, tmp_path, rows):
    path = str(tmp_path / "src-table")
    spark.createDataFrame([("/a", "x", "1"), ("/a", "gone", "2"), ("/b", "y", "3")], "folder string, name string, md5 string").write.parquet(path)
    objects = spark.createDataFrame([("b", "p/a/x", "1"), ("b", "p/a/new", "9"), ("b", "p/b/y", "4")], "bucket string, key string, md5 string").withColumns(
        {"size": F.lit(1).cast("long"), "storage_class": F.lit("GLACIER"), "restore": F.lit(None).cast("string")})
    listing = store_listing(objects, "listing_once")
    places = spark.createDataFrame([("/a", ":s3:b/p/a"), ("/b", ":s3:b/p/b")], "folder string, destination string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = verify.verify_archives(spark.read.parquet(path), listing, places)
        assert len([line for line in plan_of(found).split("\n") if "FileScan" in line and "struct<folder:string,name:string" in line]) == 1
        assert rows(found) == [("/a", "gone", "missing_on_dst"), ("/a", "new", "missing_on_src"), ("/a", "x", "match"), ("/b", "y", "differ")]
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def test_folders_find_their_place_without_moving_files(spark, tmp_path, rows):
    spark.createDataFrame([("/a", "x", "1")], "folder string, name string, md5 string").write.parquet(str(tmp_path / "src"))
    src = spark.read.parquet(str(tmp_path / "src"))
    objects = spark.createDataFrame([("b", "p/a/x", "1")], "bucket string, key string, md5 string")
    places = spark.createDataFrame([("/a", ":s3:b/p/a")] * 3, "folder string, destination string")
    assert verify.distinct_places(places).count() == 1
    assert rows(verify.folder_checks(src, objects, places)) == [("/a", True, True)]
    committed = jobs.archive_commit(places, src, objects, jobs.Target("b", "p", "GLACIER"), "t")
    assert "BroadcastHashJoin [folder" in plan_of(committed) and committed.count() == 3
    files = jobs.rearchive_files(src.withColumn("size", F.lit(3).cast("long")), src, objects, places)
    assert "rearchive-" not in plan_of(files)  # both sides go to the listing as they are
    assert rows(files) == [("/a", "x", 3, "keep")]


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().toList()
    return {n for n in (blocks.apply(i).getName() for i in range(blocks.size())) if n.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark, rows):
    objects = spark.createDataFrame([("b", f"p/a/{i % 50}", "1") for i in range(100)], "bucket string, key string, md5 string").withColumns(
        {"size": F.lit(1).cast("long"), "storage_class": F.lit("GLACIER"), "restore": F.lit(None).cast("string")})
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = shuffle_files(spark), spark.conf.get(setting, None)
    listing = store_listing(objects, "listing_freed")
    stored = kept(objects.groupBy("key").count(), "freed")
    assert not shuffle_files(spark) - before and spark.conf.get(setting, None) == set_to
    assert listing.count() == stored.count() == 50 and {r["count"] for r in stored.collect()} == {2}
