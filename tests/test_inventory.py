from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from coldledger.constants import META
from coldledger.operators import bundle, entitlements as ent, inventory as inv, permissions as perm
from coldledger.plans import index
from coldledger.plans.index import index_job

NOW = datetime(2024, 6, 1)
BIG = 1_100_000_000

# Folder -> number of large files; each folder also holds four small files.
TREE = {
    "_hotspots/_hotspots_1_tree_1_hp": 1, "_hotspots/_hotspots_1_tree_2_hp": 2,
    "_hotspots/_hotspots_2_tree_1_hp_each": 1,
    "_hotspots/_hotspots_2_tree_1_hp_each/_hotspots_2_tree_1_hp_each_sub_1": 1,
    "_hotspots/hotspots_2_tree_1_hp_first": 1, "_hotspots/hotspots_2_tree_1_hp_first/hotspots_2_tree_1_hp_first_sub_1": 0,
    "_hotspots/hotspots_2_tree_1_hp_last": 0, "_hotspots/hotspots_2_tree_1_hp_last/hotspots_2_tree_1_hp_last_sub_1": 1,
    "_no_hotspots/a": 0, "_no_hotspots/b": 0, "_no_hotspots/b/c": 0,
}


def tree_files():
    out = []
    for folder, large in TREE.items():
        sizes = [(1, 1), (1, 10), (1100, 100), (1100, 1000)] + [(BIG, 1000)] * large
        for i, (size, age) in enumerate(sizes):
            at = NOW - timedelta(days=age)
            out.append(("/root/" + folder, f"f{i}", size, at, at, 1, 2, 0o100644, "f"))
    return out


SCHEMA = "folder string, name string, size bigint, mtime timestamp, atime timestamp, uid bigint, gid bigint, mode int, type string"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(tree_files(), SCHEMA)


@pytest.fixture(scope="module")
def crawl(spark, files):
    epoch = lambda c: F.unix_seconds(c)
    entries = files.select(
        F.concat("folder", F.lit("/"), "name").alias("filename"), F.col("uid").alias("UID"), F.col("gid").alias("GID"),
        epoch("atime").alias("st_atime"), epoch("mtime").alias("st_mtime"), F.lit(-1).cast("long").alias("pw_fcount"),
        F.lit(0).cast("long").alias("pw_dirsum"))
    old = int((NOW - timedelta(days=2000)).timestamp())
    names = [*("/root/" + f for f in TREE), "/root/_empty", "/root"]
    sums = {"/root/" + f: (4 + n, 2202 + n * BIG) for f, n in TREE.items()}
    folders = [(n, 1, 2, old, old, *sums.get(n, (0, 0))) for n in names]
    return entries.unionByName(spark.createDataFrame(folders, entries.schema))


def test_golden_tree(spark, crawl, rows):
    users = spark.createDataFrame([(1, "ann")], "uid bigint, user string")
    groups = spark.createDataFrame([(9, "lab")], "gid bigint, group_name string")
    result = index_job(crawl, users, groups, str(NOW))
    got = {r.Folder: r for r in result.report.collect()}
    assert set(got) == {"/root/" + f for f, n in TREE.items() if n}
    one = got["/root/_hotspots/_hotspots_1_tree_1_hp"]
    assert (one.User, one.Group, one.AccD, one.ModD, one.GiB, one.MiBAvg, one.TiB, one.FileCount, one.DirSize) == (
        "ann", "2", 1, 1, 1, 209, 0, 5, 1100002202)
    two = got["/root/_hotspots/_hotspots_1_tree_2_hp"]
    assert (two.GiB, two.MiBAvg, two.FileCount, two.DirSize) == (2, 349, 6, 2200002202)
    assert result.report.first().Folder == two.Folder
    assert index_job(crawl, users, groups, str(NOW), 2).report.count() == 1
    assert tuple(result.summary.first())[:2] == (11, 6)


def test_roots_must_not_contain_one_another(spark, crawl):
    from coldledger.plans.index import index_roots

    users = spark.createDataFrame([(1, "ann")], "uid bigint, user string")
    groups = spark.createDataFrame([(9, "lab")], "gid bigint, group_name string")
    with pytest.raises(ValueError, match="lies below"):
        index_roots({"/root": crawl, "/root/x": crawl}, users, groups, str(NOW))
    assert index_roots({"/root": crawl}, users, groups, str(NOW)).report.count() == 6


def test_job_equals_its_operators(spark, crawl, files):
    """The one-pass job and the join of separate operators give the same folders and times."""
    from coldledger.plans.index import folder_facts

    base = inv.hotspot_base(crawl).withColumns({c: F.timestamp_seconds(c) for c in ("atime", "mtime")})
    joined = inv.newest_times(files, base).select("folder", F.unix_seconds("atime").alias("atime"), "fcount", "dirsum")
    one_pass = folder_facts(crawl).select("folder", "atime", "fcount", "dirsum")
    assert joined.exceptAll(one_pass).isEmpty() and one_pass.exceptAll(joined).isEmpty()


def test_metadata_never_counts_as_newest(spark):
    at = lambda d: datetime(2020, 1, d)
    found = spark.createDataFrame(
        [("/a", "x", at(2), at(3)), ("/a", META.md5, at(9), at(9)), ("/b", META.moved_note, at(9), at(9))],
        "folder string, name string, atime timestamp, mtime timestamp")
    own = spark.createDataFrame([("/a", at(1), at(1)), ("/b", at(5), at(6))], "folder string, atime timestamp, mtime timestamp")
    got = {r.folder: (r.atime, r.mtime) for r in inv.newest_times(found, own).collect()}
    assert got == {"/a": (at(2), at(3)), "/b": (at(5), at(6))}


def test_recursive_rollup_of_root_is_everything(files):
    direct = inv.folder_rollup(files).agg(F.sum("fcount"), F.sum("dirsum")).first()
    deep = inv.recursive_rollup(files).where("folder = '/root'").select("fcount", "dirsum").first()
    assert tuple(direct) == tuple(deep)


def test_zero_threshold_is_honoured(files):
    base = inv.size_units(inv.folder_rollup(files))
    assert inv.hotspots(base).count() == 6
    assert inv.hotspots(base, 0, 0).count() == 11


def test_pick(spark):
    hot = spark.createDataFrame([("/a", 5, 100, 10), ("/b", 50, 100, 99), ("/c", 50, 20, 1)],
                                "folder string, gib bigint, accd bigint, modd bigint")
    names = lambda df: sorted(r.folder for r in df.collect())
    assert names(inv.pick(hot, larger=5, older=50)) == ["/b"]
    assert names(inv.pick(hot, newer=50, by="modd")) == ["/a", "/c"]
    with pytest.raises(ValueError):
        inv.pick(hot, older=1, newer=1)


def test_aged_buckets_are_strict_and_cumulative(spark, rows):
    hot = spark.createDataFrame([(30, 1), (31, 2), (400, 4), (6000, 8)], "accd bigint, dirsum bigint")
    got = dict(rows(inv.aged_bytes(hot)))
    assert got == {5475: 8, 3650: 8, 1825: 8, 1095: 8, 730: 8, 365: 12, 90: 12, 30: 14}
    assert [r[0] for r in rows(inv.aged_bytes_report(inv.aged_bytes(hot)), "days")] == [30, 365, 5475]


def test_links_are_files_and_small_limit_is_strict(spark):
    found = spark.createDataFrame(
        [("a", "f", 1048576), ("b", "f", 1048575), ("c", "l", 9), ("d", "d", 0)], "name string, type string, size bigint")
    kept = bundle.classify_small(inv.files_and_links(found))
    assert {r.name: r.tarred for r in kept.collect()} == {"a": "No", "b": "Yes", "c": "Yes"}
    assert bundle.classify_small(found, kib=0).where("tarred = 'Yes'").count() == 0
    assert bundle.classify_small(found, tar=False).where("tarred = 'Yes'").count() == 0


def test_folder_permissions(spark, rows):
    found = spark.createDataFrame(
        [("/a", 0o100666, 5, 5), ("/a/b", 0o100600, 5, 5), ("/c", 0o100600, 1, 5), ("/d", 0o100060, 5, 2)],
        "folder string, mode int, uid bigint, gid bigint")
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/c",), ("/d",), ("/none",)], "folder string")
    check = lambda deep: dict(rows(perm.folder_permission_ok(found, roots, 1, [2], deep)))
    assert check(False) == {"/a": True, "/a/b": False, "/c": True, "/d": True, "/none": True}
    assert check(True) == {"/a": False, "/a/b": False, "/c": True, "/d": True, "/none": True}


CRAWLED = "filename string, UID long, GID long, st_atime long, st_mtime long, pw_fcount long, pw_dirsum long, st_mode int"


def test_locked_and_snapshot_folders_in_the_index(spark):
    folder = lambda path: (path, 1, 1, 0, 0, 1, 2**40, 0o40755)
    crawl = spark.createDataFrame([folder(p) for p in ("/r", "/r/a", "/r/a/x", "/r/a/x/deep", "/r/ab", "/r/.snapshot/s", "/r/b")], CRAWLED)
    lines = spark.createDataFrame(
        [("s", 1, "Locked Dir: /r/a/x/"), ("s", 2, "Locked Dir: /r/b"), ("s", 3, "Permission denied: /r/ab"), ("s", 4, "Locked Dir:")],
        "source string, pos long, line string")
    users, groups = spark.createDataFrame([(1, "u")], "uid long, user string"), spark.createDataFrame([(1, "g")], "gid long, group_name string")
    result = index.index_job(crawl, users, groups, "2024-01-01", errors=lines)
    assert {(r["Folder"], r["Complete"]) for r in result.report.collect()} == {("/r", False), ("/r/a", False), ("/r/ab", True)}
    assert result.summary.first()["folders"] == 3
    plain = index.index_job(crawl, users, groups, "2024-01-01").report
    assert "Complete" not in plain.columns and plain.count() == 6


def test_permissions_of_directories_count(spark):
    row = lambda path, mode, files=-1, uid=1, gid=1: (path, uid, gid, 0, 0, files, 0, mode)
    crawl = spark.createDataFrame([
        row("/", 0o40755, 1, 0, 0), row("/ok", 0o40777, 2), row("/ok/f", 0o100666), row("/ok/sub", 0o40777, 1), row("/ok/sub/f", 0o100666),
        row("/dir", 0o40777, 1), row("/dir/f", 0o100666), row("/dir/shut", 0o40755, 0), row("/file", 0o40777, 1), row("/file/f", 0o100644),
        row("/hidden", 0o40776, 1), row("/hidden/in", 0o40777, 1), row("/mine", 0o40700, 1, 7), row("/mine/f", 0o100600, -1, 7)], CRAWLED)
    roots = spark.createDataFrame([(p,) for p in ("/ok", "/dir", "/file", "/hidden/in", "/mine", "/unknown")], "folder string")
    got = {r.folder: (r.direct_ok, r.recursive_ok, r.reachable) for r in perm.folder_permission_tree(crawl, roots, 7, [9]).collect()}
    assert got == {"/ok": (True, True, True), "/dir": (True, False, True), "/file": (False, False, True), "/hidden/in": (True, True, False),
                   "/mine": (True, True, True), "/unknown": (True, True, True)}


def test_open_policies_stand_for_all_pairs(spark):
    import random

    rng = random.Random(1)
    some = lambda names, most: rng.sample(names, rng.randrange(most + 1))
    accounts, groups = ["A", "B", "C"], ["g1", "g2", "g3", "ALL"]
    principals = spark.createDataFrame([(i, rng.choice(accounts), some(groups, 3), ["o"]) for i in range(80)],
                                       "principal long, account string, groups array<string>, options array<string>")
    policies = spark.createDataFrame([
        (f"r{i}", rng.choice(["UP", "UP", "DOWN"]), some(groups, 1), some(accounts, 1), rng.choice([[], [], some([*accounts, "ALL"], 2)]),
         rng.choice([["ALL"], some(groups, 2), ["ALL", "g1"]]), [], []) for i in range(40)],
        "resource string, state string, deny_groups array<string>, deny_accounts array<string>, allow_accounts array<string>, "
        "allow_groups array<string>, deny_options array<string>, allow_options array<string>")
    want = {}
    for r in ent.entitlements(principals, policies).collect():
        want[r["resource"]] = want.get(r["resource"], 0) + 1
    found = ent.open_policies(principals, policies).collect()
    assert {r["resource"]: r["principals"] for r in found if r["principals"]} == want
    assert len(found) == policies.where("state = 'UP'").count()
    left = {}
    for r in ent.exceptions(principals, policies).collect():
        left[r["resource"]] = left.get(r["resource"], 0) + 1
    assert left == {r["resource"]: r["excluded"] for r in found if r["rule"] == "everyone" and r["excluded"]}
