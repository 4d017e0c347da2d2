from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coldledger.session import work_dir
from coldledger.sinks import reports as sink
from coldledger.sources import crawl as src, grants, text

HEADER = "inode,filename,UID,GID,st_atime,st_mtime,pw_fcount,pw_dirsum\n"


def test_crawl_csv(spark, tmp_path, rows):
    body = HEADER + '1,"/a/é, x",5,6,10,20,-1,0\n2,/a,5,6,10,20,1,99\n3,/bad,xx,6,10,20,1,99\n4,/short,5\n'
    (tmp_path / "c.csv").write_bytes(body.encode("ISO-8859-1"))
    crawl = src.read_crawl_csv(spark, str(tmp_path))
    assert rows(src.good_rows(crawl), "filename", "pw_dirsum") == [("/a", 99), ("/a/é, x", 0)]
    # The result does not depend on the columns that are used.
    assert src.good_rows(crawl).select("filename").count() == 2
    assert src.bad_lines(crawl).count() == 2


def test_crawl_csv_with_other_columns(spark, tmp_path):
    from coldledger.functions.permissions import entry_type

    head = 'inode,parent-inode,directory-depth,"filename","fileExtension",UID,GID,st_size,"st_mode",st_atime,st_mtime,pw_fcount,pw_dirsum\n'
    (tmp_path / "c.csv").write_text(head + '1,0,0,"/a","",5,6,4096,"0040755",10,20,1,7\n2,1,1,"/a/f","txt",5,6,7,"0100644",10,20,-1,0\n'
                                    '3,1,1,"/a/l","",5,6,7,"0120777",10,20,-1,0\n')
    crawl = src.good_rows(src.read_crawl_csv(spark, str(tmp_path), mode_base=8))
    got = {r.filename: (r.st_mode, r.t) for r in crawl.select("*", entry_type(F.col("st_mode")).alias("t")).collect()}
    assert got == {"/a": (0o40755, "d"), "/a/f": (0o100644, "f"), "/a/l": (0o120777, "l")}


def test_crawl_files_with_headers_of_their_own(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text(HEADER + "1,/a,5,6,10,20,1,7\n")
    (tmp_path / "b.csv").write_text("GID,UID,filename,st_atime,st_mtime,pw_fcount,pw_dirsum,inode\n6,5,/b,10,20,1,7,2\n")
    crawl = src.good_rows(src.read_crawl_csv(spark, str(tmp_path)))
    assert rows(crawl, "filename", "UID", "GID", "pw_dirsum") == [("/a", 5, 6, 7), ("/b", 5, 6, 7)]


def test_crawl_files_without_header_and_with_several(spark, tmp_path, rows):
    other = "GID,UID,filename,st_atime,st_mtime,pw_fcount,pw_dirsum,inode\n"
    (tmp_path / "a.csv").write_text("9,/early,5,6,10,20,1,7\n" + HEADER + "1,/a,5,6,10,20,1,7\n" + other + "6,5,/b,10,20,1,8,2\n6,5,/c,10,20,1,9,2\n"
                                    + HEADER + "1,/d,5,6,10,20,1,10\n")
    (tmp_path / "none.csv").write_text("1,/lost,5,6,10,20,1,7\n2,/lost2,5,6,10,20,1,7\n")
    crawl = src.read_crawl_csv(spark, str(tmp_path))
    assert rows(src.good_rows(crawl), "filename", "UID", "GID", "pw_dirsum") == [
        ("/a", 5, 6, 7), ("/b", 5, 6, 8), ("/c", 5, 6, 9), ("/d", 5, 6, 10)]
    assert rows(src.bad_lines(crawl)) == [
        (None, "1,/lost,5,6,10,20,1,7"), (None, "2,/lost2,5,6,10,20,1,7"), (None, "9,/early,5,6,10,20,1,7")]


def test_headers_hold_across_the_pieces_of_a_file(spark, tmp_path):
    other = "GID,UID,filename,st_atime,st_mtime,pw_fcount,pw_dirsum,inode\n"
    body = HEADER + "".join(f"1,/a{k},5,6,10,20,1,7\n" for k in range(3000)) + other + "".join(f"6,5,/b{k},10,20,1,8,2\n" for k in range(3000))
    (tmp_path / "c.csv").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        crawl = src.good_rows(src.read_crawl_csv(spark, str(tmp_path)))
        assert crawl.rdd.getNumPartitions() > 4
        got = {(r["s"], r["UID"], r["GID"], r["pw_dirsum"]): r["count"] for r in crawl.groupBy(
            F.substring("filename", 1, 2).alias("s"), "UID", "GID", "pw_dirsum").count().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("/a", 5, 6, 7): 3000, ("/b", 5, 6, 8): 3000}


def test_crawl_names_with_a_line_break_are_set_aside(spark, tmp_path, rows):
    (tmp_path / "c.csv").write_text(HEADER + '1,"/a\nb",5,6,10,20,1,7\n2,/c,5,6,10,20,1,7\n')
    crawl = src.read_crawl_csv(spark, str(tmp_path))
    assert rows(src.good_rows(crawl), "filename") == [("/c",)] and src.bad_lines(crawl).count() == 2


def test_long_paths_in_manifests(spark, tmp_path, rows):
    deep = "/" + "/".join("lab" for _ in range(100))
    digests = spark.createDataFrame([(deep, "x", "0" * 32)], "folder string, name string, md5 string")
    sink.write_md5_manifest(digests, digests.select("folder"), str(tmp_path / "m"))
    assert rows(text.read_md5_manifest(spark, str(tmp_path / "m"))) == rows(digests)


def test_crawl_csv_needs_its_columns(spark, tmp_path):
    (tmp_path / "c.csv").write_text("filename,UID\n/a,1\n")
    with pytest.raises(ValueError, match="pw_dirsum"):
        src.read_crawl_csv(spark, str(tmp_path))


def test_hotspot_reports(spark, tmp_path):
    names = "User,AccD,ModD,GiB,MiBAvg,Folder,Group,TiB,FileCount,DirSize\n"
    (tmp_path / "empty.csv").write_text(names)
    (tmp_path / "bad.csv").write_text("User,AccD\nx,1\n")
    assert src.read_hotspots(spark, str(tmp_path / "empty.csv")).count() == 0
    with pytest.raises(ValueError, match="Folder"):
        src.read_hotspots(spark, str(tmp_path / "bad.csv"))


def test_user_report_is_reused_until_its_source_changes(spark, tmp_path):
    report = spark.createDataFrame([("u", "/a", 1), ("u", "/b", 1), ("u", "/gone", 1)], "User string, Folder string, DirSize bigint")
    stats = spark.createDataFrame([("/a", 0o40777, 1, 1), ("/b", 0o40700, 1, 1)], "folder string, mode int, uid bigint, gid bigint")
    source, target = str(tmp_path / "r"), str(tmp_path / "u")
    sink.write_hotspots(report, source)
    assert sink.write_user_hotspots(spark, source, target, stats, 9, [9])
    assert not sink.write_user_hotspots(spark, source, target, stats, 9, [9])
    assert sink.write_user_hotspots(spark, source, target, stats, 9, [9], force=True)
    assert [r.Folder for r in src.read_hotspots(spark, target).collect()] == ["/a"]


def test_md5_manifest_fails_on_an_empty_folder(spark, tmp_path, rows):
    digests = spark.createDataFrame([("/a", "x y  z", "0" * 32)], "folder string, name string, md5 string")
    asked = spark.createDataFrame([("/a",), ("/b",)], "folder string")
    with pytest.raises(ValueError, match="/b"):
        sink.write_md5_manifest(digests, asked, str(tmp_path / "m"))
    sink.write_md5_manifest(digests, asked.where("folder = '/a'"), str(tmp_path / "m"))
    assert rows(text.read_md5_manifest(spark, str(tmp_path / "m"))) == rows(digests)


def test_transfer_log_skips_other_lines(spark, tmp_path, rows):
    (tmp_path / "log").write_text(
        'NOTICE\n\n{"source": "accounting/stats.go:1", "msg": "m", "stats": {"lastError": "boom"}}\n'
        '{"source": "operations/operations.go:2", "msg": "copied"}\n{"source": "other"}\n{"source": "accou\n')
    assert rows(text.read_transfer_log(spark, str(tmp_path)), "kind", "msg", "stats.lastError") == [
        ("operations", "copied", None), ("stats", "m", "boom")]


def test_key_values_and_delimited(spark):
    line = F.lit("PartitionName=a  AllowQos=x,y Expr=p=q State=UP")
    kv = spark.range(1).select(text.parse_key_values(line).alias("m")).first().m
    assert kv == {"PartitionName": "a", "AllowQos": "x,y", "Expr": "p=q", "State": "UP"}
    again = spark.range(1).select(text.parse_key_values(F.lit("a=1 b=2 a=3")).alias("m")).first().m
    assert again == {"a": "3", "b": "2"}
    row = spark.range(1).select(text.parse_delimited(F.lit('1, "a,b", c'), "i INT, s STRING, t STRING", ",").alias("r")).first().r
    assert tuple(row) == (1, "a,b", "c")


def test_grants(spark):
    line = ('{"core_project_num": " R01 ", "project_start_date": "2020-01-02T00:00:00", "organization": {"org_name": null}, '
            '"principal_investigators": [{"profile_id": 1, "is_contact_pi": false}, {"profile_id": 2, "is_contact_pi": true}]}')
    row = grants.parse_grants(spark.createDataFrame([(line,)], "line string")).first()
    assert (row.project_num, row.start, row.end, row.org_name, row.pi_profile_ids) == ("R01", "2020-01-02", "", "", ["2"])
    both = grants.parse_grants(spark.createDataFrame([(line.replace("false", "true"),)], "line string")).first()
    assert both.pi_profile_ids == ["1", "2"]


def test_work_dir_is_new_each_time(spark):
    assert work_dir(spark, "x") != work_dir(spark, "x")


def test_md5_lists_name_folders_without_any(spark, tmp_path, rows):
    digests = spark.createDataFrame([("/a", "x", "0" * 32)], "folder string, name string, md5 string")
    target = str(tmp_path / "m")
    sink.write_md5_manifest(digests, digests.select("folder"), target)
    with pytest.raises(ValueError, match="/b"):
        sink.write_md5_manifest(digests.withColumn("name", F.lit("y")), spark.createDataFrame([("/a",), ("/b",)], "folder string"), target)
    assert rows(text.read_md5_manifest(spark, target)) == rows(digests)  # what was there stays


def test_reports_are_listed_newest_first(spark, tmp_path):
    import os

    report = spark.createDataFrame([("u", "/a", 1)], "User string, Folder string, DirSize bigint")
    for k, name in enumerate(("+b.csv", "+c.csv", "+a.csv")):
        sink.write_hotspots(report, str(tmp_path / "r" / name))
        for file in (tmp_path / "r" / name).iterdir():
            os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
    assert [r["report"] for r in src.read_report_listing(spark, str(tmp_path / "r")).collect()] == ["+a.csv", "+c.csv", "+b.csv"]
