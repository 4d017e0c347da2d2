"""Streams over several files give what the batch operators give over all rows."""
from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from coldledger.operators import activity, inventory as inv
from coldledger.streaming import jobs, tables


def arrive(spark, df, path, order, files=4):
    """Write ``df`` as several files and read them back as a stream, one file per micro-batch."""
    n = df.count()
    import os
    import time

    for i in range(files):
        part = df.where((F.col(order) >= i * n // files) & (F.col(order) < (i + 1) * n // files))
        part.coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == files
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.fixture(scope="module")
def events(spark):
    return spark.range(400).selectExpr(
        "id AS seq", "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 7 END AS host",
        "timestamp_seconds(1700000000 + id * 45) AS ts", "CASE WHEN id % 29 = 5 THEN 0 ELSE 1 END AS idle",
        "id * 900000 AS write_bytes", "id AS sent_bytes", "id AS recv_bytes")


def listed(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_idle_streak(spark, events, tmp_path):
    got = jobs.stream_idle_streak(
        arrive(spark, events.select("host", "ts", "seq", "idle"), tmp_path / "in", "seq"),
        str(tmp_path / "t"), str(tmp_path / "c"), 4)
    want = activity.idle_streak(events, 4)
    assert listed(got, want.columns) == listed(want, want.columns)


@pytest.mark.parametrize("delay, order", [(None, "back"), ("10 minutes", "seq")])
def test_activity(spark, events, tmp_path, delay, order):
    """Without a delay rows may arrive in any order, here newest first."""
    rows = events.withColumn("back", 399 - F.col("seq"))
    got = jobs.stream_activity(
        arrive(spark, rows, tmp_path / "in", order), str(tmp_path / "t"), str(tmp_path / "c"), delay=delay)
    want = activity.activity_windows(events)
    assert listed(got, want.columns) == listed(want, want.columns)


def test_restore_state_with_duplicates_and_late_rows(spark, tmp_path):
    rows = spark.range(200).selectExpr(
        "id AS seq", "concat('/f', id % 5) AS folder", "CAST(id % 11 AS STRING) AS name",
        "timestamp_seconds(1700000000 + (id * 37) % 5000) AS ts",
        "element_at(array('triggered', 'restoring', 'restored', 'not_glacier'), CAST(id % 4 + 1 AS INT)) AS state",
        "id AS pos")
    twice = rows.unionByName(rows.withColumn("pos", F.col("pos") + 200))
    got = jobs.stream_restore_state(
        arrive(spark, twice, tmp_path / "in", "pos").drop("pos"), str(tmp_path / "t"), str(tmp_path / "c"))
    want = jobs.restore_events_state(rows)
    assert listed(got, want.columns) == listed(want, want.columns)


def test_folder_rollup_and_resume(spark, tmp_path):
    files = spark.range(100).selectExpr("id", "concat('/f', id % 6) AS folder", "id AS size")
    stream = arrive(spark, files, tmp_path / "in", "id")
    table, progress = str(tmp_path / "t"), str(tmp_path / "c")
    jobs.stream_folder_rollup(stream, table, progress)
    more = files.withColumns({"id": F.col("id") + 100, "folder": F.lit("/late")})
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = jobs.stream_folder_rollup(stream, table, progress)
    want = inv.folder_rollup(files.unionByName(more))
    assert listed(got, want.columns) == listed(want, want.columns)


SUMS = "folder string, n long"


def _table(spark, root, batches=range(5)):
    for k in batches:
        rows = spark.createDataFrame([(f"/f{k % 2}", 10 ** k), ("/all", 1)], SUMS).coalesce(1)
        rows.write.mode("overwrite").parquet(tables.batch_path(root, k))


def _sums(rows):
    return rows.groupBy("folder").agg(F.sum("n").alias("n"))


def test_compaction_changes_no_sum(spark, tmp_path):
    root, schema = str(tmp_path / "t"), spark.createDataFrame([], SUMS).schema
    assert tables.read_table(spark, root, schema).count() == 0 and tables.compact(spark, root, schema, _sums) == -1
    _table(spark, root)
    want = listed(_sums(tables.read_table(spark, root, schema)), ["folder", "n"])
    assert want == [("/all", 5), ("/f0", 10101), ("/f1", 1010)]
    assert tables.compact(spark, root, schema, _sums) == 3
    assert sorted(os.listdir(root)) == ["batch=000000000004", "upto=000000000003"]
    assert listed(_sums(tables.read_table(spark, root, schema)), ["folder", "n"]) == want
    _table(spark, root, [4])  # the stream writes its last batch anew
    assert listed(_sums(tables.read_table(spark, root, schema)), ["folder", "n"]) == want
    _table(spark, root, [5])
    assert tables.compact(spark, root, schema, _sums) == 4
    assert listed(_sums(tables.read_table(spark, root, schema)), ["folder", "n"]) == [("/all", 6), ("/f0", 10101), ("/f1", 101010)]


@pytest.mark.parametrize("dies", ["rename_new", "clean"])
def test_compaction_that_dies_midway(spark, tmp_path, monkeypatch, dies):
    root, schema = str(tmp_path / "t"), spark.createDataFrame([], SUMS).schema
    _table(spark, root)
    want = listed(_sums(tables.read_table(spark, root, schema)), ["folder", "n"])

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(tables, dies, stop)
        with pytest.raises(KeyboardInterrupt):
            tables.compact(spark, root, schema, _sums)
    assert listed(_sums(tables.read_table(spark, root, schema)), ["folder", "n"]) == want
    tables.compact(spark, root, schema, _sums)
    assert listed(_sums(tables.read_table(spark, root, schema)), ["folder", "n"]) == want
    assert [n for n in sorted(os.listdir(root)) if not n.startswith(".")] == ["batch=000000000004", "upto=000000000003"]


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    root, schema = str(tmp_path / "t"), spark.createDataFrame([], SUMS).schema
    _table(spark, root, [0, 1])
    os.remove(f"{tables.batch_path(root, 1)}/_SUCCESS")
    assert tables.read_table(spark, root, schema).count() == 2


def test_idle_streak_goes_on_in_the_next_run(spark, events, tmp_path):
    beats = events.select("host", "ts", "seq", "idle")
    table, progress = str(tmp_path / "t"), str(tmp_path / "c")
    stream = arrive(spark, beats.where("seq < 200"), tmp_path / "in", "seq", 1)
    jobs.stream_idle_streak(stream, table, progress, 4)
    beats.where("seq >= 200").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = jobs.stream_idle_streak(stream, table, progress, 4)
    want = activity.idle_streak(events, 4)
    assert listed(got, want.columns) == listed(want, want.columns)
