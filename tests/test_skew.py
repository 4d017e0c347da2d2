"""The ways around hot keys give exactly the rows of the plain operators."""
from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from coldledger import skew
from coldledger.operators import activity, bundle, catalogue as cat, entitlements as ent, ownership

@pytest.fixture
def no_broadcast(spark):
    """Plans of lookup tables that are too large for a broadcast, with small skewed partitions split."""
    forced = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB"}
    before = {k: spark.conf.get(k, None) for k in forced}
    for k, v in forced.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def same(a, b):
    columns = sorted(a.columns)
    listed = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    return columns == sorted(b.columns) and listed(a) == listed(b)


@pytest.fixture(scope="module")
def facts(spark):
    # One key owns a third of the rows, some keys are null.
    return spark.range(30_000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id % 900 END AS k")


@pytest.fixture(scope="module")
def beats(spark):
    return spark.range(5_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 40 END AS host",
        "timestamp_seconds(1700000000 + (id * 7919) % 700000) AS ts", "id AS seq",
        "CASE WHEN (id * 31) % 17 < 1 THEN 0 ELSE 1 END AS idle", "id % 13 AS v")


def test_bucketed_previous(beats):
    plain = Window.partitionBy("host").orderBy("ts", "seq")
    want = beats.select("*", F.lag("v").over(plain).alias("prev_v"), F.lag("ts").over(plain).alias("prev_ts"))
    got = skew.bucketed_previous(beats, "host", ["ts", "seq"], ["v", "ts"])
    assert same(got, want)


def test_bucketed_running_sum(beats):
    plain = Window.partitionBy("host").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = beats.select("*", F.sum("v").over(plain).alias("total"))
    assert same(skew.bucketed_running_sum(beats, "host", ["ts", "seq"], {"v": "total"}, "hour"), want)


@pytest.mark.parametrize("partitions", [1, 5, 64])
def test_ordered_previous_and_running_sum(spark, beats, partitions):
    plain = Window.partitionBy("host").orderBy("ts", "seq")
    some = beats.where("seq % 9 < 5").withColumn("host", F.expr("nullif(host, 5)"))
    want = some.select("*", F.lag("v").over(plain).alias("prev_v"), F.lag("ts").over(plain).alias("prev_ts"))
    assert same(skew.ordered_previous(some, "host", ["ts", "seq"], ["v", "ts"], partitions=partitions), want)
    want = some.select("*", F.sum("v").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    assert same(skew.ordered_running_sum(some, "host", ["ts", "seq"], {"v": "total"}, partitions), want)
    assert skew.ordered_previous(some.limit(0), "host", ["ts", "seq"], ["v"]).count() == 0
    assert skew.ordered_running_sum(some.limit(0), "host", ["ts", "seq"], {"v": "total"}).count() == 0


def test_a_third_of_one_day_in_one_host_is_spread(spark):
    """No task gets twice the median when one host has a third of all rows within one day."""
    rows = spark.range(60_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id % 997 END AS host", "timestamp_seconds(1700000000 + (id * 7919) % 80000) AS ts",
        "id AS seq", "id AS write_bytes", "id AS sent_bytes", "id AS recv_bytes")
    placed = [r["count"] for r in skew._in_order(rows, "host", ["ts", "seq"], 24).groupBy(F.spark_partition_id()).count().collect()]
    assert len(placed) == 24 and max(placed) < 2 * sorted(placed)[12]
    assert activity.io_rates(rows, 24).count() == 60_000 - rows.select("host").distinct().count()


def brute_streaks(rows):
    hosts = {}
    for r in sorted(rows, key=lambda r: (r.host, r.ts, r.seq)):
        hosts.setdefault(r.host, []).append(r.idle)
    out = {}
    for host, states in hosts.items():
        run = 0
        for state in reversed(states):
            if not state:
                break
            run += 1
        out[host] = (len(states), run)
    return out


def test_idle_streak_brute_force(beats):
    got = {r.host: (r.runs, r.streak) for r in activity.idle_streak(beats).collect()}
    assert got == brute_streaks(beats.collect())


@pytest.mark.parametrize("states, idle", [
    ([1] * 71, False), ([1] * 72, True), ([1] * 80 + [0], False), ([0] + [1] * 72, True)])
def test_idle_limit(spark, states, idle):
    rows = [(1, 1_700_000_000 + i * 3600, i, s) for i, s in enumerate(states)]
    df = spark.createDataFrame(rows, "host bigint, t bigint, seq bigint, idle int").withColumn("ts", F.timestamp_seconds("t"))
    assert activity.idle_streak(df).first().is_idle is idle


def test_resolve_owner_without_broadcast(spark, facts, no_broadcast):
    files = facts.selectExpr("'/f' AS folder", "CAST(id AS STRING) AS name", "k AS uid", "id % 9 AS gid")
    users = spark.range(500).selectExpr("id AS uid", "concat('u', id) AS user")
    groups = spark.range(5).selectExpr("id AS gid", "concat('g', id) AS group_name")
    got = {(r.name, r.owner, r.group_name) for r in ownership.resolve_owner(files, users, groups).collect()}
    want = set()
    for r in facts.collect():
        uid, gid = r.k, r.id % 9
        owner = None if uid is None else f"u{uid}" if uid < 500 else str(uid)
        want.add((str(r.id), owner, f"g{gid}" if gid < 5 else str(gid)))
    assert got == want and len(got) == 30_000


def test_lookup_and_bundles_without_broadcast(spark, no_broadcast):
    folders = spark.range(3_000).selectExpr("concat('/hot/', id % 40, '/', id) AS folder")
    record = {c: F.lit("x") for c in cat.RECORD}
    catalogue = spark.range(10).selectExpr("concat('/hot/', id) AS folder_key").unionByName(
        spark.createDataFrame([("/hot",)], "folder_key string")).withColumns(record).withColumns(
        {"archive_mode": F.lit("Recursive"), "local_folder": F.col("folder_key")})
    found = {r.folder: r.matched_folder for r in cat.catalogue_lookup(folders, catalogue).collect()}
    assert len(found) == 3_000 and found["/hot/3/3"] == "/hot/3" and found["/hot/39/39"] == "/hot"
    small = spark.range(2_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN '/hot' ELSE concat('/', id % 50) END AS folder", "CAST(id AS STRING) AS name",
        "id % 900 AS size", "repeat('x', CAST(id % 900 AS INT)) AS content")
    packed = bundle.bundle_small(small, target_bytes=4096)
    assert same(bundle.unbundle(packed), small)
    assert packed.where("folder = '/hot'").agg(F.max("bytes")).first()[0] < 4 * 4096


def test_entitlements_without_broadcast(spark, no_broadcast):
    principals = spark.range(600).selectExpr(
        "id AS principal", "concat('a', id % 4) AS account", "array(concat('g', id % 5)) AS groups",
        "array('x', 'y') AS options")
    policies = spark.createDataFrame([
        ("p1", "UP", [], [], [], ["ALL"], [], ["ALL"]), ("p2", "UP", ["g1"], [], [], ["g1", "g2"], [], ["x"]),
        ("p3", "UP", [], ["a2"], ["ALL"], [], ["y"], ["ALL"]), ("p4", "DOWN", [], [], ["ALL"], ["ALL"], [], []),
        ("p5", "UP", [], [], ["a1"], ["ALL"], [], []), ("p6", "UP", [], [], [], ["ALL", "g9"], [], ["ALL"])],
        "resource string, state string, deny_groups array<string>, deny_accounts array<string>, "
        "allow_accounts array<string>, allow_groups array<string>, deny_options array<string>, allow_options array<string>")
    got = {(r.principal, r.resource): r.options for r in ent.entitlements(principals, policies).collect()}
    want = {}
    for p in principals.collect():
        for r in policies.collect():
            if r.state != "UP" or set(r.deny_groups) & set(p.groups) or p.account in r.deny_accounts:
                continue
            if r.allow_accounts:
                allowed = p.account in r.allow_accounts or "ALL" in r.allow_accounts
            else:
                allowed = bool(set(r.allow_groups) & set(p.groups)) or r.allow_groups == ["ALL"]
            if allowed:
                if r.deny_options:
                    left = [o for o in p.options if o not in r.deny_options]
                elif r.allow_options == ["ALL"]:
                    left = p.options
                else:
                    left = [o for o in p.options if o in r.allow_options]
                want[(p.principal, r.resource)] = sorted(left)
    assert got == want
