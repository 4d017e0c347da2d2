from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from coldledger.llm import sharding


def check_law(rows, shards):
    counts = [sum(r["shard"] == s for r in rows) for s in range(shards)]
    assert sum(counts) == len(rows) and max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_odd_rows(odd, none):
    rows = sharding.balanced_shards(odd, shards=4).collect()
    assert len(rows) == odd.count()
    check_law(rows, 4)
    got = {(r["size"], r["text_crc32"]) for r in rows}
    assert (1, 0) in got and (19, zlib.crc32(b"one two three four")) in got
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    assert sharding.balanced_shards(none).count() == 0


def test_groups_come_together(spark):
    docs = spark.range(6000).repartition(13).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 2400, F.col("id") % 800).otherwise(F.col("id")).cast("string").alias("text"))
    got = sharding.balanced_shards(docs).select("doc_id", "text_crc32", "shard", "slot").cache()
    check_law(got.collect(), 8)
    spread = {r["shards"]: r["groups"] for r in sharding.split_groups(got).collect()}
    assert spread == {1: 800}


def test_a_group_larger_than_a_shard(spark):
    docs = spark.range(4000).repartition(7).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 1500).cast("string")).alias("text"))
    rows = sharding.balanced_shards(docs).collect()
    check_law(rows, 8)
    hot = [sum(r["text_crc32"] == zlib.crc32(b"hot") and r["shard"] == s for r in rows) for s in range(8)]
    assert max(hot) >= 2 * 1334 / 8


def test_moves_lower_the_cut(spark):
    """Groups of many sizes, nearly all rows linked: fewer cut links with every round, close to the least in the end."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.floor(F.sqrt(F.col("id") * 8)).cast("string").alias("text"))
    cuts = [sharding.cut_links(sharding.balanced_shards(docs, shards=4, rounds=n)) for n in (0, 1, 3, 8)]
    assert cuts == sorted(cuts, reverse=True) and cuts[-1] < 0.1 * cuts[0]


@pytest.mark.parametrize("wanted,free", [
    ([[0, 5, 0], [0, 0, 0], [2, 1, 0]], [0, 3, 0]), ([[0, 9, 9], [9, 0, 9], [9, 9, 0]], [0, 0, 0]), ([[0, 4], [0, 0]], [0, 9])])
def test_quotas_leave_counts_as_they_were(wanted, free):
    given = sharding._quotas(wanted, free)
    k = len(free)
    net = [sum(given[i][j] for i in range(k)) - sum(given[j]) for j in range(k)]
    for i, low, end, to in sharding._free_moves(given):
        assert end <= free[i]
        net[i] -= end - low
        net[to] += end - low
    assert not any(net) and all(g <= w for gs, ws in zip(given, wanted, strict=True) for g, w in zip(gs, ws, strict=True))
