from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from coldledger.llm import exact


def test_odd_rows(odd, none):
    rows = exact.exact_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows}
    assert {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (4, 5, 4, False), (5, 5, 4, True), (None, 5, 4, False),
            (7, 7, 1, True), (3, 3, 1, True)} <= got
    assert {r["text_sha256"] for r in rows if r["doc_id"] == 1} == {hashlib.sha256(b"").hexdigest()}
    assert exact.exact_duplicates(none).count() == 0 and exact.keep_one_of_each(none).count() == 0


def test_stage_keeps_one_row_of_each_text(odd):
    kept = exact.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9]
    row = next(r for r in kept.collect() if r["doc_id"] == 3)
    assert row["text"] == "   \t\n" and row["source"] == "s" and row["h"] == "clash"


def test_null_text_survives_the_stage(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [tuple(r) for r in exact.keep_one_of_each(docs).collect()] == [(2, None, "b")]


def test_equal_hashes_of_different_texts_stay_apart(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "efg")], "doc_id long, text string")
    weak = lambda text: F.unhex(F.md5(F.length(text).cast("string")))
    got = sorted(tuple(r)[:4] for r in exact.exact_duplicates(docs, hash_of=weak).collect())
    assert got == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)]


@pytest.mark.parametrize("rows", [3000])
def test_hot_group(spark, rows):
    docs = spark.range(rows).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact.exact_duplicates(docs)
    assert got.where("group_size = 1000").count() == 1000 and got.where("kept").count() == 2001
