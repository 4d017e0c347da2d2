from __future__ import annotations

from pyspark.sql import functions as F

from coldledger.llm import toxicity
from coldledger.llm.queries import CATEGORIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0
    chain = toxicity.fit_chain(docs, labels.where(~held), CATEGORIES)
    truth = labels.where(held).select("doc_id", F.col("toxic").alias("truth"))
    got = toxicity.score_documents(docs, chain).join(truth, "doc_id")
    hit, n_toxic, wrong, n_clean = got.select(F.col("toxic").cast("int").alias("said"), "truth").agg(
        F.sum(F.col("said") * F.col("truth")), F.sum("truth"),
        F.sum(F.col("said") * (1 - F.col("truth"))), F.sum(1 - F.col("truth"))).first()
    # One in seven toxic labels lies on a text without any sign of it.
    assert hit > 0.8 * n_toxic and wrong < 0.01 * n_clean


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(4, 1, 1), (5, 1, 0), (6, 0, 0), (7, 1, 1), (7, 1, 0), (8, None, 0), (None, 1, 1), (9, 1, 0), (99, 1, 1)],
        "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(odd, labels, CATEGORIES)
    rows = toxicity.score_documents(odd, chain).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r for r in rows}
    assert not any(got[i]["toxic"] for i in (1, 2, 3)) and got[1]["p_toxic"] == 0
    kept = toxicity.without_toxic(odd, chain)
    assert kept.columns == odd.columns and {1, 2, 3} <= {r["doc_id"] for r in kept.collect()}
    assert toxicity.score_documents(none, chain).count() == 0


def test_nothing_to_learn(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for docs in (odd, none):
        chain = toxicity.fit_chain(docs, labels, CATEGORIES)
        assert toxicity.without_toxic(docs, chain).count() == docs.count()
    one_class = spark.createDataFrame([(4, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(odd, one_class, CATEGORIES)
    assert toxicity.score_documents(odd, chain).where("toxic").count() == 0


def test_features_are_shares_of_the_words():
    chain = toxicity.Chain(["bad", "badwo*"], [])
    columns, values, words = chain.features("Bad badword badwords " + "fine " * 997)
    assert columns.tolist() == [0, 1] and words == 1000
    assert [round(v, 6) for v in values] == [round(0.001 / toxicity.SHARE_AT_ONE, 6), round(0.002 / toxicity.SHARE_AT_ONE, 6)]
