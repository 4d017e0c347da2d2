from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from coldledger.llm import langid


def test_codewords_correct_errors():
    for n in (2, 3, 4, 7, 8, 30, 150):
        code = langid.codewords(n)
        distance = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert distance >= (1 if n < 3 else 2 if n == 3 else 4)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_held_out_accuracy(spark):
    from coldledger.llm.queries import op6_language_id

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op6_language_id(spark, sf).join(docs, "doc_id").where("held_out")
    right, n, low, high = got.agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 100 and right > 0.95 and 0 <= low and high <= 1


def test_odd_rows(spark, odd, none):
    learn = F.lit(True)
    model = langid.fit(odd, learn)
    rows = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[1]["score"] == 0
    assert rows[6]["lang_pred"] in ("en", "de") and len(rows) == 10
    assert langid.fit(none, learn) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    one = langid.fit(odd.where("lang = 'en'"), learn)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, one).collect()}
    assert got[4] == ("en", 1.0) and got[2] == ("und", 0.0)


def test_chunks_change_nothing(monkeypatch):
    text = "some longer text with ünïcode " * 50
    whole = langid.features(text)
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert np.allclose(langid.features(text), whole)
