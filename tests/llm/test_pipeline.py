from __future__ import annotations

import public_tokenizers
import test_decontam
import test_simhash
import tiktoken

import corpus_pipeline
from coldledger.llm import bpe, toxicity
from coldledger.llm.queries import CATEGORIES

SF = "/root/testdata/sf0.001"


def test_rows_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    chain = toxicity.fit_chain(docs, spark.read.parquet(f"{SF}/labels.parquet"), CATEGORIES)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {i: t for i, t in texts.items() if chain.score(t)[-1] <= toxicity.THRESHOLD}
    last = {t: max(i for i, u in left.items() if u == t) for t in set(left.values())}
    left = {i: t for t, i in last.items()}
    prints = {i: test_simhash.slow_fingerprint(t) for i, t in left.items()}
    ids = sorted(left)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if bin(prints[a] ^ prints[b]).count("1") <= 2]
    roots = test_simhash.roots(ids, pairs)
    left = {i: t for i, t in left.items() if roots[i] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {i for i, _ in test_decontam.slow(list(left.items()), items)}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: library.encode_ordinary(t) for i, t in left.items() if i not in hit}
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame([(4, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for label, docs in (("odd", odd), ("none", none)):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{label}{number}"
            out = stage(spark, docs, str(tmp_path))
            if number < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            out.write.parquet(path)
            docs = spark.read.parquet(path)
