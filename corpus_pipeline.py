"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of documents; the last returns the encoding of each document that is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coldledger.llm import bpe, decontam, exact, simhash, toxicity
from coldledger.llm.queries import CATEGORIES, MAX_BITS, SHINGLE, VOCABULARY
from coldledger.llm.shared import table
from coldledger.session import work_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.without_toxic(docs, chain)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, the one with the largest doc_id."""
    return exact.keep_one_of_each(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return simhash.keep_one_of_component(docs, shingle=SHINGLE, max_bits=MAX_BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level bpe", encode),
]

#: A classifier is fitted in the first stage, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = work_dir(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{base}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
