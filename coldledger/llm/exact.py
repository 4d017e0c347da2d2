"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one row of each text.

The hash (MD5, 128 bits) deals rows out; the text itself is the second grouping key, so two texts are
one group only if their bytes are the same, and equal hashes of different texts stay apart. Partial
aggregation reduces a text with any number of copies to one row per task before the shuffle.

Defined cases: null text counts as empty, so null and empty texts are one group. Rows without an id
count in ``group_size`` but are never named; a group without any id has a null ``keep_id``. Rows that
repeat an id and its text are the same document: each reports the same decision. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldledger.llm.shared import whole


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash_of=content_hash) -> DataFrame:
    """One row per different text: (h, sha, keep_id, group_size).

    The digest of the text comes along because decisions go back to the rows by (h, sha) instead of by
    text; should two different texts ever share both, the job fails rather than merge them.
    """
    text = whole(F.col(text_col))
    by_bytes = (
        docs.select(F.col(id_col).alias("id"), text.alias("body"), hash_of(text).alias("h"))
        .groupBy("h", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("body", 256).alias("sha"), "keep_id", "group_size"))
    return (
        by_bytes.groupBy("h", "sha")
        .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
             F.count(F.lit(1)).alias("texts"))
        .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
            F.raise_error(F.lit("different texts share both digests")).cast("long")))
        .drop("texts"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     hash_of=content_hash) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Only narrow rows meet in the join, and only groups of two or more are looked up; a hot group is
    split by the adaptive skew join, whose other side has one row for it.
    """
    text = whole(F.col(text_col))
    facts = docs.select(F.col(id_col), hash_of(text).alias("h"), F.sha2(text, 256).alias("text_sha256"))
    copies = (text_groups(docs, id_col, text_col, hash_of).where("group_size > 1")
              .withColumnRenamed("h", "gh").withColumnRenamed("sha", "text_sha"))
    joined = facts.join(
        copies, (F.col("h") == F.col("gh")) & (F.col("text_sha256") == F.col("text_sha")), "left")
    single = F.col("group_size").isNull()
    return joined.select(
        F.col(id_col),
        F.when(single, F.col(id_col)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.when(single, F.lit(True)).otherwise(F.col(id_col) == F.col("keep_id")),
                   F.lit(False)).alias("kept"),
        "text_sha256")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, exactly one for each text, with all their columns.

    One shuffle: the row with the largest id travels with its group. Ties between rows of the same id
    fall to the largest hash of all columns.
    """
    text = whole(F.col(text_col))
    rest = [c for c in docs.columns if c != text_col]
    rank = F.struct(F.col(f"`{id_col}`"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    named = docs.select(content_hash(text).alias("__h"), text.alias("__body"), rank.alias("__rank"),
                        F.struct(F.col(f"`{text_col}`").isNull().alias("__null"),
                                 *[F.col(f"`{c}`") for c in rest]).alias("__row"))
    kept = named.groupBy("__h", "__body").agg(F.max_by("__row", "__rank").alias("__row"))
    body = F.when(~F.col("__row").getField("__null"), F.col("__body"))
    return kept.select(*[
        body.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns])
