"""SimHash near-dedup: fingerprints, Golay-code fuzzy keys, verified links, components.

A fingerprint has 64 bits in three segments. If two fingerprints differ in at most two bits, some
segment has no error, and of the other two at least one has one error at most (pigeonhole). So a key is
an error-free segment e plus a Golay codeword index of another segment f: the nearest codeword on the
asking side, all codewords within 4 bits on the answering side. Six (e, f) orders cover all cases; each
hit is verified by the bit distance.

Keys that more than ``pair_bound`` different fingerprints share are not paired off. Their fingerprints
are linked exactly in another way: two fingerprints differ in two bits or fewer exactly if some word is
within one bit of both, so each is listed under itself and its 64 one-bit neighbours, and the members of
a list (65 at most can exist) are linked to its smallest. Nothing is dropped either way.

Rows with equal fingerprints are reduced to one before any of this.

Defined cases: null text counts as empty; no words: fingerprint zero, linked like any other; fewer words
than a shingle: the whole sequence is one shingle. A component's id is the smallest id in it that is not
null. Repeated rows are linked like copies. No rows: no rows. A surrogate fingerprint order decides ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.llm.components import component_labels
from coldledger.llm.golay import near_indices
from coldledger.llm.shared import checkpointed, map_batches, whole

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
ORDERS = tuple((e, f) for e in range(3) for f in range(3) if e != f)
CHUNK = 65_536  # hashes whose bits are counted at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the hashes of all shingles, repeats included."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at:at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


_LOWER = bytes(range(256)).lower()


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = 3) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("body"))
    return map_batches(rows, score, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _keys(prints: DataFrame) -> DataFrame:
    """(fp, key, asks): every key of a fingerprint, and whether it is one of the six it asks with."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [((fp >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
            near = [near_indices(p) for p in parts]
            for order, (e, f) in enumerate(ORDERS):
                keys = (near[f] | (parts[e][:, None] << 12) | (order << 40))
                at, slot = np.nonzero(near[f] >= 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[at].view(np.int64)), pa.array(keys[at, slot]), pa.array(slot == 0)],
                    ["fp", "key", "asks"])

    return map_batches(prints.select("fp"), expand, "fp long, key long, asks boolean")


def linked_pairs(prints: DataFrame, max_bits: int = 2, pair_bound: int = 64) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between different fingerprints, and (fp, links): how many others each has within ``max_bits`` bits.

    Links are all pairs of sparse keys and stars of crowded ones; they connect exactly the fingerprints that all pairs
    connect. The counts are those of all pairs, without listing them: two fingerprints that differ in one or two bits
    share exactly two lists of one-bit neighbours, so half the other members of its lists are a fingerprint's partners.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("Golay keys of three segments find up to two differing bits")
    keys = _keys(prints)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Most keys belong to one fingerprint alone; what several share is small and read three times.
    shared = checkpointed(keys.join(sizes, "key"))
    sparse = shared.where(F.col("n") <= pair_bound)
    distance = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    asking = sparse.where("asks").select("key", F.col("fp").alias("a"))
    answering = sparse.select("key", F.col("fp").alias("b"))
    pairs = (asking.join(answering, "key").where((F.col("a") != F.col("b")) & (distance <= max_bits))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    hot = checkpointed(shared.where(F.col("n") > pair_bound).select("fp").distinct())
    if max_bits == 2:
        pairs = checkpointed(pairs.distinct())
        flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
        listed = hot.select("fp", F.explode(flips).alias("middle"))
        least = listed.groupBy("middle").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
        lists = checkpointed(listed.join(least, "middle").select("fp", "low", "n"))
        stars = lists.where("fp != low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
        # Pairs of two hot fingerprints are all in the lists; a pair with another one shares no crowded key.
        hot_end = lambda end: hot.select(F.col("fp").alias(end), F.lit(True).alias(f"hot_{end}"))
        others = (pairs.join(hot_end("a"), "a", "left").join(hot_end("b"), "b", "left")
                  .where("hot_a is null or hot_b is null"))
        counts = _ends(others).unionByName(lists.select("fp", ((F.col("n") - 1) / 2).alias("links")))
        pairs = pairs.unionByName(stars).distinct()
    else:
        if max_bits == 1:
            flips = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
            other = hot.select(F.col("fp").alias("b"))
            flipped = hot.select(F.col("fp").alias("a"), F.explode(flips).alias("b")).join(other, "b")
            pairs = pairs.unionByName(flipped.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        pairs = checkpointed(pairs.distinct())
        counts = _ends(pairs)
    return pairs, counts.groupBy("fp").agg(F.sum("links").cast("long").alias("links"))


def _ends(pairs: DataFrame) -> DataFrame:
    """(fp, 1) for both ends of each pair."""
    return pairs.select(F.explode(F.array("a", "b")).alias("fp"), F.lit(1.0).alias("links"))


def _signed(word: int) -> int:
    return word - (1 << 64) if word >= 1 << 63 else word


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2, pair_bound: int = 64) -> DataFrame:
    """One row per document: id, fp, component_id, links (other fingerprints within ``max_bits`` bits of its own)."""
    rows = checkpointed(with_fingerprints(docs, id_col, text_col, shingle))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("low")))
    pairs, links = linked_pairs(prints, max_bits, pair_bound)
    labels = component_labels(pairs)
    rooted = prints.join(labels, prints["fp"] == labels["vertex"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select("fp", "component_id").join(links, "fp", "left")
    return rows.join(named, "fp", "left").select(
        F.col("id").alias(id_col), "fp", "component_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def keep_one_of_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                          max_bits: int = 2) -> DataFrame:
    """One document of each component, with all its columns: the smallest id, of texts under one id the smallest hash.

    A document is an id with its text: rows that repeat both stay or go together. Rows without an id stay.
    """
    named = docs.select(F.when(F.col(id_col).isNotNull(), F.struct(
        F.col(id_col).alias("id"), F.xxhash64(whole(F.col(text_col))).alias("body_hash"))).alias("id"),
        F.col(text_col).alias("text"))
    found = near_duplicates(named, "id", "text", shingle, max_bits)
    keep = found.where("id = component_id").select(
        F.col("id")["id"].alias("keep_id"), F.col("id")["body_hash"].alias("keep_hash")).distinct()
    same = (docs[id_col] == keep["keep_id"]) & (F.xxhash64(whole(docs[text_col])) == keep["keep_hash"])
    return docs.join(keep, same, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
