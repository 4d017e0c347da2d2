"""Ranked lexical search of all documents by Block-Max MaxScore over a sharded, compressed index.

Index: every task turns its documents into shards of at most ``SHARD_DOCS`` documents or ``SHARD_BYTES`` bytes of
text. A shard has, for every term that any query asks for, a posting list cut into blocks of ``BLOCK`` postings. A
block holds gaps between document numbers and term counts, packed in as few bytes as they need, and beside them its
competitive pairs: those (count, length) that no other posting of the block beats in both. Shards are rows of a
table in the shared folder. The corpus statistics (documents, their terms, documents per term) are sums over it.

Search: with the statistics a list's bound is the best value of its blocks' competitive pairs. In each shard a query's
lists are ordered by bound; the longest run of small lists that cannot lift a document over the threshold even
together is non-essential. The essential lists are read and give the candidates. The other lists, largest bound
first, only see candidates that could still get in: a candidate goes if its score, the maximum of the block it falls in
and the bounds of the lists behind stay below the threshold, and a block that no candidate needs is never unpacked.
A task keeps one heap per query over all its shards, so its threshold grows from shard to shard. The
heaps of the tasks are merged by a window.

Queries come in blocks of ``QUERY_BYTES`` of text, the only thing the driver holds and sends to the tasks (with one
count per different term of a block); each block is one scan. Nothing is cut: documents, texts and queries are whole.

Defined cases: null text has no terms. Rows are documents; a row without an id ranks behind others of the same
score, and a repeated row is listed as often as it occurs. An item row that repeats id and text counts once; items
without terms, or whose terms occur nowhere, have no rows. No documents or no items: no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldledger.llm.shared import map_batches
from coldledger.session import work_dir

SHARD_DOCS, SHARD_BYTES = 8192, 24_000_000
BLOCK = 128
QUERY_BYTES = 4_000_000
SCALE = 1_000_000_000
_LOWER = bytes(range(256)).lower()
#: Every byte to a blank, or to itself in lower case if a term may hold it: digits, letters, all of a non-ASCII character.
_TERM_BYTES = bytes(_LOWER[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
INDEX_SCHEMA = ("ids array<long>, lengths binary, n_docs long, n_terms long, "
                "terms array<binary>, dfs array<long>, lists array<binary>")


def split_terms(text: str | None) -> list[bytes]:
    """Terms in order: runs of ASCII letters, digits and non-ASCII characters, A to Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


# --- posting lists -------------------------------------------------------------------------------------------------

def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Code of the narrowest unsigned type that holds all values, and their bytes."""
    top = int(values.max())
    code = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2
    return code, values.astype((np.uint8, np.uint16, np.uint32)[code]).tobytes()


_TYPES = (np.dtype("u1"), np.dtype("u2"), np.dtype("u4"))


def competitive(counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (count, length) pairs that no other pair beats: more of the term in a shorter document."""
    order = np.lexsort((lengths, -counts))
    c, n = counts[order], lengths[order]
    best = np.minimum.accumulate(n)
    stays = np.ones(len(c), dtype=bool)
    stays[1:] = n[1:] < best[:-1]
    return c[stays], n[stays]


def pack_list(numbers: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> bytes:
    """Posting list of one term. lengths: of the documents with these numbers.

    Layout (32-bit words): number of blocks; for each block its first and last document, number of postings,
    number of competitive pairs, type codes, offset and the pairs' place; then all pairs; then the packed postings.
    """
    heads, pairs, packed, offset, n_pairs = [], [], [], 0, 0
    for start in range(0, len(numbers), BLOCK):
        docs, tf = numbers[start:start + BLOCK], counts[start:start + BLOCK]
        c, n = competitive(tf, lengths[start:start + BLOCK])
        gap_code, gaps = _narrow(np.diff(docs, prepend=docs[:1]))
        tf_code, tfs = _narrow(tf)
        heads.append((docs[0], docs[-1], len(docs), len(c), gap_code * 4 + tf_code, offset, n_pairs))
        pairs.append(np.column_stack((c, n)))
        packed += [gaps, tfs]
        offset += len(gaps) + len(tfs)
        n_pairs += len(c)
    return b"".join([np.array([len(heads)], "<u4").tobytes(), np.array(heads, "<u4").tobytes(),
                     np.concatenate(pairs).astype("<u4").tobytes(), *packed])


class PostingList:
    """A packed list of one shard with the values of its term; blocks are unpacked only when asked for."""

    def __init__(self, packed: bytes, weight: int, norms: np.ndarray, norm_of):
        blocks = int(np.frombuffer(packed, "<u4", 1)[0])
        heads = np.frombuffer(packed, "<u4", blocks * 7, 4).reshape(blocks, 7).astype(np.int64)
        self.first, self.last, self.sizes, n_pairs, self.codes, self.offsets, self.pairs_at = heads.T
        pairs = np.frombuffer(packed, "<u4", int(n_pairs.sum()) * 2, 4 + blocks * 28).reshape(-1, 2).astype(np.int64)
        self.body, self.start = packed, 4 + blocks * 28 + len(pairs) * 8
        self.weight, self.norms = weight, norms
        self.block_max = np.maximum.reduceat(value(weight, pairs[:, 0], norm_of(pairs[:, 1])), self.pairs_at)
        self.bound = int(self.block_max.max())
        self.unpacked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Document numbers and values of block k."""
        if k not in self.unpacked:
            gaps, tfs = _TYPES[self.codes[k] // 4], _TYPES[self.codes[k] % 4]
            at, size = self.start + int(self.offsets[k]), int(self.sizes[k])
            docs = self.first[k] + np.cumsum(np.frombuffer(self.body, gaps, size, at).astype(np.int64))
            counts = np.frombuffer(self.body, tfs, size, at + size * gaps.itemsize).astype(np.int64)
            self.unpacked[k] = docs, value(self.weight, counts, self.norms[docs])
        return self.unpacked[k]


# --- scores --------------------------------------------------------------------------------------------------------

def value(weight: int, counts: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a term that occurs so often adds to documents with these norms."""
    return weight * ((SCALE * counts) // (1000 * counts + 12 * norms))


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if n_terms and 25 * int(lengths.max(initial=0)) * n_docs >= 1 << 63:  # too long for 64 bits: exact integers
        return np.array([75 + 25 * int(n) * n_docs // n_terms for n in lengths], np.int64)
    return 75 + (25 * lengths * n_docs) // max(1, n_terms)


# --- index ---------------------------------------------------------------------------------------------------------

class _Shard:
    def __init__(self):
        self.ids, self.lengths, self.lists, self.bytes, self.n_docs, self.n_terms = [], [], {}, 0, 0, 0

    def add(self, doc_id: int | None, words: list[bytes], asked: frozenset[bytes]) -> None:
        self.bytes += sum(map(len, words))
        self.n_docs += bool(words)
        self.n_terms += len(words)
        found = Counter(filter(asked.__contains__, words))
        if found:  # documents without any asked term only count
            for term, count in found.items():
                self.lists.setdefault(term, []).append((len(self.ids), count))
            self.ids.append(doc_id)
            self.lengths.append(len(words))

    def row(self) -> pa.RecordBatch:
        lengths = np.array(self.lengths, np.int64)
        packed, dfs = [], []
        for postings in self.lists.values():
            numbers, counts = np.array(postings, np.int64).T
            packed.append(pack_list(numbers, counts, lengths[numbers]))
            dfs.append(len(postings))
        return pa.RecordBatch.from_arrays(
            [pa.array([self.ids], pa.list_(pa.int64())), pa.array([lengths.astype("<u4").tobytes()], pa.binary()),
             pa.array([self.n_docs]), pa.array([self.n_terms]), pa.array([list(self.lists)], pa.list_(pa.binary())),
             pa.array([dfs], pa.list_(pa.int64())), pa.array([packed], pa.list_(pa.binary()))],
            names=["ids", "lengths", "n_docs", "n_terms", "terms", "dfs", "lists"])


def build_index(docs: DataFrame, asked: frozenset[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of the documents, for the terms in ``asked``."""
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, split_terms(text.as_py()), asked)
                if len(shard.ids) >= SHARD_DOCS or shard.bytes >= SHARD_BYTES:
                    yield shard.row()
                    shard = _Shard()
        if shard.n_docs:
            yield shard.row()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_batches(rows, shards, INDEX_SCHEMA)


# --- search --------------------------------------------------------------------------------------------------------

class TopK:
    """The k best (score, id) of one query; equal scores by ascending id, a missing id last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    @property
    def threshold(self) -> int:
        """A document below this score cannot get in."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def search_shard(query: list[tuple[PostingList, int]], ids: list[int | None], best: TopK) -> None:
    """Block-Max MaxScore over one shard. query: lists with how often the query names the term."""
    lists = sorted(query, key=lambda entry: entry[0].bound * entry[1])
    behind = np.concatenate(([0], np.cumsum([postings.bound * times for postings, times in lists])))
    # Lists before ``essential`` cannot reach the threshold even together.
    essential = int(np.searchsorted(behind, best.threshold, side="left")) - 1
    if essential >= len(lists):
        return
    scores = np.zeros(len(ids), np.int64)
    for postings, times in lists[essential:]:
        for k in range(len(postings.sizes)):
            docs, values = postings.block(k)
            scores[docs] += times * values
    found = np.flatnonzero(scores)
    scores = scores[found]
    for i in range(essential - 1, -1, -1):
        alive = scores + behind[i + 1] >= best.threshold
        found, scores = found[alive], scores[alive]
        postings, times = lists[i]
        block = np.searchsorted(postings.last, found)  # the block that each candidate would be in
        inside = block < len(postings.last)
        inside[inside] = postings.first[block[inside]] <= found[inside]
        most = np.where(inside, postings.block_max[np.minimum(block, len(postings.last) - 1)], 0)
        alive = scores + times * most + behind[i] >= best.threshold
        found, scores, block, inside = found[alive], scores[alive], block[alive], inside[alive]
        for k in np.unique(block[inside]):
            docs, values = postings.block(int(k))
            mine = np.flatnonzero(inside & (block == k))
            at = np.minimum(np.searchsorted(docs, found[mine]), len(docs) - 1)
            scores[mine] += np.where(docs[at] == found[mine], times * values[at], 0)
    alive = scores >= best.threshold
    found, scores = found[alive], scores[alive]
    for n in np.argsort(-scores, kind="stable"):  # best first, so that the threshold rises at once
        if scores[n] < best.threshold:
            break
        best.offer(int(scores[n]), ids[found[n]])


def _search_tasks(index: DataFrame, queries: list[dict[bytes, int]], weights: dict[bytes, int], n_docs: int,
                  n_terms: int, k: int) -> DataFrame:
    """(query number, doc_id, score): the k best of each task."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [TopK(k) for _ in queries]
        norm_of = lambda lengths: length_norms(lengths, n_docs, n_terms)
        for batch in batches:
            for n in range(batch.num_rows):
                ids = batch.column(0)[n].as_py()
                norms = norm_of(np.frombuffer(batch.column(1)[n].as_py(), "<u4").astype(np.int64))
                lists = {term.as_py(): PostingList(packed.as_py(), weights[term.as_py()], norms, norm_of)
                         for term, packed in zip(batch.column(2)[n].values, batch.column(3)[n].values, strict=True)}
                for query, best in zip(queries, heaps, strict=True):
                    here = [(lists[term], times) for term, times in query.items() if term in lists]
                    if here:
                        search_shard(here, ids, best)
        rows = [(q, -negated if named else None, score)
                for q, best in enumerate(heaps) for score, named, negated in best.heap]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    return map_batches(index.select("ids", "lengths", "terms", "lists"), search, "query long, doc_id long, score long")


def _query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Different (id, text) rows, some megabytes of text at a time."""
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["id"], Counter(split_terms(row["text"]))))
        size += len(row["text"] or "")
        if size >= QUERY_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, all of them if there are fewer."""
    spark = docs.sparkSession
    id_type = items.schema[item_col].dataType
    folder = work_dir(spark, "search")
    merged = None
    for number, block in enumerate(_query_blocks(items, item_col, item_text)):
        asked = frozenset(term for _, query in block for term in query)
        build_index(docs, asked, id_col, text_col).write.parquet(f"{folder}/{number}")
        index = spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/{number}")
        total = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
        n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
        # One row for each different term of the block's queries.
        dfs = (index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms")
               .agg(F.sum("t.dfs").alias("df")).collect())
        weights = {bytes(row["terms"]): term_weight(n_docs, row["df"]) for row in dfs}
        queries = [query for _, query in block]
        found = _search_tasks(index, queries, weights, n_docs, n_terms, k)
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)],
                                      f"query long, item {id_type.simpleString()}")
        ranked = (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                  .join(F.broadcast(names), "query").select(F.col("item").alias(item_col), "rank", "doc_id", "score"))
        merged = ranked if merged is None else merged.unionByName(ranked)
    if merged is None:
        merged = spark.createDataFrame([], f"{item_col} {id_type.simpleString()}, rank int, doc_id long, score long")
    return merged
