"""Language-model scoring by prediction by partial matching (PPM), pretrained on the corpus.

A document is its lower-cased words joined by single spaces and one end symbol, coded byte by byte. The
contexts are the ORDER bytes before (start symbols before the first byte) and all their shorter ends,
which form a trie. Each order estimates its escape by method D (a symbol seen c of T times has (2c - 1) / 2T,
d different ones leave d / 2T to the next shorter context); a symbol that a longer context knows is excluded
from the shorter ones. The score is the negated code length, as a log10 probability. A plain
unigram score of the words (add-one counts) comes along.

How it is dealt out: documents form blocks of about ``BLOCK_BYTES`` by a hash. Each block lists its
different byte grams and words, once each, with their training counts. The lists are summed to the
counts of the corpus. Grams that share the last three context bytes lie in one part of the trie and get their
probabilities together; many such contexts, dealt by hash, make a part of about ``PART_GRAMS`` grams, and one
context has 2 ** 24 different grams at most, whatever the rows. Contexts of two bytes and fewer are one table
of at most 2 ** 24 counts (16 bytes each; text in UTF-8 has far fewer) that every part gets. The values return to
the blocks that asked and meet the documents there. So no task holds more than its block and the answers for
it, while the model grows with the corpus. Working tables go as soon as nothing reads them any more.

Defined cases: null text counts as empty: one end symbol, one token. Rows without an id are scored like
others, are not learned from and count as held out. Repeated rows count as often as they occur. Without
training documents every symbol has probability 1/256. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldledger.llm.shared import ship_package, whole
from coldledger.session import work_dir
from coldledger.sinks.storage import remove

ORDER = 5
BLOCK_BYTES = 8_000_000
CHUNK_BYTES = 1_000_000  # text of a block that is split into grams at a time
PART_GRAMS = 50_000
SLICE_ROWS = 100_000  # facts that a worker hands over at a time
ROW_GROUP_BYTES = 16 << 20  # of the working tables; a task buffers this much of each file it writes
START, END = 0xFE, 0xFF  # bytes that UTF-8 text never has
SYMBOLS = 256
_LOWER = bytes(range(256)).lower()


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def gram_codes(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Code of each gram (context and symbol as one number) of all documents, and the grams of each."""
    pad = bytes([START]) * ORDER
    lines = [b" ".join(words) for words in docs]
    data = b"".join([pad + line + bytes([END]) for line in lines])
    sizes = np.array([len(line) + 1 for line in lines], dtype=np.int64)
    if not lines:
        return np.zeros(0, np.int64), sizes
    # Eight bytes from every place, read as one number; the first ORDER + 1 of them are the gram.
    eight = np.ndarray((len(data) - ORDER,), ">u8", data + bytes(8), strides=(1,))
    codes = eight.astype(np.uint64)
    codes >>= np.uint64(8 * (7 - ORDER))
    # Grams that reach from one document's end into the next one's start are cut out.
    inside = np.ones(len(codes), dtype=bool)
    ends = np.cumsum(sizes + ORDER)[:-1] - ORDER
    inside[(ends[:, None] + np.arange(ORDER)).ravel()] = False
    return codes[inside].view(np.int64), sizes


def _chunks(texts: pa.ChunkedArray) -> Iterator[list[list[bytes]]]:
    """Words of some documents at a time."""
    part, size = [], 0
    for text in texts:
        words = split_words(text.as_py())
        part.append(words)
        size += sum(map(len, words)) + len(words) + ORDER
        if size >= CHUNK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each different value of a sorted array begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1])))


def _block_facts(docs: pa.Table) -> pa.Table:
    """(block, code, word, n): all grams and words of a block with their counts in training documents."""
    block = docs["block"][0].as_py()
    codes, counts, words = [], [], []
    for train in (True, False):
        for split in _chunks(docs.filter(pc.equal(docs["train"], train))["body"]):
            ordered = np.sort(gram_codes(split)[0])
            starts = _runs(ordered)
            codes.append(ordered[starts])
            counts.append(np.diff(starts, append=len(ordered)) * train)
            counted = pc.value_counts(_tokens(split))
            words.append(pa.table({"word": counted.field("values"), "n": pc.multiply(counted.field("counts"), int(train))}))
            pa.default_memory_pool().release_unused()
    code, n = np.concatenate(codes), np.concatenate(counts)
    del codes, counts
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    del order
    starts = _runs(code)
    code, n = code[starts], np.add.reduceat(n, starts)
    summed = pa.concat_tables(words).group_by("word").aggregate([("n", "sum")])
    rows = lambda size, code, word, n: pa.table({
        "block": pa.array(np.full(size, block)), "code": code, "word": word, "n": n})
    return pa.concat_tables([
        rows(len(code), pa.array(code), pa.nulls(len(code), pa.binary()), pa.array(n, pa.int64())),
        rows(len(summed), pa.nulls(len(summed), pa.int64()), summed["word"], summed["n_sum"].cast(pa.int64()))])


def _facts_in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The facts of one block, a slice at a time, so that neither side of the pipe holds all of them as one message."""
    yield from _block_facts(pa.Table.from_batches(list(batches))).to_batches(max_chunksize=SLICE_ROWS)
    pa.default_memory_pool().release_unused()


def _tokens(split: list[list[bytes]]) -> pa.Array:
    """The words of all documents, each document's followed by its end token, the empty word."""
    return pa.array([w for words in split for w in (*words, b"")], pa.binary())


class _Level:
    """Counts of one context length: for each row its gram's count and its context's total and variety."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        grams, self.first, self.gram = np.unique(context * SYMBOLS + symbol, return_index=True, return_inverse=True)
        self.counts = np.bincount(self.gram, n)
        _, self.node = np.unique(grams // SYMBOLS, return_inverse=True)
        self.total, self.variety = self._sum(self.counts), self._sum(self.counts > 0)

    def _sum(self, per_gram: np.ndarray) -> np.ndarray:
        """Sum over the symbols of each row's context."""
        return np.bincount(self.node, per_gram)[self.node][self.gram]

    def known_in(self, shorter: np.ndarray) -> np.ndarray:
        """For each row the counts that a shorter context gives to the symbols this context knows."""
        return self._sum(np.where(self.counts > 0, shorter[self.first], 0))

    @property
    def count(self) -> np.ndarray:
        return self.counts[self.gram]


class ShortContexts:
    """Counts of the contexts of two bytes and fewer, from the counts n > 0 of all grams' last three bytes."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.n = codes[order], n[order]
        two = self.codes >> 8
        self.pairs = np.bincount(self.codes & 0xFFFF, self.n, SYMBOLS ** 2).reshape(SYMBOLS, SYMBOLS)
        self.single = self.pairs.sum(axis=0)
        self.total_two, self.variety_two = np.bincount(two, self.n, SYMBOLS ** 2), np.bincount(two, minlength=SYMBOLS ** 2)
        # What the next shorter context counts for the symbols that a context knows.
        self.known_two = np.bincount(two, self.pairs.ravel()[self.codes & 0xFFFF], SYMBOLS ** 2)
        self.known_one = (self.pairs > 0) @ self.single

    def count_two(self, codes: np.ndarray) -> np.ndarray:
        """Training counts of (two context bytes, symbol), 0 if there are none."""
        if not len(self.codes):
            return np.zeros(len(codes))
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.n[at], 0)


def gram_log_probabilities(codes: np.ndarray, n: np.ndarray, short: ShortContexts) -> np.ndarray:
    """log10 probabilities of grams with training counts n.

    The grams must be all with the last three context bytes that occur among them.
    """
    context, symbol = codes >> 8, codes % SYMBOLS
    levels = [_Level(context % (SYMBOLS ** k), symbol, n) for k in range(ORDER, 2, -1)]
    two, one = context % (SYMBOLS ** 2), context % SYMBOLS
    c2, c1, c0 = short.count_two(codes % (SYMBOLS ** 3)), short.pairs[one, symbol], short.single
    variety_one, variety_none = (short.pairs > 0).sum(axis=1), (c0 > 0).sum()
    orders = [(levels[0].count, levels[0].total, levels[0].variety)]
    for longer, level in zip(levels, levels[1:], strict=False):
        orders.append((level.count, level.total - longer.known_in(level.count), level.variety - longer.variety))
    orders.append((c2, short.total_two[two] - levels[-1].known_in(c2), short.variety_two[two] - levels[-1].variety))
    orders.append((c1, short.pairs.sum(axis=1)[one] - short.known_two[two], variety_one[one] - short.variety_two[two]))
    orders.append((c0[symbol], c0.sum() - short.known_one[one], variety_none - variety_one[one]))
    out, waiting = np.zeros(len(n)), np.ones(len(n), dtype=bool)
    for count, total, variety in orders:
        alive = waiting & (total > 0)
        here = alive & (count > 0)
        out[here] += np.log10((2 * count[here] - 1) / (2 * total[here]))
        escape = alive & ~here
        out[escape] += np.log10(variety[escape] / (2 * total[escape]))
        waiting &= ~here
    out[waiting] -= np.log10(max(1, SYMBOLS - variety_none))
    return out


def _score_block(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Scores of a block's documents from the values of their grams and words."""
    is_gram = pc.is_valid(answers["code"])
    grams_known, words_known = answers.filter(is_gram), answers.filter(pc.invert(is_gram))
    place = pd.Index(grams_known["code"].to_numpy())  # hashed once for all chunks
    gram_values = grams_known["value"].to_numpy()
    known_words, word_counts = words_known["word"].combine_chunks(), words_known["value"].to_numpy()
    tokens, known, logs, scores = [], [], [], []
    for split in _chunks(docs["body"]):
        grams, sizes = gram_codes(split)
        found = place.get_indexer(grams)
        if (found < 0).any():
            raise RuntimeError("a gram of a document has no value")
        scores.append(np.add.reduceat(gram_values[found], np.cumsum(sizes) - sizes))
        sizes = np.array([len(words) + 1 for words in split])
        seen = word_counts[pc.index_in(_tokens(split), value_set=known_words).to_numpy()]
        firsts = np.cumsum(sizes) - sizes
        tokens.append(sizes)
        known.append(np.add.reduceat((seen > 0).astype(np.int64), firsts))
        logs.append(np.add.reduceat(np.log10(seen + 1), firsts))
        pa.default_memory_pool().release_unused()
    joined = lambda parts: pa.array(np.concatenate(parts))
    return pa.table({"id": docs["id"], "held_out": pc.invert(docs["train"]), "n_tokens": joined(tokens),
                     "n_known": joined(known), "logs": joined(logs), "score": joined(scores)})


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                    block_bytes: int = BLOCK_BYTES, part_grams: int = PART_GRAMS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which documents to learn from; null counts as no.
    """
    spark = docs.sparkSession
    ship_package(spark)
    body = whole(F.col(text_col))
    size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = docs.select(
        F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), body.alias("body"),
        F.pmod(F.xxhash64(F.col(id_col), body), F.lit(blocks)).alias("block"))
    folder = work_dir(spark, "ppm")
    facts = _written(dealt.groupBy("block").applyInArrow(
        _facts_in_slices, "block long, code long, word binary, n long"), f"{folder}/facts")
    has_word = F.col("word").isNotNull()
    grams, words = facts.where(~has_word).select("block", "code", "n"), facts.where(has_word).select("block", "word", "n")
    gram_totals = _written(grams.groupBy("code").agg(F.sum("n").alias("n")), f"{folder}/grams")
    word_totals = _written(words.groupBy("word").agg(F.sum("n").alias("n")), f"{folder}/words")
    corpus = word_totals.where("n > 0").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # At most 2 ** 24 rows.
    ends = (gram_totals.where("n > 0").groupBy(F.col("code").bitwiseAND(0xFFFFFF).alias("code"))
            .agg(F.sum("n").alias("n")).toArrow())
    short = ShortContexts(ends["code"].to_numpy(), ends["n"].to_numpy().astype(float))

    def probabilities(part: pa.Table) -> pa.Table:
        values = gram_log_probabilities(part["code"].to_numpy(), part["n"].to_numpy(), short)
        return pa.table({"code": part["code"], "value": values})

    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-gram_totals.count() // part_grams))
    model = gram_totals.groupBy(F.pmod(F.xxhash64(F.shiftright("code", 8).bitwiseAND(0xFFFFFF)), F.lit(parts))).applyInArrow(
        probabilities, "code long, value double")
    asked = grams.select("block", "code").join(model, "code").select(
        "block", "code", F.lit(None).cast("binary").alias("word"), "value")
    counted = words.select("block", "word").join(word_totals, "word").select(
        "block", F.lit(None).cast("long").alias("code"), "word", F.col("n").cast("double").alias("value"))
    # Written as well, so that the shuffle files of this join are gone before the next ones come.
    answers = _written(asked.unionByName(counted), f"{folder}/answers")
    for done in ("facts", "grams", "words"):
        remove(spark, f"{folder}/{done}")
    scored = (dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score_block, f"id {dealt.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, "
                      "n_known long, logs double, score double"))
    unknown = F.log10(F.lit(float(corpus["n"] + corpus["v"] + 1)))
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
        F.lit(int(corpus["n"])).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * unknown).alias("base_score"), "score")


def _written(df: DataFrame, path: str) -> DataFrame:
    """The rows from a table in the shared folder; the job's shuffle files go when it has ended."""
    conf, switch = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(switch, "false")
    conf.set(switch, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        conf.set(switch, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
