"""Benchmark decontamination by spaced seeds.

A seed is a mask over word positions; positions outside it are ignored, so a hit survives substituted
words there. Each position of each training text is hashed under every mask and meets the hashes of the
benchmark; around each hit the two texts are compared word by word on the hit's diagonal.

A document overlaps an item if ``window`` aligned words around a hit (all words of a shorter item)
agree in at least ``similarity`` of the places. The two masks together hit every window of 13 words
with two substitutions, wherever they fall, so nothing that the rule covers is missed. Items of fewer
than 13 words are looked up by runs of words short enough that one of them must be free of errors.
A few words are no passage: an item of fewer than ``min_words`` overlaps only the documents that have
its words and no others, which an equal join of the whole word lists finds.

A benchmark of at most ``broadcast_bytes`` of text is broadcast and meets the documents in one scan, in
which no training text is shuffled. A larger one is never broadcast, and still costs one scan: a table of
bits, bounded by construction, drops the positions whose seeds the benchmark does not have, what is left
joins the seeds by shuffle and is stored, and a second scan compares the words of the documents that were
hit. It drops the others by such a table, too, so that only texts with a hit are shuffled, uncut.
An item's text is matched once, however many ids have it.

Words are runs of letters and digits in lower case. Defined cases: null, empty or wordless texts and
items overlap nothing; a repeated item id is several items under one id, a repeated document id several
documents under one id; the best overlap of each pair is reported. No rows on a side: no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldledger.llm.shared import whole
from coldledger.session import kept

MASKS = ((0, 2, 3, 5, 6, 7), (0, 1, 3, 7, 9, 10))
WINDOW, SIMILARITY = 13, 0.8
MIN_WORDS = 5  # an item of fewer words is no passage
BROADCAST_BYTES = 4 << 20  # text of a benchmark that may be broadcast
SLOTS = 1 << 22  # words of 64 bits in a table that sifts, ROW of them in a row: some 50 MB at most
ROW = 1 << 5


def words_of(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.filter(F.split(lowered, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def needed(length: int, similarity: float) -> int:
    """Places of ``length`` that must agree."""
    return math.ceil(similarity * length - 1e-9)


def short_masks(length: int, similarity: float) -> list[tuple[int, ...]]:
    """Runs of which one has no error in an item of ``length`` words, as offsets from its first word."""
    parts = length - needed(length, similarity) + 1
    run = length // parts
    return [tuple(range(i * run, (i + 1) * run)) for i in range(parts)]


def _seed(mask: tuple[int, ...], tag: int, hashes: Column, at: Column) -> Column:
    return F.xxhash64(F.lit(tag), *[F.get(hashes, at + F.lit(offset)) for offset in mask])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text", **options) -> DataFrame:
    """(id, item, start, matched, item_words, coverage) for each document and item that overlap.

    start: word of the document that lies under the item's first word (negative: before the text);
    matched: agreeing words over the whole item; coverage: matched / item_words.
    """
    found, names = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text, **options)
    best = found.join(names, "item_key").groupBy("id", "item").agg(F.max(F.struct("matched", -F.col("start"), "n_words")).alias("best"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col),
        (-F.col("best")["col2"]).alias("start"), F.col("best")["matched"].alias("matched"),
        F.col("best")["n_words"].alias("item_words"),
        (F.col("best")["matched"] / F.col("best")["n_words"]).alias("coverage"))


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id",
              item_text: str = "text", window: int = WINDOW, similarity: float = SIMILARITY, masks=MASKS,
              min_words: int = MIN_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(id, body_hash, item_key, start, matched, n_words), at least one row for each overlap, and (item_key, item)."""
    all_items = (benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("item_words"))
                 .where(F.size("item_words") > 0).distinct()
                 .withColumn("item_key", F.xxhash64("item_words")))
    names, item_texts = all_items.select("item_key", "item"), all_items.select("item_key", "item_words").distinct()
    items, few = (item_texts.where(c) for c in (F.size("item_words") >= min_words, F.size("item_words") < min_words))
    n = F.size("item_words")
    asked = all_items.agg(
        F.sum(F.octet_length(F.array_join("item_words", " "))).alias("bytes"), F.count_if(n < min_words).alias("few"),
        F.collect_set(F.when((n >= min_words) & (n < window), n)).alias("short")).first()
    # A tag names the shape of a mask; short items share the runs of equal length.
    shapes = {tuple(m): tag for tag, m in enumerate(masks)}
    short_of = {n: short_masks(n, similarity) for n in sorted(asked["short"])}
    for run in sorted({len(m) for ms in short_of.values() for m in ms}):
        shapes.setdefault(tuple(range(run)), len(shapes))
    seeds = _item_seeds(items, masks, short_of, shapes, window)
    bodies = docs.select(F.col(id_col).alias("id"), F.xxhash64(whole(F.col(text_col))).alias("body_hash"),
                         whole(F.col(text_col)).alias("body"))
    texts = bodies.select("id", "body_hash", words_of(F.col("body")).alias("words")).where(F.size("words") > 0)
    small = (asked["bytes"] or 0) <= broadcast_bytes
    found = [_by_broadcast(texts, items, seeds, shapes, window, similarity) if small
             else _by_shuffle(texts, bodies, items, seeds, shapes, window, similarity)]
    if asked["few"]:
        found.append(_same_words(texts, F.broadcast(few) if small else few))
    return reduce(DataFrame.unionByName, found), F.broadcast(names) if small else names


def _bits(values: DataFrame, column: str) -> DataFrame:
    """(slot, bits): a bit for each value of a column of longs, so that others can be told from them; bounded by SLOTS."""
    word = F.shiftright(column, 6).bitwiseAND(F.lit(SLOTS - 1)).alias("word")
    words = (values.select(word, F.expr(f"shiftleft(1L, cast({column} & 63 AS int)) AS bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    place = (F.col("word") % ROW).cast("int")
    rows = words.groupBy(F.expr(f"word div {ROW}").alias("slot")).agg(
        F.map_from_entries(F.collect_list(F.struct(place, "bits"))).alias("held"))
    return rows.select("slot", F.transform(F.sequence(F.lit(0), F.lit(ROW - 1)), lambda i: F.coalesce(
        F.try_element_at("held", i), F.lit(0).cast("long"))).alias("bits"))


def _sifted(rows: DataFrame, bits: DataFrame, column: str) -> DataFrame:
    """The rows whose value in the column has its bit: all that ``_bits`` was made of, and few others."""
    word = f"(shiftright({column}, 6) & {SLOTS - 1})"
    return (rows.withColumn("slot", F.expr(f"{word} div {ROW}")).join(F.broadcast(bits), "slot")
            .where(F.expr(f"getbit(get(bits, cast({word} % {ROW} AS int)), cast({column} & 63 AS int)) = 1"))
            .drop("slot", "bits"))


def _places(texts: DataFrame, shapes, *columns: str) -> DataFrame:
    """The seeds of every position of every text under every mask, beside the named columns."""
    return (texts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
            .select(*columns, "hashes", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("at"))
            .select(*columns, "at", F.explode(F.array(*[
                _seed(mask, tag, F.col("hashes"), F.col("at")) for mask, tag in shapes.items()])).alias("seed")))


def _by_broadcast(texts: DataFrame, items: DataFrame, seeds: DataFrame, shapes, window: int,
                  similarity: float) -> DataFrame:
    hits = (_places(texts, shapes, "id", "body_hash", "words").join(F.broadcast(seeds), "seed")
            .join(F.broadcast(items), "item_key").withColumn("start", F.col("at") - F.col("offset")))
    length = F.least(F.lit(window), F.size("item_words"))
    first = F.greatest(F.lit(0), F.col("offset") - (length - 1))
    last = F.least(F.col("offset"), F.size("item_words") - length)
    found = _verified(hits, first, last, window, similarity)
    return found.distinct()


def _by_shuffle(texts: DataFrame, bodies: DataFrame, items: DataFrame, seeds: DataFrame, shapes, window: int,
                similarity: float) -> DataFrame:
    doc_key = F.xxhash64("id", "body_hash").alias("doc_key")
    asking = _sifted(_places(texts.select(doc_key, "words"), shapes, "doc_key"), _bits(seeds, "seed"), "seed")
    # All hits of a diagonal are one row; its windows are then all compared.
    diagonals = kept(asking.join(seeds, "seed")
                     .select("doc_key", "item_key", (F.col("at") - F.col("offset")).alias("start")).distinct(), "diagonals")
    hit = _sifted(bodies.select("*", doc_key), _bits(diagonals, "doc_key"), "doc_key")
    # Cut into words behind the shuffle: as they are, texts take a fraction of the room.
    cut = hit.repartition("doc_key").select("id", "body_hash", "doc_key", words_of(F.col("body")).alias("words"))
    hits = diagonals.join(items, "item_key").join(cut, "doc_key")
    last = F.size("item_words") - F.least(F.lit(window), F.size("item_words"))
    return _verified(hits, F.lit(0), last, window, similarity).distinct()


def _same_words(texts: DataFrame, few: DataFrame) -> DataFrame:
    """Documents that consist of a very short item's words."""
    n = F.size("words")
    return texts.join(few, texts["words"] == few["item_words"]).select(
        "id", "body_hash", "item_key", F.lit(0).alias("start"), n.alias("n_words"), n.alias("matched")).distinct()


def _item_seeds(items: DataFrame, masks, short_of, shapes, window: int) -> DataFrame:
    """(seed, item_key, offset): offset is the item's word under the seed's first place."""
    hashed = items.withColumn("hashes", F.transform("item_words", lambda w: F.xxhash64(w)))
    places = (hashed.select("item_key", "hashes", F.size("item_words").alias("n"),
                            F.explode(F.sequence(F.lit(0), F.size("item_words") - 1)).alias("offset")))
    seeds = []
    for mask in masks:
        fits = (F.col("n") >= window) & (F.col("offset") + max(mask) < F.col("n"))
        seeds.append(F.when(fits, _seed(mask, shapes[tuple(mask)], F.col("hashes"), F.col("offset"))))
    for n, runs in short_of.items():
        for run in runs:
            shape = tuple(range(len(run)))
            fits = (F.col("n") == n) & (F.col("offset") == run[0])
            seeds.append(F.when(fits, _seed(shape, shapes[shape], F.col("hashes"), F.col("offset"))))
    return (places.select("item_key", "offset", F.explode(F.array(*seeds)).alias("seed"))
            .where("seed is not null"))


def _verified(hits: DataFrame, first: Column, last: Column, window: int, similarity: float) -> DataFrame:
    """Hits whose diagonal agrees often enough in one of the item's windows from ``first`` to ``last``."""
    same = F.transform("item_words", lambda w, i: F.when(
        (i + F.col("start") >= 0) & F.coalesce(F.get("words", i + F.col("start")) == w, F.lit(False)), 1).otherwise(0))
    length = F.least(F.lit(window), F.col("n_words"))
    enough = F.ceil(F.lit(similarity) * length - F.lit(1e-9))
    agreeing = lambda s: F.aggregate(F.slice("same", s + 1, length), F.lit(0), lambda a, x: a + x)
    return (hits.select("id", "body_hash", "item_key", "start", F.size("item_words").alias("n_words"),
                        first.alias("first"), last.alias("last"), same.alias("same"))
            .where(F.exists(F.sequence("first", "last"), lambda s: agreeing(s) >= enough))
            .select("id", "body_hash", "item_key", "start", "n_words",
                    F.aggregate("same", F.lit(0), lambda a, x: a + x).alias("matched")))


def without_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     **options) -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns. Rows without an id stay.

    Of an id that repeats with other texts, the rows whose own text overlaps go.
    """
    found, _ = _overlaps(docs, benchmark, id_col, text_col, **options)
    # From a table, whose size Spark knows before it moves documents to meet it.
    hit = kept(found.select(F.col("id").alias("hit_id"), F.col("body_hash").alias("hit_hash")).distinct(), "hit")
    same = (docs[id_col] == hit["hit_id"]) & (F.xxhash64(whole(docs[text_col])) == hit["hit_hash"])
    return docs.join(hit, same, "left_anti")
