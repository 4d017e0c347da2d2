from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import regex

from coldledger.llm import decontam


def words(text):
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def slow(docs, items, window=13, similarity=0.8, min_words=5):
    """(doc, item) pairs with some aligned window that agrees in enough places; very short items must be the document."""
    number = {w: i for i, w in enumerate(sorted({w for _, t in [*docs, *items] for w in words(t)}))}
    out = set()
    for d, text in docs:
        ws = words(text)
        codes = np.array([number[w] for w in ws], dtype=np.int64)
        for i, item in items:
            ts = words(item)
            size = min(window, len(ts))
            if len(ts) < min_words:
                if ts and ts == ws:
                    out.add((d, i))
                continue
            # The row of a diagonal says for each word of the item whether the document agrees.
            around = np.concatenate([np.full(len(ts), -1), codes, np.full(len(ts), -1)])
            same = np.stack([around[k:len(around) - len(ts) + 1 + k] == number[t] for k, t in enumerate(ts)], axis=1)
            sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
            if (sums[:, size:] - sums[:, :-size] >= similarity * size - 1e-9).any():
                out.add((d, i))
    return out


def fixture():
    rng = random.Random(4)
    bag = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(bag) for _ in range(n))) for i, n in enumerate([1, 2, 4, 6, 9, 11, 12, 13, 14, 20, 37, 60])]
    docs = []
    for d in range(150):
        text = [rng.choice(bag) for _ in range(rng.randint(0, 60))]
        if d % 2:
            leak = words(items[rng.randrange(len(items))][1])
            a = rng.randint(0, len(leak) - 1)
            leak = leak[a // 2:]
            for _ in range(rng.randint(0, 4)):
                leak[rng.randrange(len(leak))] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = leak
        docs.append((d, ", ".join(text).upper()))
    docs += [(150, "W3"), (151, " ".join(words(items[1][1])).title() + "!"), (152, items[2][1]), (153, None), (154, "- ")]
    return docs, [*items, (100, None), (101, "..."), (10, items[10][1]), (102, "w3")]


def test_against_brute_force(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    for bound in (decontam.BROADCAST_BYTES, 25):
        got = decontam.overlaps(d, b, broadcast_bytes=bound).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    clean = {r["doc_id"] for r in decontam.without_overlaps(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in want}


def test_masks_survive_any_two_substitutions():
    places = [{o + k for k in m} for m in decontam.MASKS for o in range(decontam.WINDOW - max(m))]
    assert all(any(p.isdisjoint(c) for p in places) for c in itertools.combinations(range(decontam.WINDOW), 2))


@pytest.mark.parametrize("length", range(1, 13))
def test_short_masks_survive_what_the_rule_allows(length):
    wrong = length - decontam.needed(length, 0.8)
    masks = decontam.short_masks(length, 0.8)
    assert all(any(set(m).isdisjoint(c) for m in masks) for c in itertools.combinations(range(length), wrong))


def test_a_large_benchmark_is_not_broadcast(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/items")
    d, b = spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/items")
    plan = decontam.overlaps(d, b, broadcast_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") == 1  # the table of bits


def test_short_items_spare_the_documents_that_only_hold_them(spark):
    d = spark.createDataFrame([(1, "of the people"), (2, "The!"), (3, "the the"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "the"), (2, "the people"), (3, "")], "item_id long, text string")
    for bound in (decontam.BROADCAST_BYTES, 0):
        got = [tuple(r) for r in decontam.overlaps(d, b, broadcast_bytes=bound).collect()]
        assert got == [(2, 1, 0, 1, 1, 1.0)]
    assert decontam.overlaps(d, b, min_words=1).count() == 4


def test_an_id_that_repeats_with_other_texts(spark):
    leak = "one two three four five six"
    d = spark.createDataFrame([(1, f"see {leak} there", "a"), (1, "all clean", "b"), (None, leak, "c"), (1, "all clean", "d")],
                              "doc_id long, text string, hit_id string")
    b = spark.createDataFrame([(7, leak)], "item_id long, text string")
    for bound in (decontam.BROADCAST_BYTES, 0):
        got = decontam.without_overlaps(d, b, broadcast_bytes=bound)
        assert got.columns == d.columns and sorted(r["hit_id"] for r in got.collect()) == ["b", "c", "d"]


def test_odd_rows(spark, odd, none):
    b = spark.createDataFrame([(1, "one two three four"), (None, "word5 and more word6 and more"), (3, None)], "item_id long, text string")
    for bound in (decontam.BROADCAST_BYTES, 0):
        got = {(r["doc_id"], r["item_id"], r["coverage"]) for r in decontam.overlaps(odd, b, broadcast_bytes=bound).collect()}
        assert {(i, 1, 1.0) for i in (4, 5, 7, None)} | {(6, None, 1.0)} == got
    kept = decontam.without_overlaps(odd, b)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 8, 9]
    assert decontam.overlaps(none, b).count() == 0
    assert decontam.overlaps(odd, b.limit(0)).count() == 0
    assert decontam.without_overlaps(odd, b.limit(0)).count() == odd.count()


def test_query_on_the_small_tables(spark):
    from coldledger.llm.queries import op9_benchmark_decontamination

    sf = "/root/testdata/sf0.001"
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(
        "doc_id" if t == "documents" else "item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op9_benchmark_decontamination(spark, sf).collect()}
    assert got == slow(read("documents"), read("benchmark"))


def test_a_text_under_many_ids_is_matched_once_and_only_hit_documents_move(spark):
    leak = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    d = spark.createDataFrame([(1, f"see {leak} there"), (2, "all clean and nothing else in here"), (None, leak), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(i, leak.upper()) for i in range(5)] + [(0, "all the others are elsewhere my friend")], "item_id long, text string")
    for bound in (decontam.BROADCAST_BYTES, 0):
        found, names = decontam._overlaps(d, b, "doc_id", "text", broadcast_bytes=bound)
        assert sorted((r["id"] or 0, r["start"]) for r in found.collect()) == [(0, 0), (1, 1)] and names.count() == 6
        assert {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(d, b, broadcast_bytes=bound).collect()} == {
            (i, k) for i in (1, None) for k in range(5)}
    plan = decontam.overlaps(d, b, broadcast_bytes=0)._jdf.queryExecution().optimizedPlan().toString()
    moved = [line for line in plan.split("\n") if "getbit" in line]
    assert len(moved) == 1 and "words" not in moved[0]


def test_bits_keep_what_they_were_made_of(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SLOTS", 1 << 8)
    held = [0, -1, 63, 64, 1 << 40, -(1 << 63), (1 << 63) - 1, 4095, 4096, 16384]
    bits = decontam._bits(spark.createDataFrame([(h,) for h in held * 2], "v long"), "v")
    assert bits.where(f"size(bits) != {decontam.ROW}").count() == 0 and bits.groupBy("slot").count().where("count > 1").count() == 0
    asked = spark.createDataFrame([(h,) for h in [*held, 1, 62, -2, 128]], "v long")
    assert sorted(r["v"] for r in decontam._sifted(asked, bits, "v").collect()) == sorted(held)


def test_documents_are_searched_once_when_hits_are_taken_out(spark):
    leak = "one two three four five six"
    d = spark.createDataFrame([(1, f"see {leak} there"), (2, "all clean"), (None, leak)], "doc_id long, text string")
    for bound in (decontam.BROADCAST_BYTES, 0):
        clean = decontam.without_overlaps(d, spark.createDataFrame([(7, leak)], "item_id long, text string"), broadcast_bytes=bound)
        assert "Generate" not in clean._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 2]
