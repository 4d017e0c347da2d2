from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from coldledger.llm import line_dedup

EDGES = re.compile("^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return EDGES.sub("", line).translate(LOWER)


def slow(docs, min_docs, min_chars=1, keep_first=False):
    """(id, lines, dropped, kept text) of (id, text) rows with different ids, sorted by id."""
    split = {i: (t or "").split("\n") for i, t in docs}
    seen = {}
    for i, lines in split.items():
        for n, line in enumerate(lines):
            if len(key(line)) >= min_chars:
                seen.setdefault(key(line), []).append((i, n))
    gone = set()
    for places in seen.values():
        if len({i for i, _ in places}) >= min_docs:
            gone |= set(places) - ({min(places)} if keep_first else set())
    return sorted((i, len(lines), sum((i, n) in gone for n in range(len(lines))),
                   "\n".join(line for n, line in enumerate(lines) if (i, n) not in gone)) for i, lines in split.items())


def run(docs, **options):
    found = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, **options))
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in found.collect()), key=repr)


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("partitions", [1, 12])
@pytest.mark.parametrize("keep_first", [False, True])
def test_random_documents_over_few_and_many_partitions(spark, partitions, keep_first):
    rng = random.Random(7)
    lines = ["", "  ", "Hot line", " hot LINE\t", "ünï", "Ünï", "x", *[f"line {k}" for k in range(40)]]
    rows = [(i, "\n".join(rng.choices(lines, weights=[40] * 7 + [1] * 40, k=rng.randrange(0, 30)))) for i in range(120)]
    for min_docs, min_chars in ((2, 1), (60, 2)):
        got = run(frame(spark, rows), min_docs=min_docs, min_chars=min_chars, keep_first=keep_first, partitions=partitions)
        assert got == sorted(slow(rows, min_docs, min_chars, keep_first), key=repr)


def test_one_line_in_all_rows_is_spread_over_tasks(spark):
    rows = [(i, "the same line\nown %d" % i) for i in range(3000)]
    docs = frame(spark, rows)
    lines = line_dedup.lines_of(docs)
    placed = (lines.repartitionByRange(20, *line_dedup.FIELDS).select(F.spark_partition_id().alias("p"))
              .groupBy("p").count().collect())
    assert len(placed) == 20 and max(r["count"] for r in placed) < 900
    assert run(docs, min_docs=10, partitions=20) == sorted([(i, 2, 1, "own %d" % i) for i in range(3000)], key=repr)
    assert [r for r in run(docs, min_docs=10, partitions=20, keep_first=True) if r[2] == 0] == [(0, 2, 0, rows[0][1])]


@pytest.mark.parametrize("least, dropped", [(9, 1), (10, 1), (11, 0)])
def test_the_least_number_of_documents(spark, least, dropped):
    rows = [(i, f"a\nb{i}\nA ") for i in range(10)]
    for partitions in (2, 9):
        got = run(frame(spark, rows), min_docs=least, partitions=partitions)
        assert {r[2] for r in got} == {2 * dropped}


def test_odd_rows(spark, odd, none):
    got = run(odd, min_docs=3)
    assert len(got) == odd.count()
    # The text of ids 4, 5 and none is one document each; the repeated row of 5 is the same document.
    assert {r[:3] for r in got} >= {(4, 1, 1), (5, 1, 1), (None, 1, 1), (None, 1, 0), (1, 1, 0), (2, 1, 0), (3, 2, 0)}
    assert [r for r in got if r[0] == 3][0][3] == "   \t\n"
    assert {r[2] for r in run(odd, min_docs=4) if r[0]} == {0}
    assert run(none) == []


def test_same_id_with_another_text(spark):
    docs = frame(spark, [(1, "a\nb"), (1, "a\nc"), (2, "b"), (2, "b")])
    assert run(docs, min_docs=2) == [(1, 2, 1, "c"), (1, 2, 2, ""), (2, 1, 1, ""), (2, 1, 1, "")]
    assert run(docs, min_docs=2, keep_first=True)[2:] == [(2, 1, 1, ""), (2, 1, 1, "")]


def test_long_text(spark):
    text = "\n".join(f"l{k % 5000}" for k in range(300_000))
    docs = frame(spark, [(1, text), (2, "l7\nq")])
    got = run(docs, min_docs=2)
    assert got == sorted(slow([(1, text), (2, "l7\nq")], 2), key=repr)


def test_query_on_the_small_tables(spark):
    from coldledger.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in slow(rows, 10)}
    got = {tuple(r) for r in queries.op13_line_dedup(spark, sf).collect()}
    assert got == want and any(r[2] for r in got)
