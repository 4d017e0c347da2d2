from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from coldledger.llm import ppm


def slow_scores(docs):
    """Byte by byte PPM with escapes of method D and exclusion, and the unigram score."""
    split = [ppm.split_words(t) for _, t, _ in docs]
    coded = [b"\xfe" * 5 + b" ".join(w) + b"\xff" for w in split]
    counts = defaultdict(Counter)
    words = Counter()
    for line, ws, (_, _, train) in zip(coded, split, docs, strict=True):
        if train:
            words.update([*ws, b""])
            for i in range(5, len(line)):
                for k in range(6):
                    counts[line[i - k:i]][line[i]] += 1
    n, v = sum(words.values()), len(words)
    out = []
    for line, ws, (doc, _, train) in zip(coded, split, docs, strict=True):
        score = 0.0
        for i in range(5, len(line)):
            out_of = set()
            for k in range(5, -1, -1):
                seen = {s: c for s, c in counts[line[i - k:i]].items() if s not in out_of}
                total = 2 * sum(seen.values())
                if not seen:
                    continue
                if line[i] in seen:
                    score += math.log10((2 * seen[line[i]] - 1) / total)
                    break
                score += math.log10(len(seen) / total)
                out_of |= set(seen)
            else:
                score -= math.log10(256 - len(out_of))
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in [*ws, b""])
        out.append((doc, not train, len(ws) + 1, sum(words[w] > 0 for w in [*ws, b""]), n, base, score))
    return out


@pytest.mark.parametrize(("block_bytes", "part_grams"), [(100, 1), (10_000_000, 10_000_000)])
def test_against_brute_force(spark, block_bytes, part_grams):
    texts = ["the cat sat on the mat", "The CAT\tsat", None, "", "a rat ate the mat", "über ñandú über", "zzz qqq 123", "the the the",
             "mat on cat", "an unseen ünicode 漢字"] * 3
    docs = [(i, t, i % 4 != 2) for i, t in enumerate(texts)] + [(None, "the cat", False), (5, "a rat", True), (5, "a rat", True)]
    df = spark.createDataFrame(docs, "doc_id long, text string, train boolean")
    got = [tuple(r) for r in ppm.score_documents(df, F.col("train"), block_bytes=block_bytes, part_grams=part_grams).collect()]
    key = lambda r: (str(r[0]), r[2], r[6])
    for g, w in zip(sorted(got, key=key), sorted(slow_scores(docs), key=key), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-9) and g[6] == pytest.approx(w[6], abs=1e-9)


def test_one_context_does_not_grow_a_part_without_bound(spark):
    """Grams of a hot pair of context bytes are dealt over many parts; each part has all grams of its contexts."""
    rng = random.Random(5)
    lines = [" ".join("".join(rng.choices("aeio", k=3)) + "th" + rng.choice("aeio") for _ in range(40)) for _ in range(40)]
    codes = np.unique(ppm.gram_codes([ppm.split_words(t) for t in lines])[0])
    n = np.ones(len(codes), dtype=np.int64)
    ends, at = np.unique(codes & 0xFFFFFF, return_inverse=True)
    short = ppm.ShortContexts(ends, np.bincount(at, n))
    whole = ppm.gram_log_probabilities(codes, n, short)
    for context in np.unique((codes >> 8) & 0xFFFFFF):
        part = ((codes >> 8) & 0xFFFFFF) == context
        assert np.allclose(ppm.gram_log_probabilities(codes[part], n[part], short), whole[part])


def test_nothing_to_learn(spark, none, odd):
    assert ppm.score_documents(none, F.lit(True)).count() == 0
    rows = ppm.score_documents(odd, F.lit(False)).collect()
    assert len(rows) == odd.count() and {r["train_tokens"] for r in rows} == {0}
    assert next(r["score"] for r in rows if r["doc_id"] == 9) == pytest.approx(-2 * math.log10(256))


def test_model_beats_unigrams_on_held_out_text(spark):
    from coldledger.llm.queries import op5_ppm_scoring

    got = op5_ppm_scoring(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]


def test_facts_are_handed_over_in_slices(monkeypatch):
    monkeypatch.setattr(ppm, "SLICE_ROWS", 10)
    docs = pa.table({"id": [1, 2, 3], "train": [True, False, True], "body": ["some words here", None, "Some other words"], "block": [7, 7, 7]})
    parts = list(ppm._facts_in_slices(iter(docs.to_batches(max_chunksize=2))))
    assert len(parts) > 1 and max(part.num_rows for part in parts) <= 10
    assert pa.Table.from_batches(parts).equals(ppm._block_facts(docs))
