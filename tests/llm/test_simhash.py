from __future__ import annotations

import random
from collections import Counter

import xxhash

from coldledger.llm import simhash
from coldledger.llm.components import component_labels


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(vertices, pairs):
    parent = {v: v for v in vertices}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {v: find(v) for v in vertices}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def fingerprints(seed=3, centres=30, around=12):
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(around):
            f = c
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            out.add(f)
    return sorted(out)


def check_links(spark, bound, bits=2):
    prints = fingerprints()
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    pairs, links = simhash.linked_pairs(df, max_bits=bits, pair_bound=bound)
    got = [(a, b) for a, b in pairs.collect()]
    mask = (1 << 64) - 1
    want = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if bin(a ^ b).count("1") <= bits]
    assert dict(links.collect()) == Counter(signed(f) for pair in want for f in pair)
    for a, b in got:
        assert bin((a & mask) ^ (b & mask)).count("1") <= 2 * bits
    labelled = roots([signed(f) for f in prints], got)
    expected = roots([signed(f) for f in prints], [(signed(a), signed(b)) for a, b in want])
    assert labelled == expected
    return got, want


def test_sparse_keys_find_all_pairs(spark):
    got, want = check_links(spark, bound=10_000)
    assert {frozenset(p) for p in got} == {frozenset((signed(a), signed(b))) for a, b in want}


def test_crowded_keys_link_the_same_components(spark):
    for bound in (1, 4, 8):
        check_links(spark, bound=bound)


def test_one_bit(spark):
    check_links(spark, bound=10_000, bits=1)
    check_links(spark, bound=1, bits=1)


def test_fingerprints_match_the_definition():
    texts = [None, "", " \n", "A", "a B", "The cat\tsat\non the MAT the cat sat", "Ünï ÀB ſK " * 40, "x " * 500]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2)]
    got = dict(component_labels(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).select("doc_id", "fp", "component_id").collect()
    assert len(rows) == odd.count()
    by_text = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert [by_text[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 1] and by_text[1]["fp"] == 0
    assert [by_text[i]["component_id"] for i in (4, 5, 7)] == [4, 4, 4]
    assert sorted(r["component_id"] for r in rows if r["doc_id"] is None) == [1, 4]
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one_of_component(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 6, 8, 9]


def test_query_against_brute_force(spark):
    from coldledger.llm.queries import op1_simhash_near_dedup

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: slow_fingerprint(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    want = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if bin(docs[a] ^ docs[b]).count("1") <= 2])
    different = set(docs.values())
    links = {f: sum(0 < bin(f ^ g).count("1") <= 2 for g in different) for f in different}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"], r["links"]) for r in op1_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{docs[i]:016x}", want[i], links[docs[i]]) for i in ids}


def test_an_id_that_repeats_with_other_texts(spark):
    a, b = "a text that came twice", "something else altogether"
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "x"), (2, b, "y"), (2, b, "y"), (None, b, "z"), (3, b, "x")],
                                 "doc_id long, text string, keep_id string")
    kept = simhash.keep_one_of_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["keep_id"]) for r in kept.collect()) == [(0, "z"), (1, "x"), (2, "y"), (2, "y")]
