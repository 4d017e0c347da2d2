from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from coldledger.llm import secret_scan as scan

WORDS = "the report was sent and we met again near our house".split()


def slow_base(text):
    """The rules as they are written, each in its plainest form."""
    found = []
    cased = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    rule = rf"""({cased})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(rule, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def texts(n=400, seed=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            value = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([5, 8, 24, 40])))
            name = rng.choice(["password", "PassWd", "token", "api_key", "APIKEY", "ſecret", "secret"])
            words.insert(rng.randint(0, len(words)), rng.choice([
                f'{name}="{value}"', f"{name} = {value}", f"{name}: '{value}'é", value, f"AKIA{value.upper()}", f"{name}={value}==",
                str(rng.randint(1, 10 ** 9)), f"{name} {name}:{name}:{value}", "1.2.3.4", "a@b.org"]))
        out.append(" ".join(words))
    return out


def test_patterns_against_their_plain_form():
    for text in [*texts(), "", "AKIA" * 9, "f" * 23, "F" * 24, "tokenK=abcdefgh", "password:" * 5]:
        assert scan.pattern_spans(text) == slow_base(text)


@pytest.fixture(scope="module")
def field():
    return scan.fit_field(sorted(w for t in texts(600, 7) for w in scan.tagged_windows(t)))


def test_viterbi_against_all_paths(field):
    from itertools import product

    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        scores = rng.normal(size=(n, 3)) * 3
        value = lambda p: sum(scores[i, t] for i, t in enumerate(p)) + sum(
            field.steps[a, b] for a, b in zip((0, *p), (*p, 0), strict=True))
        assert tuple(field.viterbi(scores)) == max(product(range(3), repeat=n), key=value)


def test_stretches_decode_like_whole_texts(field):
    assert field.local
    whole = scan.Field(field.names, field.weights, field.steps, local=False)
    for text in texts(150, 11):
        assert field.spans(text) == whole.spans(text)


def test_field_finds_what_the_patterns_do_and_leaves_plain_text(field):
    found = total = 0
    for text in texts(300, 23):
        spans = field.spans(text)
        for s, _, e in slow_base(text):
            total += 1
            found += any(a < e and s < b for a, b in spans)
    assert found >= 0.9 * total
    assert not [t for t in (" ".join(WORDS), "we met 12 times in 2024", "") if field.spans(t)]


def test_field_finds_secrets_that_no_pattern_matches(field):
    """Keyword and secret without a separator, with words between, in other quotes: recall 0.9, plain text left alone."""
    rng = random.Random(41)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    found = total = 0
    for _ in range(300):
        value = "".join(rng.choices(letters, k=rng.choice([16, 20, 24, 32]))) + "7"
        words = rng.choices(WORDS, k=12)
        words.insert(6, rng.choice([f"password is {value}", f"the secret {value}", f"token `{value}`", f"api_key => {value}", f"passwd was {value}"]))
        text = " ".join(words)
        assert not slow_base(text)
        at = text.index(value)
        total += 1
        found += any(a < at + len(value) and at < b for a, b in field.spans(text))
    assert found >= 0.9 * total
    quiet = [" ".join(rng.choices([*WORDS, "12", "2024", "secret", "token"], k=20)) for _ in range(300)]
    assert sum(bool(field.spans(t)) for t in quiet) <= 3


def test_windows_are_bounded_and_spans_linear(field):
    text = " ".join(f"word{i} token=abc{i}defgh" for i in range(20_000))
    windows = scan.tagged_windows(text)
    assert max(map(len, windows)) <= scan.WINDOW_TOKENS and sum(map(len, windows)) <= 2 * scan.SAMPLE_TOKENS
    base, everything = scan.all_spans(text, field)
    assert len(base) == 20_000 and set(base) <= set(everything)


def test_base_spans_stay(field):
    for text in texts(100, 31):
        base, everything = scan.all_spans(text, field)
        assert base == slow_base(text) and set(base) <= set(everything)


def test_odd_rows(odd, none):
    rows = scan.scan(odd, scan.fit(odd)).collect()
    assert len(rows) == odd.count()
    assert {(r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows} == {
        (0, 0, 0, hashlib.sha256(b"").hexdigest())}
    assert scan.fit(none) is None and scan.scan(none, None).count() == 0


def test_query_against_the_plain_rules(spark):
    from coldledger.llm.queries import op7_secret_scan

    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    for r in op7_secret_scan(spark, sf).collect():
        base = slow_base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(scan.listed(base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, k, _ in base) for kind in range(3)]
        assert set(scan.listed(base).split(",")) <= set(r["spans"].split(","))
