from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from coldledger.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(PATH)


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})


def odd_texts(n=300):
    rng = random.Random(5)
    letters = "ab cd  \n\t'rest1234éü漢字😀.,!?#$%^\xa0　ſ"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encoding_is_that_of_the_library(vocab, reference):
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in [*odd_texts(), "<|endoftext|>", "ab" * 5000, "é" * 999, " " * 3000, "aaaa " * 500]:
        ids = vocab.encode(text, pattern)
        assert ids == reference.encode_ordinary(text)
        assert vocab.decode(ids).decode() == text


def test_table_has_the_last_token_of_every_prefix(vocab, reference):
    for data in ("untokenizable", "Donaudampfschifffahrt", "xyzzyqwerty" * 4):
        table = vocab.extend(data.encode(), [])
        assert table == [reference.encode_ordinary(data[:i + 1])[-1] for i in range(len(data))]
        half = vocab.extend(data[:5].encode(), [])
        assert vocab.extend(data.encode(), half) == table


def test_appends_and_edits_are_exact(vocab, reference):
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(8)
    for text in odd_texts(60):
        live = bpe.EditableEncoding(vocab, pattern, text)
        for _ in range(5):
            a = rng.randint(0, len(live.text))
            live.replace(a, min(len(live.text), a + rng.randint(0, 4)), rng.choice(["", "'", "re", " x", "\n", "word", "9é"]))
            assert live.ids() == reference.encode_ordinary(live.text)
        live.append(" tail")
        assert live.ids() == reference.encode_ordinary(live.text)


def test_forgetting_changes_nothing(vocab, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 3)
    fresh, pattern = bpe.Vocabulary(vocab.ranks), regex.compile(public_tokenizers.PATTERN)
    for text in odd_texts(50):
        assert fresh.encode(text, pattern) == reference.encode_ordinary(text)


def test_documents(odd, none, reference):
    rows = bpe.encode_documents(odd, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    texts = sorted((r["text"] or "") for r in odd.collect())
    assert sorted(reference.decode(r["ids"]) for r in rows) == texts
    for r in rows:
        packed = b"".join(i.to_bytes(4, "little") for i in r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(packed).hexdigest() and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode_bytes(r["ids"])).hexdigest()
    assert bpe.encode_documents(none, PATH, public_tokenizers.PATTERN).count() == 0


def test_the_table_for_long_pieces_is_made_when_one_comes():
    words = bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"ab": 256})
    assert words.encode_piece("abab") == (256, 256) and "forward" not in vars(words)
    assert words.encode_piece("ab" * bpe.LAZY_BYTES) == (256,) * bpe.LAZY_BYTES and "forward" in vars(words)
