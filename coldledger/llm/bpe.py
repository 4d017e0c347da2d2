"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding. The table of
these last tokens is filled from left to right: of the tokens that end at a place, the valid one is the
one that forms a compatible pair with the last token of the prefix before it. Two tokens are compatible
if the merges, applied to their joined bytes, give the two back. The encoding is read off backwards.

The table makes appends exact and cheap (old entries stay valid), and after an edit only the places
from the edit on change. ``EditableEncoding`` keeps one table for each piece that the split pattern
makes and splits again only around an edit.

Defined cases: null text counts as empty and has no tokens. Texts of any length are encoded whole; a
piece of any length costs time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.llm.shared import map_batches, whole

# What a worker remembers, in two generations of pieces; forgetting costs time and changes no result.
CACHED_PIECES, CACHED_CHARS, CACHED_PAIRS = 250_000, 64, 1_000_000
LAZY_BYTES = 200  # pieces up to this long settle only the prefixes they need
SLICE_ROWS = 500  # documents whose ids are held at a time
REACH = 3  # characters beyond its end that a match of the split pattern may depend on


def _trie(ranks: dict[bytes, int], step: int) -> dict[int, tuple[int, dict]]:
    """byte -> (token that ends here or -1, next bytes), reading tokens from the front (1) or the back (-1)."""
    root: dict[int, tuple[int, dict]] = {}
    for data, token in sorted((data[::step], token) for data, token in ranks.items()):
        node = root
        for byte in data[:-1]:
            node = node.setdefault(byte, (-1, {}))[1]
        node[data[-1]] = (token, node[data[-1]][1] if data[-1] in node else {})
    return root


class Vocabulary:
    """Tokens by rank, with the pair test and the prefix table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.longest = max(map(len, ranks), default=1)
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.backward = _trie(ranks, -1)
        #: Tokens that are the encoding of their own bytes; others never occur.
        self.stable = {token for data, token in ranks.items() if self._merged(data) == [token]}

    @cached_property
    def forward(self) -> dict[int, tuple[int, dict]]:
        """For long pieces and edits only, so it is made when the first of them comes."""
        return _trie(self.ranks, 1)

    def _merged(self, data: bytes) -> list[int]:
        """Tokens after all merges of a short string."""
        parts = [self.byte_ids[b] for b in data]
        while len(parts) > 1:
            best, at = min(
                ((self.ranks.get(self.tokens[a] + self.tokens[b], 1 << 60), i)
                 for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [best]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Do the merges of the joined bytes give back exactly these two tokens?"""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self._merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def extend(self, data: bytes, table: list[int]) -> list[int]:
        """Fill the table of last tokens from place ``len(table)`` on; table[i] ends the prefix of i + 1 bytes.

        Tokens are tried from each start on; by then the last token before the start is settled.
        """
        pairs, compatible = self.pairs, self.compatible
        done = len(table)
        table += [-1] * (len(data) - done)
        for start in range(max(0, done - self.longest + 1), len(data)):
            node = self.forward
            before = table[start - 1] << 32 if start else -1
            for end in range(start, len(data)):
                step = node.get(data[end])
                if step is None:
                    break
                token, node = step
                if token < 0 or end < done or table[end] >= 0:
                    continue
                if before < 0:
                    valid = token in self.stable
                else:
                    valid = pairs.get(before | token)
                    if valid is None:
                        valid = compatible(before >> 32, token)
                if valid:
                    table[end] = token
        return table

    def last_token(self, data: bytes, end: int, table: list[int]) -> int:
        """Entry of the prefix of ``end`` bytes, settling just the shorter prefixes it depends on.

        For short strings; the longest token that fits is tried first.
        """
        fitting, node = [], self.backward
        for at in range(end - 1, -1, -1):
            step = node.get(data[at])
            if step is None:
                break
            token, node = step
            if token >= 0:
                fitting.append((at, token))
        pairs = self.pairs
        for at, token in reversed(fitting):
            if at == 0:
                if token in self.stable:
                    break
                continue
            before = table[at - 1]
            if before < 0:
                before = self.last_token(data, at, table)
            valid = pairs.get(before << 32 | token)
            if valid or valid is None and self.compatible(before, token):
                break
        table[end - 1] = token
        return token

    def read(self, table: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        out, end = [], len(table)
        while end:
            token = table[end - 1]
            out.append(token)
            end -= len(self.tokens[token])
        return out[::-1]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Tokens of one match of the split pattern."""
        found = self.older.get(piece)
        if found is None:
            data = piece.encode("utf-8")
            whole_token = self.ranks.get(data)
            if whole_token is not None:
                found = (whole_token,)  # a piece that is a token is that token; ranks decide before merges do
            elif len(data) <= LAZY_BYTES:
                table = [-1] * len(data)
                self.last_token(data, len(data), table)
                found = tuple(self.read(table))
            else:
                found = tuple(self.read(self.extend(data, [])))
        if len(piece) <= CACHED_CHARS:
            if len(self.pieces) >= CACHED_PIECES:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = found
        return found

    def encode(self, text: str, pattern: regex.Pattern) -> list[int]:
        out: list[int] = []
        known, add, slow = self.pieces.get, out.extend, self.encode_piece
        for piece in pattern.findall(text):
            add(known(piece) or slow(piece))
        return out

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


class EditableEncoding:
    """A text, its pieces, and a table of last tokens for each; appends and edits redo only what changes."""

    def __init__(self, vocabulary: Vocabulary, pattern: regex.Pattern, text: str = ""):
        self.vocabulary, self.pattern, self.text = vocabulary, pattern, ""
        self.spans: list[tuple[int, int]] = []
        self.tables: list[list[int]] = []
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from start to end."""
        shift = len(new) - (end - start)
        old_spans, old_tables = self.spans, self.tables
        old_text = self.text
        self.text = old_text[:start] + new + old_text[end:]
        keep = len(old_spans)
        while keep and old_spans[keep - 1][1] + REACH > start:
            keep -= 1
        # A match after the edit that starts where an old one started has all later matches as before.
        later = {s + shift: i for i, (s, _) in enumerate(old_spans) if s >= end}
        spans, tables = old_spans[:keep], old_tables[:keep]
        at = spans[-1][1] if spans else 0
        for match in self.pattern.finditer(self.text, at):
            s, e = match.span()
            if s >= start + len(new) and s in later:
                same = later[s]
                spans += [(a + shift, b + shift) for a, b in old_spans[same:]]
                tables += old_tables[same:]
                break
            spans.append((s, e))
            tables.append(self._table(s, e, keep, old_spans, old_tables, old_text))
        self.spans, self.tables = spans, tables

    def _table(self, s: int, e: int, keep: int, old_spans, old_tables, old_text: str) -> list[int]:
        """The piece's table, begun with the entries of an old piece that starts alike."""
        data = self.text[s:e].encode("utf-8")
        for i in range(keep, min(keep + 2, len(old_spans))):
            if old_spans[i][0] == s:
                before = old_text[s:old_spans[i][1]].encode("utf-8")
                same = 0
                while same < min(len(before), len(data)) and before[same] == data[same]:
                    same += 1
                return self.vocabulary.extend(data, old_tables[i][:same])
        return self.vocabulary.extend(data, [])

    def ids(self) -> list[int]:
        out: list[int] = []
        for (s, e), table in zip(self.spans, self.tables, strict=True):
            whole_token = self.vocabulary.ranks.get(self.text[s:e].encode("utf-8"))
            out += [whole_token] if whole_token is not None else self.vocabulary.read(table)
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process and file; the file is installed on every machine."""
    return Vocabulary(read_ranks(path))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for.

    Every row is its own work: no shuffle, one Arrow batch in memory.
    """
    columns = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, split = vocabulary(path), regex.compile(pattern)
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            counts, id_shas, text_shas, kept = [], [], [], []
            for value in batch.column(1):
                ids = vocab.encode(value.as_py(), split)
                packed = np.array(ids, dtype="<u4")
                counts.append(len(ids))
                id_shas.append(hashlib.sha256(packed.tobytes()).hexdigest())
                text_shas.append(hashlib.sha256(vocab.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(packed.astype(np.int32))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_shas, pa.string()),
                      pa.array(text_shas, pa.string())]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, columns)

    rows = docs.select(F.col(id_col), whole(F.col(text_col)).alias("__body"))
    kind = rows.schema[id_col].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    return map_batches(rows, run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}")
