"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

The field tags tokens as secret begin (B), inside (I) or outside (O). Its features are the token's shape
(length, kinds of characters, variety), what the three tokens before and the one after are (keyword,
separator, quote, shaped), whether a keyword stands near, whether the text has one at all, and how many of the text's
tokens are shaped. It is fitted by maximum likelihood on windows of at most ``SAMPLE_DOCS`` documents, tagged by the
patterns: pieces of at most ``WINDOW_TOKENS`` tokens, and ``SAMPLE_TOKENS`` tokens of each document at most. Each
window with a secret is seen once more with its separators and quotes masked as plain words and without its shape,
so the field learns to know a secret by its surroundings where no pattern matches. Decoding is by Viterbi. Spans that it finds and that
touch no pattern's span are added under kind ``crf``.

Most tokens are plain (no digit, under 20 characters, no keyword) and far from others; they all have
the same scores. Where those favour O by more than any transition can give back, every best path passes
through O there, so decoding the stretches between them gives what decoding the whole text would. If the
fitted weights do not allow that, whole texts are decoded.

Defined cases: null counts as empty; no spans: empty span list. Without a text to learn from the field
adds nothing. Offsets count code points; the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.llm.linear import SparseRows
from coldledger.llm.shared import map_batches, whole

SAMPLE_DOCS, SAMPLE_TOKENS, WINDOW_TOKENS = 1_500, 240, 48  # documents to learn from, tokens of each and of a window
KINDS = ("assign", "access", "hex", "crf")
TAGS = ("O", "B", "I")
# What counts as a secret by pattern.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of [0-9a-f]+ with 24 or more
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_TOKENS = re.compile(r"[A-Za-z0-9+/_.-]+=*|[^\sA-Za-z0-9+/_.-]+")
_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_NOT_PLAIN = re.compile(r"""[0-9:="'`]|\S{20}""")  # some such character is in every token that is not plain or a keyword
LONG, AROUND = 20, 3


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every pattern match, sorted."""
    found = []
    low = text.lower()  # only to skip texts without any keyword
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def shape(token: str) -> str:
    """Class of a token; plain for all that look like words or punctuation."""
    if _KEYWORD.search(token):
        return "keyword"
    if not re.search("[0-9]", token) and len(token) < LONG:
        if re.fullmatch(r"[:=]+", token):
            return "separator"
        return "quote" if re.fullmatch(r"""["'`]+""", token) else "plain"
    size = sum(len(token) >= n for n in (6, 12, 16, 20, 24, 32, 48, 64))
    kinds = "".join(c for c, p in (("d", "[0-9]"), ("u", "[A-Z]"), ("l", "[a-z]"), ("s", "[^A-Za-z0-9]")) if re.search(p, token))
    variety = "v" if len(set(token)) >= min(10, 0.6 * len(token)) else ""
    return f"{size}{kinds}{variety}{'h' if re.fullmatch('[0-9a-f]+', token) else ''}{'k' if token.startswith('AKIA') else ''}"


SHARES = ("none", "few", "some", "many")


def shaped_share(shapes: list[str]) -> str:
    """How many tokens of a text are shaped."""
    shaped = sum(s not in ("plain", "keyword", "separator", "quote") for s in shapes)
    return SHARES[(shaped > 0) + (50 * shaped > len(shapes)) + (5 * shaped > len(shapes))]


def token_features(shapes: list[str], i: int, keyword_in_text: bool, share: str) -> list[str]:
    """Names of the features of token i; outside the text everything is plain."""
    at = lambda j: shapes[j] if 0 <= j < len(shapes) else "plain"
    role = lambda s: s if s in ("plain", "keyword", "separator", "quote") else "shaped"
    near = "keyword" in (at(i - 1), at(i - 2), at(i - 3))
    own = shapes[i]
    return [f"own {own}", f"own {role(own)} near {near}", f"size {own[0]} near {near}", f"text {keyword_in_text}", f"share {share}",
            f"-1 {role(at(i - 1))}", f"-2 {role(at(i - 2))}", f"-3 {role(at(i - 3))}", f"+1 {role(at(i + 1))}"]


def stretches(shapes: list[str]) -> list[tuple[int, int]]:
    """Token ranges that hold all tokens whose features differ from a plain one's, one plain token around."""
    out: list[list[int]] = []
    for i, s in enumerate(shapes):
        if s != "plain":
            low, end = max(0, i - 2), min(len(shapes), i + AROUND + 2)
            if out and low <= out[-1][1]:
                out[-1][1] = end
            else:
                out.append([low, end])
    return [(a, b) for a, b in out]


@dataclass
class Field:
    """Weights of a linear chain: feature name -> score of each tag, and scores of tag pairs."""

    names: dict[str, int]
    weights: np.ndarray  # features x tags
    steps: np.ndarray  # from tag, to tag
    local: bool = False  # may stretches be decoded on their own?

    def emissions(self, shapes: list[str], low: int, end: int, keyword: bool, share: str) -> np.ndarray:
        out = np.zeros((end - low, len(TAGS)))
        for i in range(low, end):
            for f in token_features(shapes, i, keyword, share):
                k = self.names.get(f)
                if k is not None:
                    out[i - low] += self.weights[k]
        return out

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Best tags; the text around counts as O."""
        best, back = scores[0] + self.steps[0], []
        for row in scores[1:]:
            options = best[:, None] + self.steps
            back.append(options.argmax(axis=0))
            best = options.max(axis=0) + row
        path = [int((best + self.steps[:, 0]).argmax())]
        for pointers in reversed(back):
            path.append(int(pointers[path[-1]]))
        return path[::-1]

    def settle(self) -> None:
        """Check that plain tokens far from others are O on every best path."""
        gain = 2 * float(self.steps[np.isfinite(self.steps)].max() - self.steps[np.isfinite(self.steps)].min())
        margins = []
        for keyword, share in product((False, True), SHARES):
            e = self.emissions(["plain"], 0, 1, keyword, share)[0]
            margins.append(float(e[0] - e[1:].max()))
        self.local = min(margins) > gain

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each run that begins with B."""
        if self.local and not _NOT_PLAIN.search(text) and not _KEYWORD.search(text):
            return []
        tokens = [m.span() for m in _TOKENS.finditer(text)]
        shapes = [shape(text[a:b]) for a, b in tokens]
        keyword, share = "keyword" in shapes, shaped_share(shapes)
        out = []
        for low, end in stretches(shapes) if self.local else [(0, len(shapes))] if shapes else []:
            open_at = None
            for i, tag in enumerate(self.viterbi(self.emissions(shapes, low, end, keyword, share)), low):
                if tag == 1 or tag == 2 and open_at is None:
                    out.append((tokens[i][0], tokens[i][1]))
                    open_at = len(out) - 1
                elif tag == 2:
                    out[open_at] = (out[open_at][0], tokens[i][1])
                else:
                    open_at = None
        return out


def tagged_windows(text: str) -> list[list[str]]:
    """Training sequences of a text, SAMPLE_TOKENS tokens at most: for each token its tag and its features."""
    tokens = [m.span() for m in _TOKENS.finditer(text)]
    shapes = [shape(text[a:b]) for a, b in tokens]
    keyword, share = "keyword" in shapes, shaped_share(shapes)
    secret = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    secret = sorted(secret + [(s, e) for s, k, e in pattern_spans(text) if k])
    out, left, at = [], SAMPLE_TOKENS, 0
    pieces = [(a, min(end, a + WINDOW_TOKENS)) for low, end in stretches(shapes) for a in range(low, end, WINDOW_TOKENS)]
    for low, end in pieces:
        end = min(end, low + left)
        if end <= low:
            break
        tags, before = [], None
        for a, b in tokens[low:end]:
            while at < len(secret) and secret[at][1] <= a:  # both lists are in order
                at += 1
            mine = secret[at] if at < len(secret) and secret[at][0] < b else None
            tags.append("O" if mine is None else "I" if mine == before else "B")
            before = mine
        out.append([" | ".join([t, *token_features(shapes, i, keyword, share)]) for i, t in enumerate(tags, low)])
        if "B" in tags:  # once more without separators and quotes, and without the exact shapes of secrets
            masked = shapes[:low] + ["plain" if s in ("separator", "quote") else s for s in shapes[low:end]] + shapes[end:]
            out.append([" | ".join([t, *token_features(masked, i, keyword, share)[t != "O":]]) for i, t in enumerate(tags, low)])
        left -= end - low
    if not out and tokens:  # what ordinary text looks like
        i = len(tokens) // 2
        out.append([" | ".join(["O", *token_features(shapes, i, keyword, share)])])
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field | None:
    """Fit on the documents with digits that have the smallest hashes of their ids; None without any."""
    body = whole(F.col(text_col))
    usable = docs.where(F.col(id_col).isNotNull() & body.rlike("[0-9]"))
    picked = usable.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    texts = (usable.select(F.col(id_col).alias("id"), body.alias("body"))
             .join(F.broadcast(picked), "id").select("body"))  # sample_docs ids at most

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [w for t in batch.column(0) for w in tagged_windows(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["rows"])

    got = sorted(map_batches(texts, windows, "rows array<string>").toArrow()["rows"].to_pylist())
    return fit_field(got) if got else None


def fit_field(sequences: list[list[str]], steps: int = 150, l2: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; forward and backward sums over all sequences at once."""
    names: dict[str, int] = {}
    columns, tags, places = [], [], []
    longest = max(map(len, sequences))
    for s, rows in enumerate(sequences):
        for t, row in enumerate(rows):
            tag, *found = row.split(" | ")
            columns.append(np.array([names.setdefault(f, len(names)) for f in found]))
            tags.append(TAGS.index(tag))
            places.append((s, t))
    x = SparseRows(columns, [np.ones(len(c)) for c in columns], len(names))
    at = np.array(places)
    gold = np.array(tags)
    n, k = len(sequences), len(TAGS)
    inside = np.zeros((n, longest), dtype=bool)
    inside[at[:, 0], at[:, 1]] = True
    sizes = inside.sum(axis=1)
    tag_at = np.zeros((n, longest), dtype=int)
    tag_at[at[:, 0], at[:, 1]] = gold
    seen = np.zeros((k, k))
    np.add.at(seen, (0, tag_at[:, 0]), 1)
    for t in range(1, longest):
        rows = inside[:, t]
        np.add.at(seen, (tag_at[rows, t - 1], tag_at[rows, t]), 1)
    np.add.at(seen, (tag_at[np.arange(n), sizes - 1], 0), 1)
    params = np.zeros(len(names) * k + k * k)
    m, v = np.zeros_like(params), np.zeros_like(params)
    onehot = np.eye(k)[gold]
    for step in range(1, steps + 1):
        weights, trans = params[:-k * k].reshape(-1, k), params[-k * k:].reshape(k, k)
        scores = np.zeros((n, longest, k))
        scores[at[:, 0], at[:, 1]] = np.column_stack([x.times(weights[:, j]) for j in range(k)])
        alpha = np.zeros((n, longest, k))
        alpha[:, 0] = scores[:, 0] + trans[0]
        for t in range(1, longest):
            alpha[:, t] = scores[:, t] + _sum_exp(alpha[:, t - 1, :, None] + trans, axis=1)
        last = alpha[np.arange(n), sizes - 1] + trans[:, 0]
        total = _sum_exp(last, axis=1)
        beta = np.zeros((n, longest, k))
        beta[np.arange(n), sizes - 1] = trans[:, 0]
        expected = np.zeros((k, k))
        for t in range(longest - 2, -1, -1):
            on = inside[:, t + 1]
            ahead = scores[on, t + 1] + beta[on, t + 1]
            beta[on, t] = _sum_exp(trans + ahead[:, None, :], axis=2)
            expected += np.exp(alpha[on, t, :, None] + trans + ahead[:, None, :] - total[on, None, None]).sum(axis=0)
        expected[:, 0] += np.exp(last - total[:, None]).sum(axis=0)
        expected[0] += np.exp(alpha[:, 0] + beta[:, 0] - total[:, None]).sum(axis=0)
        share = np.exp(alpha + beta - total[:, None, None])[at[:, 0], at[:, 1]]
        grad = np.concatenate([
            np.column_stack([x.transposed_times((share - onehot)[:, j]) for j in range(k)]).ravel(),
            (expected - seen).ravel()]) / n + l2 * params
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    field = Field(names, params[:-k * k].reshape(-1, k), params[-k * k:].reshape(k, k))
    field.settle()
    return field


def _sum_exp(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis=axis) + np.log(np.exp(z - top).sum(axis=axis))


def all_spans(text: str, field: Field | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(pattern spans, all spans): the field's spans are added where they touch no pattern span."""
    base = pattern_spans(text)
    more, at, reach = [], 0, -1
    for a, b in [] if field is None else field.spans(text):  # in order, like the others
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a:
            more.append((a, 3, b))
    return base, sorted(base + more)


def scan(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, n_crf, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for value in batch.column(1):
                base, found = all_spans(value.as_py(), field)
                counts.append([sum(k == kind for _, k, _ in found) for kind in range(len(KINDS))])
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(found))
            table = np.array(counts, dtype=np.int64).reshape(len(counts), len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(table[:, i]) for i in range(len(KINDS))], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())],
                [id_col, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    rows = docs.select(F.col(id_col), whole(F.col(text_col)).alias("__body"))
    kind = rows.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_batches(rows, run, f"`{id_col}` {kind}, {counts}, base_sha256 string, spans string")
