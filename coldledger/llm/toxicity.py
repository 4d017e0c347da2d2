"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models. Each model sees the features of the
text and the probabilities of all earlier categories; while fitting, those are out-of-fold predictions,
so a later model never learns from probabilities of rows its predecessors were fitted on.

Features are whole words and their beginnings (5 to 7 letters), each as a share of the text's words: a
long text is not toxic because one word occurs in it once, and a short one is if it does.

Fitting uses at most ``SAMPLE_ROWS`` labelled documents, those with the smallest hash of their id, and
the ``TERMS`` terms that tell the categories apart best among them. Every document is scored whole.

Defined cases: null, empty and wordless texts have probability 0 in all categories and are not toxic. A
document labelled more than once counts as positive if any label is; null labels and ids are left out of
the fitting. Without labelled documents of both classes a category has probability 0 everywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.llm.linear import SparseRows, fit_logistic, sigmoid
from coldledger.llm.shared import map_batches, whole

SAMPLE_ROWS = 10_000
TERMS = 1_000
FOLDS = 4
HELD_TERMS = 50_000  # terms that a task counts before it hands them on
BEGINNINGS = (5, 6, 7)
SHARE_AT_ONE = 0.02  # a term that makes up this share of the words has value 1
THRESHOLD = 0.5
_WORDS = re.compile(r"[^\W\d_]+")


def term_counts(text: str) -> tuple[Counter, int]:
    """Counts of words and of their beginnings (marked by a trailing *), and the number of words."""
    words = Counter(_WORDS.findall(text.lower()))
    total = sum(words.values())
    counts = Counter(words)
    for word, n in words.items():
        for size in BEGINNINGS:
            if len(word) >= size:
                counts[word[:size] + "*"] += n
    return counts, total


class Chain:
    """Terms and the weights of each category's model, in the order of the chain."""

    def __init__(self, terms: list[str], models: list[dict]):
        self.terms, self.models = terms, models
        self.index = {t: i for i, t in enumerate(terms)}

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Columns and values of a text, and its number of words."""
        words = Counter(_WORDS.findall(text.lower()))
        total = sum(words.values())
        found: dict[int, int] = {}
        index = self.index
        for word, n in words.items():
            i = index.get(word)
            if i is not None:
                found[i] = found.get(i, 0) + n
            if len(word) >= BEGINNINGS[0]:
                for size in BEGINNINGS:
                    i = index.get(word[:size] + "*")
                    if i is not None and len(word) >= size:
                        found[i] = found.get(i, 0) + n
        columns = np.array(sorted(found), dtype=np.int64)
        values = np.minimum(1.0, np.array([found[c] for c in columns.tolist()]) / max(1, total) / SHARE_AT_ONE)
        return columns, values, total

    def score(self, text: str) -> list[float]:
        """Probability of each category."""
        columns, values, total = self.features(text)
        out: list[float] = []
        for model in self.models:
            if not total or not model["fitted"]:
                out.append(0.0)
                continue
            z = float(values @ model["terms"][columns]) + float(np.dot(out, model["earlier"])) + model["bias"]
            out.append(float(sigmoid(np.array(z))))
        return out


def _sample(labels: DataFrame, id_col: str, categories: dict[str, str], rows: int) -> DataFrame:
    """(id, one 0/1 column for each category) of at most ``rows`` labelled ids."""
    flags = {c: F.max(F.expr(rule).cast("int")).alias(c) for c, rule in categories.items()}
    per_id = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*flags.values())
    return (per_id.dropna(subset=list(categories)).orderBy(F.xxhash64("id"), "id").limit(rows))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id",
              text_col: str = "text", sample_rows: int = SAMPLE_ROWS, terms: int = TERMS,
              folds: int = FOLDS) -> Chain:
    """Fit the chain. categories: name -> SQL condition over the labels, in the order of the chain."""
    names = list(categories)
    # At most sample_rows rows of a few numbers: small enough for every task, by the limit itself.
    sample = F.broadcast(_sample(labels, id_col, categories, sample_rows))
    texts = (docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("body"))
             .join(sample, "id").select("id", "body", *names))
    chosen = _telling_terms(texts, names, terms)
    chain = Chain(chosen, [])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [chain.features(t.as_py())[:2] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.astype(np.int32) for c, _ in got], pa.list_(pa.int32())),
                 pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32())), *batch.columns[2:]],
                ["columns", "values", *names])

    kinds = ", ".join(f"`{n}` int" for n in names)
    got = map_batches(texts, vectors, f"columns array<int>, values array<float>, {kinds}").toArrow().sort_by(
        [(n, "ascending") for n in names])
    x = SparseRows([np.asarray(c, dtype=np.int64) for c in got["columns"].to_pylist()],
                   [np.asarray(v) for v in got["values"].to_pylist()], len(chosen))
    fold = np.arange(x.height) % folds  # rows are in order of their labels, so each fold has its share of all
    earlier = np.zeros((x.height, 0))
    for name in names:
        y = got[name].to_numpy().astype(np.float64)
        fitted = 0 < y.sum() < len(y)
        outside = np.zeros(len(y))
        if fitted:
            w, e, b = fit_logistic(x, earlier, y)
            for k in range(folds):
                inside = fold == k
                wk, ek, bk = fit_logistic(x.pick(~inside), earlier[~inside], y[~inside])
                outside[inside] = sigmoid(x.pick(inside).times(wk) + earlier[inside] @ ek + bk)
        else:
            w, e, b = np.zeros(x.width), np.zeros(earlier.shape[1]), 0.0
        chain.models.append({"name": name, "terms": w, "earlier": e, "bias": b, "fitted": fitted})
        earlier = np.column_stack([earlier, outside])
    return chain


def _telling_terms(texts: DataFrame, names: list[str], most: int) -> list[str]:
    """The terms whose presence tells some category apart best, by the size of their chi-square."""

    def listed(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
        table = np.array(list(counts.values()), dtype=np.int64).reshape(len(counts), len(names) + 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), *[pa.array(table[:, i]) for i in range(table.shape[1])]],
            ["term", "n", *names])

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            flags = np.column_stack([np.ones(len(batch))] + [c.to_numpy() for c in batch.columns[1:]]).astype(np.int64)
            for text, row in zip(batch.column(0), flags, strict=True):
                for term in term_counts(text.as_py())[0]:
                    counts[term] = counts[term] + row if term in counts else row.copy()
                if len(counts) >= HELD_TERMS:
                    yield listed(counts)
                    counts = {}
        yield listed(counts)

    kinds = ", ".join(f"`{n}` long" for n in ["n", *names])
    totals = texts.agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in names]).first()
    if not totals["n"]:
        return []
    per_term = (map_batches(texts.select("body", *names), presence, f"term string, {kinds}")
                .groupBy("term").agg(*[F.sum(n).alias(n) for n in ["n", *names]]).where("n >= 5"))
    scores = []
    for name in names:
        all_rows, positive = float(totals["n"]), float(totals[name])
        expected = F.col("n") * positive / all_rows
        spread = F.col("n") * (positive / all_rows) * (1 - positive / all_rows)
        scores.append(F.when(spread > 0, F.pow(F.col(name) - expected, 2) / spread).otherwise(0.0))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return [r["term"] for r in per_term.select("term", best.alias("score")).orderBy(F.desc("score"), "term")
            .limit(most).collect()]


def score_documents(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text",
                    reject: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """id, p_<category> for each category, toxic: is the last (or named) category likely?"""
    names = [m["name"] for m in chain.models]
    decide = names.index(reject) if reject else len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([chain.score(t.as_py()) for t in batch.column(1)]).reshape(len(batch), len(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(scores[:, i]) for i in range(len(names))],
                 pa.array(scores[:, decide] > threshold)], [id_col, *[f"p_{n}" for n in names], "toxic"])

    rows = docs.select(F.col(id_col), whole(F.col(text_col)).alias("__body"))
    kinds = ", ".join(f"`p_{n}` double" for n in names)
    return map_batches(rows, run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {kinds}, toxic boolean")


def without_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the chain does not reject, with all their columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            clean = [chain.score(t.as_py() or "")[-1] <= threshold for t in texts]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return map_batches(docs, run, docs.schema)
