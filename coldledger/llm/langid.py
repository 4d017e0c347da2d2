"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary linear model on hashed byte n-grams predicts
whether the text's language has a 1 there. Decoding weighs the loss of every bit model by how well that
model did on the sample, and takes the language whose codeword has the smallest total loss; if the second
best is close, the answer is flagged as ambiguous.

Fitting uses at most ``PER_LANGUAGE`` labelled documents of each language, those with the smallest hash
of their id. Predictions use the text alone, and the whole of it.

Defined cases: null texts and texts without a letter are ``und`` with score 0. Documents without a
language are not learned from. Without any language to learn everything is ``und``; with just one, that
one has score 1. Languages tie by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldledger.llm.linear import sigmoid
from coldledger.llm.shared import map_batches, whole

PER_LANGUAGE = 1_000
DIMENSIONS = 4_096
GRAMS = (1, 2, 3)
MOST_BITS = 63
AMBIGUOUS = 0.1  # margin of score below which an answer is flagged
CHUNK = 1 << 20  # bytes whose n-grams are hashed at a time
UNDETERMINED = "und"


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams of the lower-case UTF-8 bytes; unit length."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.zeros(DIMENSIONS)
    for at in range(0, len(data), CHUNK):
        part = data[at:at + CHUNK + max(GRAMS) - 1].astype(np.uint32)
        for n in GRAMS:
            starts = min(CHUNK, len(part) - n + 1)
            if starts > 0:
                code = np.full(starts, n, dtype=np.uint32)
                for i in range(n):
                    code = code * np.uint32(0x01000193) ^ part[i:i + starts]
                code ^= code >> np.uint32(15)
                counts += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=DIMENSIONS)
    return np.sqrt(counts / max(1.0, counts.sum())).astype(np.float32)


def codewords(classes: int) -> np.ndarray:
    """One row of +1 and -1 for each class.

    Up to 7 classes: all different splits into two parts. More: MOST_BITS or more columns of a fixed random
    code without equal rows; its distance grows with its length.
    """
    if classes <= 7:
        splits = np.arange(1, 1 << max(0, classes - 1))
        code = np.array([[1] * len(splits)] + [[-1 if s >> i & 1 else 1 for s in splits] for i in range(classes - 1)])
        return code.reshape(classes, len(splits))
    bits = max(MOST_BITS, 4 * int(np.ceil(np.log2(classes))))
    best, widest = None, -1
    for seed in range(50):
        code = np.where(np.random.default_rng(seed).random((classes, bits)) < 0.5, -1, 1)
        products = code @ code.T - 2 * bits * np.eye(classes, dtype=int)
        distance = (bits - int(products.max())) // 2
        split = (np.abs(code.sum(axis=0)) < classes).all()
        if split and distance > widest:
            best, widest = code, distance
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # dimensions x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Rows x languages: trusted mean of the logistic loss of each bit against the codeword."""
        margin = x @ self.weights + self.bias
        loss_one, loss_zero = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        is_one = (self.code > 0).astype(float)
        return (loss_one * self.trust) @ is_one.T + (loss_zero * self.trust) @ (1 - is_one).T

    def decide(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each row."""
        if len(self.languages) == 1:
            return self.languages * len(x), np.ones(len(x)), np.zeros(len(x), dtype=bool)
        loss = self.losses(x)
        likely = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * len(self.trust) / 2)
        likely /= likely.sum(axis=1, keepdims=True)
        best = likely.argmax(axis=1)
        ranked = np.sort(likely, axis=1)
        return [self.languages[b] for b in best], ranked[:, -1], ranked[:, -1] - ranked[:, -2] < AMBIGUOUS


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on labelled documents where ``learn`` holds; None if there are none."""
    # Only ids are ranked; the limit on ranks reaches the tasks before the shuffle.
    usable = docs.where(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    picked = (usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
              .withColumn("rank", rank).where(F.col("rank") <= per_language).select("id", "lang").distinct())
    # Bounded by per_language ids for each language.
    texts = (usable.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))
             .join(F.broadcast(picked), ["id", "lang"]).select("lang", "body"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()).astype(np.float16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["lang", "x"])

    got = map_batches(texts, vectors, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    order = sorted(range(got.num_rows), key=lambda i: (got["lang"][i].as_py(), got["x"][i].as_py()))
    names = [got["lang"][i].as_py() for i in order]
    x = np.stack([np.frombuffer(got["x"][i].as_py(), dtype=np.float16) for i in order]).astype(np.float32)
    languages = sorted(set(names))
    y = np.array([languages.index(n) for n in names])
    code = codewords(len(languages))
    target = (code[y] > 0).astype(np.float32)
    balance = (1.0 / np.bincount(y))[y][:, None] / len(languages)
    weights, bias = np.zeros((DIMENSIONS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m = [np.zeros_like(weights), np.zeros_like(bias)]
    v = [np.zeros_like(weights), np.zeros_like(bias)]
    for step in range(1, 121):
        residual = ((sigmoid(x @ weights + bias) - target) * balance).astype(np.float32)
        for i, (param, grad) in enumerate(((weights, x.T @ residual + 1e-5 * weights), (bias, residual.sum(axis=0)))):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad * grad
            param -= 0.5 * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    margin = np.where(target > 0, 1, -1) * (x @ weights + bias)
    loss = (np.logaddexp(0, -margin) * balance).sum(axis=0)
    trust = 1.0 / (loss + 0.05)
    return Model(languages, code, weights, bias, trust / trust.sum())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = np.array([model is not None and any(map(str.isalpha, t)) for t in texts], dtype=bool)
            names, scores, unsure = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
            rows = np.flatnonzero(known)
            for at in range(0, len(rows), 512):
                part = rows[at:at + 512]
                found, score, close = model.decide(np.stack([features(texts[i]) for i in part]))
                scores[part], unsure[part] = score, close
                for i, name in zip(part, found, strict=True):
                    names[i] = name
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names), pa.array(scores), pa.array(unsure)],
                [id_col, "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col), whole(F.col(text_col)).alias("__body"))
    kind = rows.schema[id_col].dataType.simpleString()
    return map_batches(rows, run, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")
