"""Line dedup: which lines of a document stay, as one compressed bitmap per document.

Every line's key (stripped, A to Z lower-cased) becomes a 128-bit hash. The hashes are range-partitioned with
a secondary sort by document and position, so that equal lines stream by in order, first occurrence first. The
document and the position belong to the range key, so a line that fills a third of the corpus is spread over
as many tasks as its rows need; each task hands on one summary row for the runs at its two ends, and these are put
together afterwards. A task holds at most the lines of ``min_docs`` documents of one run. Texts take no part in
this: only hashes and positions move, and what comes back are positions, packed as bits and compressed.

A key that occurs in at least ``min_docs`` documents loses all its lines, or with ``keep_first`` all but the first
occurrence (least document, then least position).

Defined cases: a document is an id with its text, so rows that repeat both are the same document and get the same
bitmap. Null text counts as empty: one empty line. Rows without an id are documents as well, told apart by their
text. A line whose key has fewer than ``min_chars`` code points always stays. No rows: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldledger.llm.shared import ascii_lower, map_batches, whole
from coldledger.session import work_dir

BLANKS = " \t\n\x0b\f\r"
DROP, PENDING, SUMMARY = 0, 1, 2
FIELDS = ("h1", "h2", "doc", "body_hash", "pos")
RUN_SCHEMA = ("kind int, h1 long, h2 long, doc long, body_hash long, pos long, part int, docs long, "
              "last_doc long, last_body_hash long")
ARROW_SCHEMA = pa.schema([(name, pa.int32() if kind == "int" else pa.int64())
                          for name, kind in (field.split() for field in RUN_SCHEMA.split(", "))])


def line_key(line: Column) -> Column:
    """What two lines must share to be the same."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _identity(id_col: str, text: Column) -> list[Column]:
    """An id with its text: (doc, body_hash); a missing id differs from any other by the hash."""
    own = F.col(f"`{id_col}`").cast("long")
    return [F.coalesce(own, F.lit(0)).cast("long").alias("doc"), F.xxhash64(own.isNull(), text).alias("body_hash")]


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, doc, body_hash, pos) of every line that can be dropped."""
    text = whole(F.col(f"`{text_col}`"))
    # The identity is a column before the text is split, or it would be hashed again for each line.
    named = docs.select(*_identity(id_col, text), text.alias("body"))
    rows = named.select("doc", "body_hash", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    key = line_key(F.col("line"))
    # Two hashes of 64 bits with different seeds.
    return rows.where(F.length(key) >= min_chars).select(
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "doc", "body_hash",
        F.col("pos").cast("long").alias("pos"))


class _Runs:
    """Runs of equal hashes over the sorted rows (columns FIELDS) of one partition, batch by batch."""

    def __init__(self, min_docs: int, keep_first: bool, part: int):
        self.min_docs, self.keep_first, self.part = min_docs, keep_first, part
        self.last = None  # the row before
        self.held = None  # rows of the run that is open, its first one first
        self.at_start = True  # nothing lies between it and the start of the partition

    def feed(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        before = np.full((1, rows.shape[1]), 0) if self.last is None else self.last
        same = (rows == np.concatenate((before, rows[:-1]))).all(axis=1)
        same[0] &= self.last is not None
        rows = rows[~same]  # rows of repeated documents
        if not len(rows):
            return
        cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))
        first = 0
        if self.last is None or (rows[0, :2] == self.last[0, :2]).all():
            yield from self._extend(rows[:ends[0]])
            first = 1
        self.last = rows[-1:].copy()
        if first < len(starts):
            yield from self.close()
            if first < len(starts) - 1:
                yield self._inner(rows[starts[first]:ends[-2]], starts[first:-1] - starts[first])
            yield from self._extend(rows[starts[-1]:].copy())

    def _inner(self, rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        """Whole runs: the lines that go."""
        new_doc = np.ones(len(rows), dtype=np.int64)
        new_doc[1:] = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
        many = np.add.reduceat(new_doc, starts) >= self.min_docs
        goes = np.repeat(many, np.diff(np.append(starts, len(rows))))
        if self.keep_first:
            goes[starts] = False
        return self._batch(DROP, rows[goes])

    def _extend(self, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """More of the open run. All but its first row go as soon as it has enough documents."""
        docs = 1 + int((rows[1:, 2:4] != rows[:-1, 2:4]).any(axis=1).sum())
        if self.held is None:
            self.docs, self.held = docs, [rows]
        else:
            self.docs += docs - bool((rows[0, 2:4] == self.run_end[0, 2:4]).all())
            self.held.append(rows)
        self.run_end = rows[-1:].copy()
        if self.docs >= self.min_docs:
            held = np.concatenate(self.held)
            self.held = [held[:1]]
            yield self._batch(DROP, held[1:])

    def close(self, at_end: bool = False) -> Iterator[pa.RecordBatch]:
        """The open run ends. One at an end of the partition may go on in another partition."""
        if self.held is not None:
            held = np.concatenate(self.held)
            if self.at_start or at_end:
                yield self._batch(PENDING, held)
                yield self._batch(SUMMARY, held[:1], self.docs, self.run_end)
            elif self.docs >= self.min_docs and not self.keep_first:
                yield self._batch(DROP, held)
            self.held = None
        self.at_start = False

    def _batch(self, kind: int, rows: np.ndarray, docs: int = 0, end: np.ndarray | None = None) -> pa.RecordBatch:
        same = lambda value: np.full(len(rows), value)
        last = rows if end is None else end
        columns = [same(kind), *rows.T, same(self.part), same(docs), last[:, 2], last[:, 3]]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c), field.type, safe=False) for c, field in zip(columns, ARROW_SCHEMA, strict=True)],
            schema=ARROW_SCHEMA)


def dropped_lines(lines: DataFrame, min_docs: int, keep_first: bool = False, partitions: int | None = None) -> DataFrame:
    """(doc, body_hash, pos) of the lines that go, from the rows of ``lines_of``."""
    spark = lines.sparkSession

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(min_docs, keep_first, TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                yield from runs.feed(np.column_stack([c.to_numpy() for c in batch.columns]))
        yield from runs.close(at_end=True)

    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.select(*FIELDS).repartitionByRange(count, *FIELDS).sortWithinPartitions(*FIELDS)
    folder = work_dir(spark, "line-runs")
    map_batches(ordered, stream, RUN_SCHEMA).write.parquet(folder)
    found = spark.read.schema(RUN_SCHEMA).parquet(folder)
    # At most two summaries for each partition. A document cut by a boundary counts once.
    by_part = Window.partitionBy("h1", "h2").orderBy("part")
    goes_on = (F.lag("last_doc").over(by_part) == F.col("doc")) & (F.lag("last_body_hash").over(by_part) == F.col("body_hash"))
    totals = (found.where(F.col("kind") == SUMMARY)
              .withColumn("docs", F.col("docs") - F.when(goes_on, 1).otherwise(0))
              .groupBy("h1", "h2").agg(F.sum("docs").alias("total"),
                                       F.min_by(F.struct("doc", "body_hash", "pos"), "part").alias("head"))
              .where(F.col("total") >= min_docs))
    place = ["doc", "body_hash", "pos"]
    later = found.where(F.col("kind") == PENDING).select("h1", "h2", *place).join(totals, ["h1", "h2"])
    if keep_first:
        later = later.where(F.struct(*place) != F.col("head"))
    return found.where(F.col("kind") == DROP).select(*place).unionByName(later.select(*place))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, body_hash, n_lines, lost positions) -> bitmaps."""
    for batch in batches:
        n_dropped, keep = [], []
        for n, lost in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            bits = np.ones(n, dtype=np.uint8)
            if lost.is_valid:
                bits[lost.values.to_numpy()] = 0
            n_dropped.append(n - int(bits.sum()))
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(n_dropped, pa.int64()), pa.array(keep, pa.binary())],
            names=["doc", "body_hash", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 2, min_chars: int = 1, keep_first: bool = False,
                 id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per different document: (doc, body_hash, n_lines, n_dropped, keep).

    ``keep`` has one bit per line, the highest bit of the first byte for the first line; zlib-compressed.
    """
    text = whole(F.col(f"`{text_col}`"))
    sizes = docs.select(*_identity(id_col, text), F.size(F.split(text, "\n")).cast("long").alias("n_lines")).distinct()
    lost = dropped_lines(lines_of(docs, id_col, text_col, min_chars), min_docs, keep_first, partitions)
    per_doc = lost.groupBy("doc", "body_hash").agg(F.collect_list("pos").alias("lost"))
    joined = sizes.join(per_doc, ["doc", "body_hash"], "left").select("doc", "body_hash", "n_lines", "lost")
    return map_batches(joined, _packed, "doc long, body_hash long, n_lines long, n_dropped long, keep binary")


def kept_text(text: str, keep: bytes) -> str:
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, bit in zip(lines, bits, strict=True) if bit)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs``: (id, n_lines, n_dropped, text), where text has the lines that stay."""
    text = whole(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *_identity(id_col, text), text.alias("body"))
    # Texts that lose nothing need no bitmap, so most rows pass the Python worker with a null in its place.
    own = bitmaps.select("doc", "body_hash", "n_lines", "n_dropped", F.when(F.col("n_dropped") > 0, F.col("keep")).alias("keep"))
    joined = rows.join(own, ["doc", "body_hash"]).select("id", "n_lines", "n_dropped", "body", "keep")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [body.as_py() if not keep.is_valid else kept_text(body.as_py(), keep.as_py())
                     for body, keep in zip(batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(texts, pa.string())], names=["id", "n_lines", "n_dropped", "text"])

    id_type = docs.schema[id_col].dataType.simpleString()
    kept = map_batches(joined, strip, f"id {id_type}, n_lines long, n_dropped long, text string")
    return kept.withColumnRenamed("id", id_col)
