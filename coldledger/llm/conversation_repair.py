"""Repair of conversation structure: the cheapest edits that make the roles alternate, by branch and bound.

Roles must read ``(s?(ua)+)?``: a system message may open, then user and assistant take turns and the assistant has
the last word. Edits and their costs: Keep 0, Rerole to user or assistant 2, Delete 3 (the only edit for a blank or
repeated message), Insert an empty message of user or assistant 2; a cut-off message that is not deleted adds 1. Of
the cheapest edits those stand whose initials, in order, are the least string (D < I < K < R).

The search (``search``) is depth first with a stack of its own. A node is a message and the state of the roles
before it. A backward pass over costs alone gives every node a lower bound for what is left; the best solution so far
is the incumbent (cost, audit); a table keeps the least cost at which each node was reached, and a prefix that comes
later at no less is dropped. The search ends when no node on the stack can beat the incumbent.

How a conversation of any length is dealt out: equal messages at one place (same turn, role and text) are one row with
a count, since all but the first of them can only go. The rows are range-partitioned by conversation and place, so
that a conversation may lie over many partitions, and numbered; ``BLOCK`` consecutive numbers are a block. A
conversation inside a block is solved there. Of one that reaches over an end of a block each block solves its
segment for every pair of states before and after it; a pass over the segments, which holds four costs and a few
bytes per segment, chooses one pair for each. Texts stay out of all this (hashes stand for them) and come back once.

Defined cases: a null role or text is one space. Rows are taken by turn, nulls first, and those of one turn by role,
then by the first ``PREFIX`` code points of the text, then by its hash. Rows without a conversation id are one
conversation. A conversation has no row here if it has no messages. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldledger.llm.shared import map_batches, ship_package
from coldledger.session import work_dir

BLOCK_BITS = 11
BLOCK = 1 << BLOCK_BITS
PREFIX = 100
BLANKS = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: State after an inserted or reroled message, and after a kept one by its initial.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Messages to insert at the end of a conversation.
TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
LEGAL = ("su", "ua", "au")

Message = tuple[str, bool, bool]  # initial of the role, must go, cut off


# --- the search ----------------------------------------------------------------------------------------------------

def _steps(message: Message, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits of one message."""
    initial, must_go, cut_off = message
    yield "D", DELETE, state
    if not must_go:
        if (state, initial) in KEPT:
            yield "K", KEEP + CUT_OFF * cut_off, KEPT[state, initial]
        yield "R", REROLE + CUT_OFF * cut_off, NEXT[state]


def suffix_bounds(messages: Sequence[Message], at_end: dict[int, float]) -> list[list[float]]:
    """For each position and state a lower bound of what the rest costs; ``at_end``: cost of ending in a state."""
    bounds = [[0.0] * 4 for _ in messages] + [[at_end.get(q, math.inf) for q in STATES]]
    for i in range(len(messages) - 1, -1, -1):
        row = [min(cost + bounds[i + 1][after] for _, cost, after in _steps(messages[i], q)) for q in STATES]
        for _ in range(2):  # up to two insertions before the message
            row = [min(row[q], INSERT + row[NEXT[q]]) for q in STATES]
        bounds[i] = row
    return bounds


def search(messages: Sequence[Message], entry: int, exit_state: int | None = None) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from ``entry`` to ``exit_state``, or to a whole conversation if that is None.

    Insertions stand before a message; those after the last one belong to the end of a conversation only. None if
    there is no way.
    """
    ends = {q: INSERT * TO_END[q] for q in STATES} if exit_state is None else {exit_state: 0}
    bounds = suffix_bounds(messages, ends)
    least: dict[tuple[int, int], float] = {}
    incumbent: tuple[float, str] = (math.inf, "")
    # (cost so far, position, state, (letter, link to the letters before))
    stack: list[tuple] = [(0, 0, entry, None)]
    while stack:
        cost, i, state, link = stack.pop()
        if cost + bounds[i][state] >= incumbent[0] or cost >= least.get((i, state), math.inf):
            continue
        least[i, state] = cost
        if i == len(messages):
            incumbent = (cost + ends[state], _audit(link) + "I" * (TO_END[state] if exit_state is None else 0))
            continue
        ways = [(cost + c, i + 1, after, (letter, link)) for letter, c, after in _steps(messages[i], state)]
        ways.append((cost + INSERT, i, NEXT[state], ("I", link)))
        # The last one pushed is looked at first: the least bound, then the least letter.
        ways.sort(key=lambda way: (way[0] + bounds[way[1]][way[2]], way[3][0]), reverse=True)
        stack += ways
    return None if incumbent[0] == math.inf else (int(incumbent[0]), incumbent[1])


def _audit(link: tuple | None) -> str:
    letters = []
    while link is not None:
        letter, link = link
        letters.append(letter)
    return "".join(reversed(letters))


def walk(entry: int, steps: str, initials: Sequence[str]) -> Iterator[tuple[int, str, str | None]]:
    """(index of the message that the edit belongs to, letter, new role) of what stands after the edits."""
    state, i = entry, 0
    for letter in steps:
        if letter in "IR":
            state = NEXT[state]
            yield i, letter, ROLES[state]
        elif letter == "K":
            state = KEPT[state, initials[i]]
            yield i, letter, None
        i += letter != "I"


# --- rows and their faults -----------------------------------------------------------------------------------------

def messages_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """(conv, has_turn, turn, role, hash, text): keys without nulls, in the order of messages."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    conv, turn = F.col(f"`{conv_col}`").cast("string"), F.col(f"`{turn_col}`").cast("long")
    return rows.select(
        F.coalesce(F.concat(F.lit("="), conv), F.lit("")).alias("conv"), turn.isNotNull().alias("has_turn"),
        F.coalesce(turn, F.lit(0)).cast("long").alias("turn"), filled(role_col).alias("role"),
        F.md5(filled(text_col)).alias("hash"), filled(text_col).alias("text"))


PLACE = ["conv", "has_turn", "turn", "role", "hash"]


def with_faults(messages: DataFrame) -> DataFrame:
    """One row per different message at one place: PLACE, prefix, copies, blank, again, cut_off.

    again: the same role and text stand at an earlier place; the copies after the first are duplicates anyway.
    """
    bare = F.btrim("text", F.lit(BLANKS))
    facts = messages.select(
        *PLACE, F.left("text", F.lit(PREFIX)).alias("prefix"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut_off"))
    counted = facts.groupBy(*PLACE, "prefix", "blank", "cut_off").agg(F.count(F.lit(1)).alias("copies"))
    at = F.struct("has_turn", "turn")
    first = facts.groupBy("conv", "role", "hash").agg(F.min(at).alias("first"))
    return counted.join(first, ["conv", "role", "hash"]).select(
        *PLACE, "prefix", "copies", "blank", (at != F.col("first")).alias("again"), "cut_off")


def numbered(facts: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows in order with consecutive ids inside a partition, from a table in the shared folder."""
    spark = facts.sparkSession
    order = ["conv", "has_turn", "turn", "role", "prefix", "hash"]
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_dir(spark, "messages")
    (facts.repartitionByRange(count, *order).sortWithinPartitions(*order).drop("prefix")
     .withColumn("id", F.monotonically_increasing_id()).write.parquet(path))
    return spark.read.parquet(path)


# --- blocks --------------------------------------------------------------------------------------------------------

SEGMENT_SCHEMA = ("conv string, block long, first_id long, edge boolean, initials array<string>, copies array<long>, "
                  "illegal long, costs array<long>, steps array<string>")


def _segments(block: pa.Table) -> pa.Table:
    """The messages of each conversation in a block, solved."""
    rows = sorted(block.to_pylist(), key=lambda row: row["id"])
    starts = [n for n, row in enumerate(rows) if n == 0 or row["conv"] != rows[n - 1]["conv"]]
    out = []
    for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
        mine = rows[start:end]
        messages = [(row["initial"], row["blank"] or row["again"], row["cut_off"]) for row in mine]
        initials = [row["initial"] for row in mine]
        edge = start == 0 or end == len(rows)
        ways = [search(messages, a, b) for a in STATES for b in STATES] if edge else [search(messages, START)]
        out.append({
            "conv": mine[0]["conv"], "block": mine[0]["block"], "first_id": mine[0]["id"], "edge": edge,
            "initials": initials, "copies": [row["copies"] for row in mine],
            "illegal": sum(row["copies"] - 1 for row in mine) + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            "costs": [way and way[0] for way in ways], "steps": [way and way[1] for way in ways]})
    return pa.Table.from_pylist(out, schema=pa.schema([
        ("conv", pa.string()), ("block", pa.int64()), ("first_id", pa.int64()), ("edge", pa.bool_()),
        ("initials", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), ("illegal", pa.int64()),
        ("costs", pa.list_(pa.int64())), ("steps", pa.list_(pa.string()))]))


def block_segments(rows: DataFrame) -> DataFrame:
    """Segments of at most BLOCK messages. One at an end of its block (edge) has a solution for each pair of states."""
    ship_package(rows.sparkSession)
    return (rows.select("id", F.shiftright("id", BLOCK_BITS).alias("block"), "conv",
                        F.left("role", F.lit(1)).alias("initial"), "blank", "again", "cut_off", "copies")
            .groupBy("block").applyInArrow(_segments, SEGMENT_SCHEMA))


class _Chain:
    """Segments of one conversation, one after the other."""

    def __init__(self, conv: str):
        self.conv, self.blocks, self.back = conv, [], []
        self.ways = {START: (0, 0)}  # state -> (cost, rank of its audit among those of the other states)
        self.last, self.illegal = None, []

    def add(self, block: int, first: str, last: str, costs: list, steps: list) -> None:
        new = {}
        for b in STATES:
            ways = [(cost + costs[4 * a + b], rank, steps[4 * a + b], a) for a, (cost, rank) in self.ways.items()
                    if costs[4 * a + b] is not None]
            if ways:
                new[b] = min(ways)
        # Audits of equally many messages never begin with one another, so ranks and steps order them.
        order = sorted(new, key=lambda b: new[b][1:3])
        self.ways = {b: (new[b][0], order.index(b)) for b in new}
        self.back.append(bytes(new[b][3] if b in new else 0 for b in STATES))
        self.blocks.append(block)
        self.illegal.append(self.last is not None and self.last + first not in LEGAL)
        self.last = last

    def choices(self) -> Iterator[tuple]:
        state = min(self.ways, key=lambda q: (self.ways[q][0] + INSERT * TO_END[q], self.ways[q][1]))
        tail = TO_END[state]
        for block, back, illegal in zip(reversed(self.blocks), reversed(self.back), reversed(self.illegal), strict=True):
            yield self.conv, block, back[state], state, tail, int(illegal)
            state, tail = back[state], 0


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order -> (conv, block, entry, exit, tail, illegal): the states that each one leads between."""
    names = ["conv", "block", "entry", "exit", "tail", "illegal"]

    def done(chain: _Chain) -> pa.RecordBatch:
        columns = zip(*chain.choices(), strict=True)
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    chain = None
    for batch in batches:
        for row in batch.to_pylist():
            if chain is not None and chain.conv != row["conv"]:
                yield done(chain)
                chain = None
            chain = chain or _Chain(row["conv"])
            chain.add(row["block"], row["first"], row["last"], row["costs"], row["steps"])
    if chain is not None:
        yield done(chain)


PIECE_SCHEMA = ("conv string, block long, illegal long, cost long, audit string, "
                "edits array<struct<id: long, sub: int, letter: string, role: string>>")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with the chosen solution -> audits and edits."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            whole, copies = not row["edge"], row["copies"]
            way = 0 if whole else 4 * row["entry"] + row["exit"]
            steps = row["steps"][way] + ("" if whole else "I" * row["tail"])
            audit, i = [], 0
            for letter in steps:
                audit.append(letter)
                if letter != "I":
                    audit.append("D" * (copies[i] - 1))  # further copies go
                    i += 1
            edits, before, n = [], -1, len(copies)
            for i, letter, role in walk(START if whole else row["entry"], steps, row["initials"]):
                before, sub = i, 0 if i != before else sub + 1
                # Insertions before a message, then the message; those at the end follow the last one.
                edits.append({"id": row["first_id"] + min(i, n - 1), "sub": sub + (10 if i == n else 0), "letter": letter, "role": role})
            out.append({
                "conv": row["conv"], "block": row["block"], "illegal": row["illegal"] + (row["cross"] or 0),
                "cost": row["costs"][way] + INSERT * (0 if whole else row["tail"]) + DELETE * sum(c - 1 for c in copies),
                "audit": "".join(audit), "edits": edits})
        yield pa.RecordBatch.from_pylist(out, schema=_PIECES)


_PIECES = pa.schema([
    ("conv", pa.string()), ("block", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("edits", pa.list_(pa.struct([("id", pa.int64()), ("sub", pa.int32()), ("letter", pa.string()), ("role", pa.string())])))])


def solved_pieces(rows: DataFrame) -> DataFrame:
    """PIECE_SCHEMA: every segment's part of its conversation's solution, from a table in the shared folder."""
    spark = rows.sparkSession
    folder = work_dir(spark, "repair")
    block_segments(rows).write.parquet(f"{folder}/segments")
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{folder}/segments")
    # Few rows: two segments per block, or all those of a conversation longer than a block.
    edges = segments.where("edge").select("conv", "block", F.element_at("initials", 1).alias("first"),
                                          F.element_at("initials", -1).alias("last"), "costs", "steps")
    chosen = map_batches(edges.repartition("conv").sortWithinPartitions("conv", "block"), _chained,
                         "conv string, block long, entry int, exit int, tail int, illegal long")
    joined = segments.join(chosen.withColumnRenamed("illegal", "cross"), ["conv", "block"], "left")
    map_batches(joined, _pieces, PIECE_SCHEMA).write.parquet(f"{folder}/pieces")
    return spark.read.schema(PIECE_SCHEMA).parquet(f"{folder}/pieces")


# --- results -------------------------------------------------------------------------------------------------------

def _id(conv_type: str) -> Column:
    return F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30).cast(conv_type))


class Repair:
    """Repair of all conversations in ``rows``; the tables below are made from the same solution."""

    def __init__(self, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", partitions: int | None = None):
        self.conv_col, self.conv_type = conv_col, rows.schema[conv_col].dataType.simpleString()
        self.messages = messages_of(rows, conv_col, turn_col, role_col, text_col)
        self.rows = numbered(with_faults(self.messages), partitions)
        self.pieces = solved_pieces(self.rows)

    def audits(self) -> DataFrame:
        """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        turn = F.when(F.col("has_turn"), F.col("turn"))
        counts = self.rows.groupBy("conv").agg(
            F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"),
            F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
            F.sum(F.when(~F.col("blank"), F.col("copies") - 1 + F.col("again").cast("int")).otherwise(0)).alias("duplicate"),
            F.count_if(~F.col("blank") & ~F.col("again") & F.col("cut_off")).alias("truncated"))
        parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
        edits = self.pieces.groupBy("conv").agg(
            F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
            F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
        return counts.join(edits, "conv").select(_id(self.conv_type).alias(self.conv_col), "gaps", "blank", "duplicate",
                                                 "truncated", "illegal", "cost", "audit")

    def _repaired(self) -> DataFrame:
        edits = self.pieces.select("conv", F.inline("edits"))
        # Edits of messages find their rows, and these find their texts.
        stays = (edits.where("letter <> 'I'").select("id", "sub", F.col("role").alias("new_role"))
                 .join(self.rows.select("id", *PLACE), "id"))
        texts = self.messages.groupBy(*PLACE).agg(F.max("text").alias("text"))
        kept = stays.join(texts, PLACE).select("conv", "id", "sub", F.coalesce("new_role", "role").alias("role"), "text")
        return kept.unionByName(edits.where("letter = 'I'").select("conv", "id", "sub", "role", F.lit("").alias("text")))

    def repaired(self) -> DataFrame:
        """The messages after repair: id, place (its numbers grow along a conversation), role, text."""
        return self._repaired().select(_id(self.conv_type).alias(self.conv_col), F.struct("id", "sub").alias("place"), "role", "text")

    def digests(self) -> DataFrame:
        """(id, sha256 of the repaired ``role:text`` lines joined by newlines); none for emptied conversations.

        A digest needs a conversation's text from start to end, so each is streamed through one task, which holds
        one batch of it.
        """
        lines = (self._repaired().select("conv", "id", "sub", F.concat_ws(":", "role", "text").alias("line"))
                 .repartition("conv").sortWithinPartitions("conv", "id", "sub").select("conv", "line"))
        found = map_batches(lines, _hashed, "conv string, sha256 string")
        return found.select(_id(self.conv_type).alias(self.conv_col), "sha256")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None
    for batch in batches:
        out = []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if conv != now or digest is None:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode())
        yield _digest_rows(out)
    if digest is not None:
        yield _digest_rows([(now, digest.hexdigest())])


def _digest_rows(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["conv", "sha256"])
