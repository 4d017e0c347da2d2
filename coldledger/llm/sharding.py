"""Sharding by balanced label propagation.

Documents with equal texts are linked, each through the hash of its text. All rows start in shards of
equal counts. In every round a group of linked rows looks where most of its members are and the others
ask to move there. Only as many may move as leave all counts as they were: moves both ways cancel out,
and a shard that gains more linked rows than it loses sends out as many rows that can give way: those without
links, and small groups that lie in it whole, which stay whole where they go (a move between two shards cuts
one of them at most). So the law ``rows`` holds exactly after every round, and moves put linked rows together.

What the driver sees is one number for each pair of shards. Which rows of a pair move is settled by
ranks: counts for each (input partition, pair) give the offsets, and a window ranks inside one partition,
so no task ranks more rows than an input partition holds, however large a group or a shard is.

Defined cases: null text has size 1 and the checksum of the empty text, and is linked with empty texts.
Null and repeated ids are rows like others. A group that no shard can hold is spread over several. Fewer
rows than shards leave shards empty. No rows: no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldledger.llm.exact import content_hash
from coldledger.llm.shared import checkpointed, whole

SHARDS, ROUNDS = 8, 6
SMALL_SHARE = 50  # a group gives way if it is no more than this part of a shard
_PARTITION_BITS = 33  # of monotonically_increasing_id: rows of a partition are numbered below it


def _offsets(counts: DataFrame, by: list[str]) -> DataFrame:
    """Rows of earlier partitions for each partition (and each value of ``by``)."""
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    if by:
        before = Window.partitionBy(*by).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).drop("n")


def _ranked(rows: DataFrame, cell: str) -> DataFrame:
    """Add ``rank``, 0, 1, 2, ... without gaps among the rows of each cell."""
    offsets = _offsets(rows.groupBy("pid", cell).agg(F.count(F.lit(1)).alias("n")), [cell])
    inside = F.row_number().over(Window.partitionBy("pid", cell).orderBy("rid"))
    return (rows.withColumn("inside", inside).join(offsets, ["pid", cell])
            .withColumn("rank", F.col("offset") + F.col("inside") - 1).drop("offset", "inside"))


def _quotas(wanted: list[list[int]], free: list[int]) -> list[list[int]]:
    """How many of the wanted moves can be made if each shard can send out its free rows.

    Inflows beyond what a shard can make room for are cut in proportion until all shards agree.
    """
    k = len(free)
    given = [row[:] for row in wanted]
    while True:
        changed = False
        for j in range(k):
            inflow, outflow = sum(given[i][j] for i in range(k)), sum(given[j])
            room = outflow + free[j]
            if inflow > room:
                for i in range(k):
                    given[i][j] = given[i][j] * room // inflow
                changed = True
        if not changed:
            return given


def _free_moves(given: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(from, first rank, end rank, to) for the rows without links that fill what the moves left."""
    k = len(given)
    net = [sum(given[i][j] for i in range(k)) - sum(given[j]) for j in range(k)]
    gaps = [[j, -n] for j, n in enumerate(net) if n < 0]
    moves = []
    for j, surplus in enumerate(net):
        at = 0
        while at < surplus:
            to, gap = gaps[-1]
            take = min(gap, surplus - at)
            moves.append((j, at, at + take, to))
            at += take
            gaps[-1][1] -= take
            if not gaps[-1][1]:
                gaps.pop()
    return moves


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard, linked."""
    text = whole(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), content_hash(text).alias("h"),
        F.monotonically_increasing_id().alias("rid"))
    # The row numbers are kept before anything refers to them, so a lost task cannot renumber rows.
    rows = checkpointed(rows)
    # Numbered anew in the order of the hashes, so that ranks keep groups whole; a large group spans partitions.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(rows.repartitionByRange(parts, "h", "rid").sortWithinPartitions("h", "rid")
                        .withColumn("rid", F.monotonically_increasing_id())
                        .withColumn("pid", F.shiftright("rid", _PARTITION_BITS)))
    starts = _offsets(rows.groupBy("pid").agg(F.count(F.lit(1)).alias("n")), [])
    groups = rows.groupBy("h").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    number = F.col("offset") + F.col("rid").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    state = checkpointed(
        rows.join(starts, "pid").withColumn("shard", F.pmod(number, F.lit(shards)).cast("int")).drop("offset")
        .join(groups, "h", "left").withColumn("linked", F.col("members").isNotNull()))
    small = state.count() // (shards * SMALL_SHARE)
    for _ in range(rounds):
        moved = _round(state, shards, small)
        if moved is None:
            break
        state = checkpointed(moved)
    return _ranked(state, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard",
        F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked")


def _round(state: DataFrame, shards: int, small: int = 0) -> DataFrame | None:
    """The state after one round of moves; None if none can be made."""
    tally = state.where("linked").groupBy("h", "shard").agg(F.count(F.lit(1)).alias("n"))
    # Ties between shards fall differently for each group, so that no shard is asked for more than others.
    goal = tally.groupBy("h").agg(
        F.max_by("shard", F.struct("n", F.xxhash64("h", "shard"))).alias("goal"), F.max("n").alias("there"))
    aimed = state.join(goal, "h", "left")
    gives_way = ~F.col("linked") | ((F.col("there") == F.col("members")) & (F.col("members") <= small))
    aimed = aimed.withColumn("cell", F.when(gives_way, shards * shards + F.col("shard"))
                             .otherwise(F.col("shard") * shards + F.coalesce("goal", "shard"))).drop("goal", "there")
    aimed = checkpointed(aimed)
    counts = {r["cell"]: r["n"] for r in aimed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = [[counts.get(i * shards + j, 0) if i != j else 0 for j in range(shards)] for i in range(shards)]
    given = _quotas(wanted, [counts.get(shards * shards + j, 0) for j in range(shards)])
    moves = [(i * shards + j, 0, n, j) for i, row in enumerate(given) for j, n in enumerate(row) if n]
    if not moves:
        return None
    moves += [(shards * shards + i, low, end, to) for i, low, end, to in _free_moves(given)]
    cells = F.col("cell").isin(sorted({m[0] for m in moves}))
    ranked = _ranked(aimed.where(cells), "cell")
    placed = ranked.withColumn("shard", _destination(moves)).drop("rank")
    return placed.unionByName(aimed.where(~cells)).drop("cell")


def _destination(moves: list[tuple[int, int, int, int]]) -> Column:
    """The new shard of a row by its cell and rank; at most a few entries for each pair of shards."""
    fits = [((F.col("cell") == cell) & (F.col("rank") >= low) & (F.col("rank") < end), to)
            for cell, low, end, to in moves]
    return reduce(lambda otherwise, m: F.when(m[0], F.lit(m[1])).otherwise(otherwise), fits, F.col("shard"))


def cut_links(assigned: DataFrame, by: str = "text_crc32") -> int:
    """Pairs of rows with equal ``by`` in different shards."""
    tally = assigned.groupBy(by, "shard").agg(F.count(F.lit(1)).alias("n"))
    pairs = tally.groupBy(by).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("within"))
    return pairs.agg(F.sum((F.col("all") * F.col("all") - F.col("within")) / 2)).first()[0] or 0


def split_groups(assigned: DataFrame, by: str = "text_crc32") -> DataFrame:
    """How many groups of equal ``by`` lie in how many shards: what the moves are to lower."""
    return (assigned.groupBy(by).agg(F.countDistinct("shard").alias("shards"), F.count(F.lit(1)).alias("n"))
            .where("n > 1").groupBy("shards").agg(F.count(F.lit(1)).alias("groups")))
