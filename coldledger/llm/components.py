"""Connected components by alternating large-star and small-star steps.

Each step replaces the edges of every vertex by edges to its smallest neighbour, so the number of
edges never grows past two per vertex and edge, long chains shrink by a factor each round, and no
task ever holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.llm.shared import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(least, "u").where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def component_labels(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex of ``edges`` (columns a, b); root: the smallest vertex reachable.

    Nulls and loops are dropped, repeated edges count once, direction does not matter. No edges: no rows.
    """
    now = checkpointed(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        # The state of all edges in two numbers; equal states mean that every edge leads to its root.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        now = checkpointed(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
