"""Ids to names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_owner(df: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """Add owner and group_name; an unknown id is kept as text.

    Plain joins: the sizes that are seen at run time decide between a broadcast and a shuffle, and
    a user who owns a third of all files is split by the adaptive skew join.
    """
    named = df
    for lookup, key, source, target in (
            (users, "uid", "user", "owner"), (groups, "gid", "group_name", "group_name")):
        names = lookup.select(key, F.col(source).alias("_name"))
        named = (named.join(names, key, "left")
                 .withColumn(target, F.coalesce("_name", F.col(key).cast("string"))).drop("_name"))
    return named
