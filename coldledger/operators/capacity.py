"""Smallest machine that fits a need."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.constants import MACHINE_DISK_GB


def best_fit_capacity(needs: DataFrame, capacity: Mapping[str, float] = MACHINE_DISK_GB,
                      factor: float = 1.5, need: str = "need") -> DataFrame:
    """Add the smallest type whose capacity exceeds ``factor`` times the need; null when none does.

    Needs above 1 get 5 more as headroom. The type list is a constant, so this is one expression.
    """
    asked = F.col(need).cast("double")
    wanted = F.when(asked > 1, asked + 5).otherwise(asked)
    chosen = F.lit(None).cast("string")
    for name, size in sorted(capacity.items(), key=lambda item: -item[1]):
        chosen = F.when(F.lit(float(size)) > wanted * F.lit(factor), F.lit(name)).otherwise(chosen)
    return needs.withColumn("machine", chosen)
