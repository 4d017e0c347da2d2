"""Checks shared by the scans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    require_columns_in(df.columns, columns)
    return df


def require_columns_in(found: Sequence[str], columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in found]
    if missing:
        raise ValueError(f"missing columns {missing}; found {list(found)}")
