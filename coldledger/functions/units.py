"""Sizes, ages and stat fields as text or numbers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from coldledger.constants import GIB, SIZE_UNITS, TIB

_DAY_MICROS = 86_400_000_000


def as_timestamp(value: Column | datetime | str) -> Column:
    if isinstance(value, Column):
        return value.cast("timestamp")
    return F.lit(str(value)).cast("timestamp")


def days_ago(ts: Column, as_of: Column | datetime | str) -> Column:
    """Whole 24-hour periods from ``ts`` to ``as_of``, rounded down; 0 for a null or epoch-0 time."""
    then, now = F.unix_micros(ts.cast("timestamp")), F.unix_micros(as_timestamp(as_of))
    days = F.floor((now - then) / F.lit(_DAY_MICROS)).cast("long")
    return F.when(then.isNull() | (then == 0), F.lit(0).cast("long")).otherwise(days)


def epoch_days_ago(seconds: Column, as_of: Column | datetime | str) -> Column:
    return days_ago(F.timestamp_seconds(seconds), as_of)


def human_size(size: Column) -> Column:
    """'0B', or the size in the largest fitting unit with at most three decimals."""
    def scaled(power: int) -> Column:
        value = F.bround(size.cast("double") / F.lit(float(1024**power)), 3)
        return F.concat_ws(" ", value.cast("string"), F.lit(SIZE_UNITS[power]))

    text = F.when(size == 0, F.lit("0B"))
    for power in range(len(SIZE_UNITS) - 1):
        text = text.when((size > 0) & (size < F.lit(1024 ** (power + 1))), scaled(power))
    return text.when(size > 0, scaled(len(SIZE_UNITS) - 1))


def octal_mode(mode: Column) -> Column:
    return F.concat(F.lit("0o"), F.lower(F.conv(mode.cast("string"), 10, 8)))


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def to_gib(size: Column, places: int = 2) -> Column:
    return F.round(size / F.lit(float(GIB)), places)


def to_tib(size: Column, places: int = 3) -> Column:
    return F.round(size / F.lit(float(TIB)), places)


def age_years(days: Column) -> Column:
    return F.round(days / F.lit(365.0), 1)
