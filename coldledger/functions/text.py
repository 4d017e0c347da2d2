"""Search-text helpers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from coldledger.constants import SEARCH_PUNCTUATION

_NUMBER = (r"(?i)^\s*[+-]?((\d(_?\d)*(\.(\d(_?\d)*)?)?|\.\d(_?\d)*)(e[+-]?\d(_?\d)*)?"
           r"|inf(inity)?|nan)\s*$")


def clean_search(text: Column) -> Column:
    """Each punctuation character becomes one blank."""
    return F.translate(text, SEARCH_PUNCTUATION, " " * len(SEARCH_PUNCTUATION))


def is_number(text: Column) -> Column:
    """True for decimal, exponent, 'inf' and 'nan' notations."""
    return text.rlike(_NUMBER)


def search_words(query: str) -> list[str]:
    """Lower-case words of a query after its punctuation became blanks."""
    blanks = str.maketrans(SEARCH_PUNCTUATION, " " * len(SEARCH_PUNCTUATION))
    return [w for w in query.translate(blanks).lower().split(" ") if w]


def has_all_words(text: Column, words: Sequence[str]) -> Column:
    """Every word occurs in ``text``, in any letter case. The words are constants of the plan."""
    if not words:
        return F.lit(False)
    lowered = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a & b, [F.contains(lowered, F.lit(w)) for w in words]), F.lit(False))
