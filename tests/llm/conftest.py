from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG_TEXT = " ".join(f"word{i % 977} and more" for i in range(40_000))

#: Null and empty texts, ties, repeated rows, a null id, a very long text.
ODD_ROWS = [
    (1, None, None, None, None), (2, "", "en", None, 0), (3, "   \t\n", None, "s", 5), (4, "one two three four", "en", "s", 1),
    (5, "one two three four", None, None, None), (5, "one two three four", None, None, None),
    (None, "one two three four", "en", "s", 3), (None, None, None, None, None), (6, LONG_TEXT, "en", "s", None),
    (7, "One  two three\tfour", "en", "s", 1), (8, "ünïcode 漢字 😀 text", "de", "s", 1), (9, "x", "en", "s", 1)]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD_ROWS, SCHEMA)
    return docs.withColumns({c: F.lit("clash") for c in (
        "id", "h", "fp", "body", "block", "key", "words", "start", "item", "root", "cell", "rank", "kept", "label",
        "component_id", "toxic", "shard", "rid", "pid")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
