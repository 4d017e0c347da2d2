"""Grant search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.functions.text import has_all_words, is_number, search_words


def dedup_first(df: DataFrame, key: str, *seq: str) -> DataFrame:
    """First row per key in ``seq`` order. An aggregate, so hot keys shrink before the shuffle."""
    return (df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*seq)).alias("_row"))
            .select("_row.*"))


def cascade_search(grants: DataFrame, query: str) -> DataFrame:
    """Person, else project number, else organisation; and always full text; first hit per project.

    ``grants`` has seq, project_num, contact_pi_name, project_title, org_name, text. All tests
    run in one scan, and results are whole. A query without words finds nothing.
    """
    words = search_words(query)
    if not words:
        grants = grants.where(F.lit(False))
    number = F.lit(" ".join(words))
    worded = ~is_number(number)
    tested = grants.select(
        "seq", "project_num", "contact_pi_name", "project_title", "org_name",
        (worded & has_all_words(F.col("contact_pi_name"), words)).alias("_pi"),
        (F.lower("project_num") == number).alias("_project"),
        (worded & has_all_words(F.col("org_name"), words)).alias("_org"),
        has_all_words(F.concat_ws(" ", "project_title", "text"), words).alias("_text"))
    hits = tested.where(F.col("_pi") | F.col("_project") | F.col("_org") | F.col("_text"))
    # One extra pass tells whether the person and project branches found anything.
    found_any = hits.agg(F.struct(F.bool_or("_pi").alias("pi"), F.bool_or("_project").alias("project")).alias("f")).scalar()
    no_pi = ~F.coalesce(found_any["pi"], F.lit(False))
    no_project = ~F.coalesce(found_any["project"], F.lit(False))
    branches = (("pi", F.col("_pi")),
                ("project", F.col("_project") & no_pi),
                ("org", F.col("_org") & no_pi & no_project),
                ("text", F.col("_text")))
    columns = ["seq", "project_num", "contact_pi_name", "project_title", "org_name"]
    taken = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(i).alias("rank"), F.lit(n).alias("found_by")))
        for i, (n, test) in enumerate(branches)]))
    found = hits.select(*columns, F.array_min(taken).alias("_b")).where("_b is not null")
    found = found.select(*columns, "_b.rank", "_b.found_by")
    return dedup_first(found, "project_num", "rank", "seq").drop("rank")
