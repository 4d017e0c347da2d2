"""Scan of nested grant records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldledger.schemas import GRANT


def parse_grants(lines: DataFrame, column: str = "line") -> DataFrame:
    """JSON grant records -> flat rows: trimmed text, ten-character dates, the ids of all contact persons."""
    g = "_g."
    trimmed = lambda name: F.coalesce(F.trim(F.col(g + name)), F.lit(""))
    contact = F.filter(g + "principal_investigators", lambda p: p["is_contact_pi"])
    return (lines.withColumn("_g", F.from_json(column, GRANT)).where(F.col("_g").isNotNull())
            .select(
                *[c for c in lines.columns if c != column],
                trimmed("core_project_num").alias("project_num"),
                F.substring(trimmed("project_start_date"), 1, 10).alias("start"),
                F.substring(trimmed("project_end_date"), 1, 10).alias("end"),
                trimmed("contact_pi_name").alias("contact_pi_name"),
                trimmed("project_title").alias("project_title"),
                F.coalesce(g + "organization.org_name", F.lit("")).alias("org_name"),
                F.coalesce(g + "project_detail_url", F.lit("")).alias("project_detail_url"),
                F.coalesce(F.transform(contact, lambda p: F.coalesce(p["profile_id"].cast("string"), F.lit(""))),
                           F.array().cast("array<string>")).alias("pi_profile_ids")))
