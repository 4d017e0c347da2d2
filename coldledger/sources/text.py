"""Scans of line formats: checksum manifests, transfer logs, key=value rows, delimited tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldledger.schemas import TRANSFER_LINE

_MD5_LINE = r"^([^\t]*)\t([0-9a-f]{32})  (.*)$"


def read_md5_manifest(spark: SparkSession, path: str) -> DataFrame:
    """'<folder> TAB <md5>  <name>' lines; others are skipped."""
    part = lambda i, name: F.regexp_extract("value", _MD5_LINE, i).alias(name)
    return (spark.read.text(path).where(F.col("value").rlike(_MD5_LINE))
            .select(part(1, "folder"), part(3, "name"), part(2, "md5")))


def parse_transfer_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """Parsed JSON lines with ``kind`` 'stats' or 'operations'; other and broken lines are skipped."""
    source = F.col("_p.source")
    kind = (F.when(source.contains("accounting/stats"), F.lit("stats"))
            .when(source.contains("operations/operations"), F.lit("operations")))
    return (lines.where(F.col(column).startswith("{"))
            .withColumn("_p", F.from_json(F.rtrim(column), TRANSFER_LINE, {"mode": "PERMISSIVE"}))
            .withColumn("kind", kind).where(F.col("kind").isNotNull())
            .select(*[c for c in lines.columns if c != column], "kind", "_p.source", "_p.msg", "_p.stats"))


def read_transfer_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_transfer_log(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_key_values(line: Column) -> Column:
    """'a=1 b=x=y' -> map; the first '=' of a token separates, later ones belong to the value.

    A key that comes again has its last value.
    """
    tokens = F.filter(F.split(F.trim(line), r"\s+"), lambda t: F.contains(t, F.lit("=")))
    keys = F.transform(tokens, lambda t: F.substring_index(t, "=", 1))
    values = F.transform(tokens, lambda t: F.substring(t, F.instr(t, "=") + 1, F.length(t)))
    # Bound to a name, the lists are made once a line, not once for each of its tokens.
    line_keys_values = F.array(F.struct(F.reverse(keys).alias("keys"), F.reverse(values).alias("values")))
    maps = F.transform(line_keys_values, lambda b: F.transform(
        F.array(F.reverse(F.array_distinct(b["keys"]))), lambda last: F.map_from_arrays(
            last, F.transform(last, lambda k: F.element_at(b["values"], F.array_position(b["keys"], k).cast("int"))))))
    return F.when(tokens.isNotNull(), maps[0][0])


def parse_delimited(line: Column, schema: str, sep: str = "|", quote: str = '"') -> Column:
    """One delimited row -> struct; quotes are honoured and blanks after a separator dropped."""
    return F.from_csv(line, schema, {"sep": sep, "quote": quote, "ignoreLeadingWhiteSpace": "true"})
