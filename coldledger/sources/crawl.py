"""Scans of crawl tables, reports and live listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coldledger.functions.paths import basename, parent
from coldledger.schemas import CRAWL, HOTSPOTS, MANIFEST
from coldledger.session import work_dir
from coldledger.sources.common import require_columns, require_columns_in

BAD = "_bad"
_CSV = {"header": "true", "quote": '"', "escape": '"'}


def read_crawl_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", mode_base: int = 10) -> DataFrame:
    """One row per crawled entry. Lines that do not fit the schema keep their text in ``_bad``.

    Columns are matched by name: a line belongs to the last header above it in its file, so crawls may have their
    columns in any order and more of them, and files that were put together have several headers. Lines above any
    header, and files without one, are set aside whole. ``mode_base`` is the number base of ``st_mode``. Every line is
    parsed whole: a plain CSV scan would only check the columns that a query happens to use. A line with an open
    quote (a name with a line break) does not fit either, nor does the line that closes it.

    Two scans: the first keeps the headers and where they stand in a table, the second parses each line once.
    """
    raw = spark.read.text(path).select(
        F.decode(F.col("value").cast("binary"), encoding).alias("line"), F.col("_metadata.file_path").alias("file"),
        # Both scans cut the files alike, so within a piece of a file the numbers grow in the same way.
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"))
    # A line of column names; there are as many different ones as layouts, not as files.
    cells = F.split(F.replace("line", F.lit('"'), F.lit("")), ",")
    is_head = F.array_contains(cells, "filename") & F.array_contains(cells, "UID")
    kept = work_dir(spark, "crawl-headers")
    raw.where(is_head).write.parquet(kept)
    found = spark.read.schema(raw.schema).parquet(kept)
    heads = sorted(r["line"] for r in found.select("line").distinct().collect())
    if not heads:
        raise ValueError(f"no header below {path}")
    by_file = found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("heads"))
    above = F.filter("heads", lambda h: h["at"] < F.col("at"))
    lines = raw.where(~is_head).join(by_file, "file", "left").select(
        "line", F.get(above, F.size(above) - 1)["line"].alias("head"))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    types = {f.name: f.dataType.simpleString() for f in CRAWL.fields} | {"st_mode": "string"}
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "quote": '"', "escape": '"'}
    parsed: dict[str, list[Column]] = {}
    for k, head in enumerate(heads):
        names = head.replace('"', "").split(",")
        require_columns_in(names, [f.name for f in CRAWL.fields[:7]])
        schema = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in [*names, BAD])
        mine = (F.col("head") == head) & (quotes % 2 == 0)
        lines = lines.withColumn(f"_as{k}", F.from_csv(F.when(mine, F.col("line")), schema, options))
        for n in [*names, BAD]:
            parsed.setdefault(n, []).append(F.col(f"_as{k}")[n])
    values = {n: F.coalesce(*columns) for n, columns in parsed.items()}
    if "st_mode" in values:
        values["st_mode"] = F.conv(values["st_mode"], mode_base, 10).cast("int")
    values[BAD] = F.when(F.col("head").isNull() | (quotes % 2 == 1), F.col("line")).otherwise(values[BAD])
    return lines.select(*[v.alias(n) for n, v in values.items()])


def good_rows(crawl: DataFrame) -> DataFrame:
    return crawl.where(F.col(BAD).isNull()).drop(BAD)


def bad_lines(crawl: DataFrame) -> DataFrame:
    """Quarantined lines with what could be read of their path."""
    return crawl.where(F.col(BAD).isNotNull()).select("filename", F.col(BAD).alias("line"))


def read_hotspots(spark: SparkSession, path: str) -> DataFrame:
    """Hotspot report. Fails on a missing header or ``Folder`` column; header only gives no rows."""
    header = spark.read.options(**_CSV).csv(path)
    require_columns(header, ["Folder"])
    types = {f.name: f.dataType for f in HOTSPOTS.fields}
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType()), True) for c in header.columns])
    return spark.read.schema(schema).options(**_CSV).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """File manifests under ``path``; the folder is their first column, directories add none."""
    schema = T.StructType([T.StructField("folder", T.StringType(), True), *MANIFEST.fields])
    return spark.read.schema(schema).options(recursiveFileLookup="true", **_CSV).csv(path)


def read_report_listing(spark: SparkSession, path: str) -> DataFrame:
    """Reports below a path with the rows of each and when it was written last, newest first."""
    rows = spark.read.schema("line string").option("recursiveFileLookup", "true").text(path).select(
        "line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"))
    # Every part file starts with the header.
    report = basename(parent(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))))
    return rows.groupBy(report.alias("report")).agg(
        (F.count(F.lit(1)) - F.countDistinct("file")).alias("rows"), F.max("mtime").alias("mtime")).orderBy(F.desc("mtime"), "report")
