"""Catalogue snapshots and exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldledger.operators.catalogue import catalogue_export, catalogue_upsert
from coldledger.sinks.storage import rename_new


class VersionTaken(AnalysisException):
    """Another writer was first with this version."""


def write_snapshot(catalogue: DataFrame, root: str, version: int) -> None:
    """Write a whole catalogue as a new version; readers keep the one before until it is complete.

    The rows are written aside and get their name in one step, which fails if the name exists: of two writers that
    chose the same version, the second raises ``VersionTaken``, and one that dies midway leaves no version.
    """
    aside = f"{root.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    catalogue.write.parquet(aside)
    if not rename_new(catalogue.sparkSession, aside, f"{root.rstrip('/')}/version={version:010d}"):
        raise VersionTaken(message=f"version {version} exists below {root}")


def newest_version(spark: SparkSession, root: str) -> int:
    """The newest complete version, by the names of the directories below ``root``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    storage = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in storage.listStatus(folder)]
    done = [int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=")
            and storage.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not done:
        raise FileNotFoundError(f"no catalogue version below {root}")
    return max(done)


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Newest version; no other one is opened."""
    return spark.read.parquet(f"{root.rstrip('/')}/version={newest_version(spark, root):010d}")


def upsert_snapshot(spark: SparkSession, root: str, entries: DataFrame, attempts: int = 10) -> int:
    """Merge ``entries`` into the newest version and write the result as the next one; returns its number.

    If another writer was first, its version is read and merged anew, so neither one's entries are lost.
    """
    for left in range(attempts - 1, -1, -1):
        current = newest_version(spark, root)
        old = spark.read.parquet(f"{root.rstrip('/')}/version={current:010d}")
        try:
            write_snapshot(catalogue_upsert(old, entries), root, current + 1)
            return current + 1
        except VersionTaken:
            if not left:
                raise
    raise ValueError("attempts must be positive")


def write_catalogue_json(catalogue: DataFrame, path: str, key: str = "folder_key") -> None:
    """JSON maps folder -> record, one map per line, for tools that read that form."""
    record = F.struct(*[c for c in catalogue.columns if c != key])
    catalogue.select(F.to_json(F.create_map(F.col(key), record)).alias("value")).write.mode("overwrite").text(path)


def write_catalogue_export(catalogue: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV of the wanted columns, newest entry first across the numbered part files."""
    (catalogue_export(catalogue, columns).write.mode("overwrite")
     .options(header="true", quote='"', escape='"').csv(path))
