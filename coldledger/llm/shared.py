"""What the text operators share: tables, lineage cuts, ASCII-only word splitting."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import coldledger
from coldledger.session import work_dir

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder named by ``spark.checkpoint.dir``.

    The setting of the session is used; a local session without one gets a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def whole(text: Column) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers, which may run in any folder; once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(coldledger.__file__).parent
        archive = Path(tempfile.mkdtemp()) / "coldledger_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


def map_batches(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)
