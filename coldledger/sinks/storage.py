"""The few steps on shared storage that must happen at once or not at all."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Give a file or directory its final name; False, and nothing happens, if the name exists."""
    hadoop = spark._jvm.org.apache.hadoop
    files = hadoop.fs.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(files.makeQualified(_path(spark, source)), files.makeQualified(_path(spark, target)), no_overwrite)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def names_below(spark: SparkSession, root: str, start: str) -> list[str]:
    """Sorted names below ``root`` that begin with ``start``; none if there is no such folder."""
    folder = _path(spark, root)
    storage = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not storage.exists(folder):
        return []
    return sorted(n for n in (s.getPath().getName() for s in storage.listStatus(folder)) if n.startswith(start))


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Did the job that wrote this folder end?"""
    storage = _path(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return storage.exists(_path(spark, f"{folder}/_SUCCESS"))


def remove(spark: SparkSession, folder: str) -> None:
    _path(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(_path(spark, folder), True)
