"""Folders of a store that any Hadoop file system may hold, seen from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def complete_folders(spark: SparkSession, path: str, marker: str = "_SUCCESS") -> list[str]:
    """Names of the folders under ``path`` whose writing was committed."""
    fs, at = _place(spark, path)
    if not fs.exists(at):
        return []
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory() and fs.exists(Path(s.getPath(), marker)))


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, at = _place(spark, path)
    fs.delete(at, True)
