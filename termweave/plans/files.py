"""Names and removal of files by Spark's own file systems, whatever store a path lies in."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    folder, system = _path(spark, path)
    system.delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder, system = _path(spark, path)
    return bool(system.exists(folder))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern with `*`; none if there are none."""
    folder, system = _path(spark, pattern)
    return [s.getPath().toString() for s in system.globStatus(folder) or []]
