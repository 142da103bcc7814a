"""Folders on whatever file system a path names, through Hadoop's API as Spark's writers use it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly in a folder; nothing where there is none."""
    fs, target = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, target = _at(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)
