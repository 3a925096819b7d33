"""Folders on whatever storage the lake lies on, through the file systems that Spark itself uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the files and folders right below a folder; none where there is no such folder."""
    files, location = _at(spark, path)
    if not files.exists(location):
        return []
    return sorted(entry.getPath().getName() for entry in files.listStatus(location))


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder with all below it."""
    files, location = _at(spark, path)
    files.delete(location, True)


def numbered(spark: SparkSession, path: str, key: str) -> list[int]:
    """Sorted numbers ``n`` of the folders ``key=n`` below ``path`` that hold a finished table."""
    found = [int(name.split("=")[1]) for name in names(spark, path) if name.startswith(f"{key}=")]
    return sorted(n for n in found if finished(spark, f"{path}/{key}={n}"))


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has ended."""
    return "_SUCCESS" in names(spark, path)


def newest(spark: SparkSession, path: str, key: str) -> int | None:
    """Largest number of ``numbered``, without a look into the folders below it."""
    for name in sorted(names(spark, path), key=lambda n: int(n.split("=")[1]) if n.startswith(f"{key}=") else -1, reverse=True):
        if name.startswith(f"{key}=") and finished(spark, f"{path}/{name}"):
            return int(name.split("=")[1])
    return None


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
