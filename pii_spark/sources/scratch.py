"""The shared folder for checkpoints and intermediate tables, and files by their path."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local session without the setting
    gets a temporary folder, any other session is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    shared = tempfile.mkdtemp(prefix="pii-spark-")
    spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as that system knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder; none if there is no such folder."""
    fs, p = _files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)
