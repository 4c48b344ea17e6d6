"""Folders that the driver and all executors see.

They lie below the folder named by ``spark.checkpoint.dir``. Where none is set, a local
session, whose executors are threads of the driver, uses the machine's temporary folder; any
other session gets an error, as its executors would each write to a disk of their own. All
folders of a session are deleted by ``remove``, ``remove_all``, or when its JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from lumenlog.errors import QueryError


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def top(spark: SparkSession) -> str:
    """The session's own folder below the shared one, which is deleted when the session's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise QueryError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    name = f"{base.rstrip('/')}/lumenlog-{spark.sparkContext.applicationId}"
    path, fs = _path(spark, name)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return name


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's name below the session's shared one."""
    return f"{top(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, name: str) -> None:
    """Delete one folder whose readers are done."""
    path, fs = _path(spark, name)
    fs.delete(path, True)


def remove_all(spark: SparkSession) -> None:
    """Delete all folders of the session; results that were not read yet are lost."""
    remove(spark, top(spark))
