"""The folder that driver and executors share, for tables between jobs."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN = "_LATEWEAVE_OWN_DIR"
_begun: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a single-machine session without one gets a temporary folder, which goes when the process ends."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or os.environ.get(_OWN, "")
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lateweave-")
        os.environ[_OWN] = found
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below this application's folder in the shared one; remove_scratch() removes them all, as does the end of the process."""
    folder = f"{shared_dir(spark)}/lateweave/{spark.sparkContext.applicationId}"
    if folder not in _begun:
        _begun.add(folder)
        atexit.register(_at_exit, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any of Spark's file systems, and all below it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has written so far; frames that read it can't be used any more."""
    remove(spark, f"{shared_dir(spark)}/lateweave/{spark.sparkContext.applicationId}")


def _at_exit(folder: str) -> None:
    # Without a running session there is nothing left to delete with; the folder stays.
    with contextlib.suppress(Exception):
        spark = SparkSession.getActiveSession()
        if spark is not None:
            remove(spark, folder)
