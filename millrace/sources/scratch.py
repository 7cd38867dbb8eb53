"""Folders for files that tasks write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path that the driver and all executors see: under ``spark.checkpoint.dir``, or local where the master is."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/millrace-{name}-{uuid.uuid4().hex}"
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all hosts see")
    return tempfile.mkdtemp(prefix=f"millrace-{name}-")
