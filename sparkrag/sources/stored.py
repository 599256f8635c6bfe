"""The cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where a session has none, one is set on a local master (tests); elsewhere that is an error, as executors
    would not see a folder of the driver's machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparkrag-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")
