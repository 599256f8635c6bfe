"""Sends this package to the executors of a session whose workers could not import it otherwise, and bounds what a session sends to Python at once."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent

#: Bytes of an Arrow batch to Python, until which rows are added. Of a batch some copies are held on both sides, in each task: of Spark's 64 MB some 400 MB.
#: Less than `fts_blocks.BYTES`, so that a batch of texts is one block.
BATCH = 7 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that sets no bound itself. Tasks that join blocks get rows of some MB, so only bytes bound what they hold. It
    stays set, as plans run later than they are made."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH)


def ship(spark: SparkSession) -> SparkSession:
    """Add the package as a zip through Spark's own file server, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkrag_sent", False):
        return spark
    name = os.path.join(tempfile.mkdtemp(prefix="sparkrag-code-"), "sparkrag.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_HERE.rglob("*.py")):
            z.write(p, Path("sparkrag") / p.relative_to(_HERE))
    sc.addPyFile(name)
    sc._sparkrag_sent = True
    return spark
