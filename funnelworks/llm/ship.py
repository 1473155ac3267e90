"""Sends this package to the executors, for the functions that run in Python there."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

import funnelworks


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@lru_cache(maxsize=4)
def _ship(spark: SparkSession, application: str) -> None:
    root = Path(funnelworks.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="funnelworks-")) / "funnelworks_tasks.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(archive))


def ship(spark: SparkSession) -> None:
    """Once per application; the driver serves the archive, executors fetch it when they first need it.

    Rows are whole texts, so Arrow batches get 1,000 of them unless the session names a number of its own.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":  # Spark's default
        spark.conf.set(BATCH_ROWS, "1000")
    _ship(spark, spark.sparkContext.applicationId)
