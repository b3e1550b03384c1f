"""Make the package importable in the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
#: Rows and bytes that one Arrow batch may hold on its way to Python, so that long texts and arrays of many rows don't pile up.
BATCH_ROWS = 1_000
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each Spark context, and bound the session's batches."""
    small_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_aerolytics_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-ship-"), "aerolytics_src.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(_ROOT.rglob("*.py")):
            out.write(path, path.relative_to(_ROOT.parent))
    context.addPyFile(str(archive))
    context._aerolytics_shipped = True
