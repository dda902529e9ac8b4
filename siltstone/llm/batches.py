"""How many rows Spark sends to Python at once, and what a worker keeps between tasks."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 2000
_NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """Send at most `rows` rows at once, so that a worker holds a few megabytes of texts; bytes are bounded
    by spark.sql.execution.arrow.maxBytesPerBatch. A smaller setting of the session stays."""
    held = int(spark.conf.get(_NAME))
    if held <= 0 or held > rows:
        spark.conf.set(_NAME, str(rows))


def trim() -> None:
    """Give freed memory back to the system: workers wait for the next task, and stages beside them need it."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:  # other C libraries have no such call
        free(0)
