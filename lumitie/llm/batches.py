"""Size of the batches that tasks hand to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of a batch of whole texts, at most.
ROWS = 1_000
KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let the session hand over at most ROWS rows at a time, so that a worker holds few texts at once."""
    now = int(spark.conf.get(KEY, "10000"))
    if not 0 < now <= ROWS:
        spark.conf.set(KEY, str(ROWS))
