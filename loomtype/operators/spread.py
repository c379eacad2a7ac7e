"""Dealing out of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows (of a few small columns) that may be sent to all tasks.
SENT_ROWS = 500_000


def tasks(rows: DataFrame) -> int:
    """Tasks for work that is long for its bytes: Spark would put few bytes into few tasks."""
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores, where their files are fewer: one file's one row group would be one task's work."""
    return rows if len(rows.inputFiles()) >= rows.sparkSession.sparkContext.defaultParallelism else rows.repartition(tasks(rows))


def sent(rows: DataFrame) -> DataFrame:
    """Rows for a join: sent to all tasks where they are few, else as they are. They are counted, so they should be cheap to have."""
    return F.broadcast(rows) if rows.limit(SENT_ROWS + 1).count() <= SENT_ROWS else rows
