"""How many tasks a table is dealt to, so that a task's share does not grow with the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task: sorted or hashed, they are some tens of megabytes.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Partitions for so many rows; None for few rows, which are left to Spark."""
    if rows <= 4 * TASK_ROWS:
        return None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(rows: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """The rows in so many partitions by the columns; as they are without a number."""
    return rows if tasks is None else rows.repartition(tasks, *by)
