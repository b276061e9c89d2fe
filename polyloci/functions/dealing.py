"""Tasks whose memory does not grow with the input."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame

#: Rows that a task holds in a hash table or sorts.
TASK_ROWS = 500_000


def dealt(df: DataFrame, by: list[str], counted: DataFrame | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """(action) df dealt by hash of `by`, about `task_rows` rows to a task, so that groupings by `by` and more need no other shuffle and
    no task's table grows with the input. Rows are counted on `counted`, if that is cheaper; few are left where they are."""
    tasks = ceil((df if counted is None else counted).count() / task_rows)
    return df.repartition(tasks, *by) if tasks > df.sparkSession.sparkContext.defaultParallelism else df
