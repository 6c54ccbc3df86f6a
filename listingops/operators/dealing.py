"""How rows are dealt to tasks where the adaptive plan would give one task too many."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys in as many partitions as spark.sql.shuffle.partitions says, and no fewer.

    Adaptive execution merges partitions by their compressed bytes, down to a task a core. Rows of few distinct values
    take a hundred times those bytes when they are sorted, so that a task's memory would follow the table.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
