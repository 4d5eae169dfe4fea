"""What operators share: tables that end a round, and rows dealt to tasks by their number."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df written as a table to the checkpoint folder and read from there, so a round doesn't carry the plans of those before it, is
    computed once, and a lost executor costs no more than a round. Where no folder is set (single machine) it is kept in memory and on disk."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task gets at most, unless one key has more.
TASK_ROWS = 500_000


def dealt(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """df dealt by its keys to as many tasks as its rows need (`rows`, if they were counted before). Tasks dealt by compressed bytes grow without bound where
    rows are alike."""
    rows = df.count() if rows is None else rows
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)
