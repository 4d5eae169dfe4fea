"""Queries that run a table through a stateful stream; the SQL is that of the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import table
from ..streaming import ordered as S
from . import ordering  # noqa: F401  (its SQL)
from .reading import place
from .registry import SQL, query


def _drained(stream: DataFrame) -> DataFrame:
    """What a stream sends out until its source has no more rows, as a table in the shared folder."""
    spark, folder = stream.sparkSession, place(stream.sparkSession, "stream")
    S.state_store(spark)
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _events(spark, d):
    # A stream reads a folder or a pattern; the table may be a single file.
    source = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet")
    ts = F.col("ts").cast("timestamp")
    # Watermarks count milliseconds; what lies between two of them is a tie, settled by the next column.
    return source.withColumns({"at": F.date_trunc("millisecond", ts), "micros": F.unix_micros(ts)})


@query("st_carried_forward", SQL["w09_locf"])
def carried_forward(spark, d):
    """Users' events in the order of their time as a stream: the last type whose value was above 50."""
    e = _events(spark, d).select("event_id", "user_id", "at", "micros", F.when(F.col("value") > 50, F.col("event_type")).alias("tag"))
    return _drained(S.carried_forward(e, "user_id", "at", ["micros", "event_id"], "tag", "origin", "Unknown", "0 seconds").select("event_id", "origin"))


@query("st_backtrack_chunks", SQL["w07_backtrack_chunks"])
def backtrack_chunks(spark, d):
    i = F.col("event_id") % 3
    e = _events(spark, d).select("event_id", "user_id", "at", "micros", "value", F.when(i == 0, "+").when(i == 1, "-").otherwise(".").alias("dir"))
    return _drained(S.backtrack_chunks(e, "user_id", "at", ["micros", "event_id"], "value", "dir", 10.0, "0 seconds").select("event_id", "chunk"))
