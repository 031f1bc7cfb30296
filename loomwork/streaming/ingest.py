"""Incremental ingest: new manifest rows only, resumable after any stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, event_time: str | None = None, delay: str = "7 days") -> StreamingQuery:
    """Appends JSON lines of files not seen before to a Parquet table, one row a key.

    With an event time the state of seen keys is dropped `delay` after it, so it stays
    bounded; a key that comes again later than that is not recognised.
    """
    rows = spark.readStream.schema(schema).json(source)
    once = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]) if event_time else rows.dropDuplicates([key])
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of todo whose key has no result yet."""
    return todo.join(done.select(key), key, "left_anti")
