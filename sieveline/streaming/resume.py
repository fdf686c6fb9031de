"""Streaming ingest: each key once, in Parquet, restartable from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sieveline.functions.text import uid


def read_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """New JSON-line files of a folder, with the key derived where it is missing."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.withColumn("uid", F.coalesce("uid", uid("source", "source_id")))


def ingest(rows: DataFrame, out: str, checkpoint: str, event_time: str | None = None, retention: str = "30 days") -> StreamingQuery:
    """Appends rows whose uid is new. Without event_time all keys are remembered; with it, those within the retention."""
    if event_time:
        once = rows.withWatermark(event_time, retention).dropDuplicatesWithinWatermark(["uid"])
    else:
        once = rows.dropDuplicates(["uid"])
    return once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def yield_by_window(rows: DataFrame, event_time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows by source and time window; rows later than the watermark are left out."""
    return rows.withWatermark(event_time, late).groupBy(F.window(event_time, window), "source").agg(F.count(F.lit(1)).alias("total"))
