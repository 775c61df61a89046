"""An hourly panel from the event stream: the same frame function for a batch and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "2 hours"


def read_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def hourly_totals(events: DataFrame) -> DataFrame:
    """(hour, event_type, n, total) per hour of ts; of a stream, hours close when events are LATE past them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", LATE) if events.isStreaming else timed
    rows = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n", "total")
