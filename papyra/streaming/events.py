"""Windowed counts of an event stream, the same in batch and in streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def hourly_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """``hour, event_type, n, total`` of events ``ts, event_type, value``. ``late``: how long a stream waits for late events; null times are dropped."""
    rows = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def stream_of(spark: SparkSession, folder: str, schema, **options) -> DataFrame:
    """A stream of the Parquet files of a folder, a file at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).options(**options).parquet(folder)
