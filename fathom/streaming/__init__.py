"""Event counts and gaps as streams: twins of batch aggregations, run to completion with availableNow.

A stream keeps its offsets and its state in its own folder under checkpoint: a later call takes in new files only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_counts(spark: SparkSession, folder: str, checkpoint: str, out: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of the Parquet files in folder by window and type, written to out as windows close; returns what out holds."""
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = counts.select(F.col("window.start").alias("start"), "event_type", "n", "total")
    query = flat.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/event-counts").option("path", out).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def sessions(spark: SparkSession, folder: str, checkpoint: str, out: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events with no gap of that length, as (user_id, start, end, n), written to out as they close."""
    schema = spark.read.parquet(folder).schema
    events = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    runs = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    flat = runs.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    query = flat.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/sessions").option("path", out).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
