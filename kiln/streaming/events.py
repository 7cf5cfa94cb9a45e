"""Structured Streaming over event tables, an extension: windows with watermark, sessions, duplicates, and the same rules for finite tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    # A watermark needs a timestamp with a zone; times without one are read in the session's zone.
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): counts and sums a window; a stream drops what is later than late."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, n): runs of a user's events with no gap of more than gap."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def unique(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First event of each key; a stream forgets keys after late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return its rows."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
