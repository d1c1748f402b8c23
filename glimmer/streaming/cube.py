"""Event counts as streams: tumbling and sliding windows, sessions, first events per layer, deduplication.

Each function takes a streaming or a batch DataFrame with ts, user_id, event_type, value, so that batch results are
the reference for the stream's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "1 hour"


def events(spark: SparkSession, path: str, schema: str = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", files_per_batch: int = 1) -> DataFrame:
    """A stream of event files, ts as a timestamp in the session's time zone."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, size: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """(start, event_type, n, value) by tumbling windows."""
    by = rows.withWatermark("ts", lateness).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding(rows: DataFrame, size: str = "6 hours", step: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    by = rows.withWatermark("ts", lateness).groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(rows: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a gap."""
    by = rows.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(rows: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each event_id once within the watermark."""
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"]) if rows.isStreaming else rows.dropDuplicates(["event_id"])


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that ends when the input at hand is used up; exactly once by its checkpoint."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
