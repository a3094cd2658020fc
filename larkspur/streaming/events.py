"""Extensions beyond the inventory: windowed counts of an event stream, and ingestion of scored rows that may repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling windows, or sliding ones; on a stream, rows later than `late` are left out."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    made = held.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    held = events.withWatermark("ts", late) if events.isStreaming else events
    made = held.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ingest(scored: DataFrame, path: str, checkpoint: str, late: str = "1 hour"):
    """A stream of scored rows to Parquet, each row_uid once within the watermark."""
    once = scored.withWatermark("ts", late).dropDuplicatesWithinWatermark(["row_uid"])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
