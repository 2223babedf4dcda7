"""Event-time operators over the events stream, and incremental upserts of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_time(events: DataFrame) -> DataFrame:
    """Watermarks need a timestamp with zone; the stored column has none and is read as UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and window; events later than the watermark are closed out on a stream."""
    e = event_time(events).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("begins"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    e = event_time(events).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("begins"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """One row per user and session: events less than ``gap`` apart."""
    e = event_time(events).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "n")


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once: within the watermark on a stream, altogether in a batch."""
    e = event_time(events)
    if not e.isStreaming:
        return e.dropDuplicates(["event_id"])
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def read_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(folder)


def upsert_batches(stream: DataFrame, target: str, key: str, order: str, checkpoint: str):
    """Idempotent upsert: each micro-batch goes to its own folder, so a repeated batch replaces itself.

    Readers take the latest row per key over all batches (``latest_state``).
    """

    def put(batch: DataFrame, epoch: int) -> None:
        best = batch.groupBy(key).agg(F.max(F.struct(order, *[c for c in batch.columns if c not in (key, order)])).alias("r")).select(key, "r.*")
        best.write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, target: str, key: str, order: str) -> DataFrame:
    rows = spark.read.parquet(target)
    return rows.groupBy(key).agg(F.max(F.struct(order, "batch", *[c for c in rows.columns if c not in (key, order, "batch")])).alias("r")).select(key, "r.*")
