"""Structured Streaming: an index that follows a directory of notes, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from notemill.operators.services import Embedder, embedded


def follow(stream: DataFrame, path: str, checkpoint: str, embedder: Embedder | None = None) -> StreamingQuery:
    """Appends the vectors of every new batch of notes to a Parquet log, one folder a batch.

    A batch that is run again overwrites its own folder, so each note is written exactly
    once; readers take each document's row of the latest batch (see latest).
    """

    def write(batch: DataFrame, number: int) -> None:
        embedded(batch, embedder).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Each document's vector of its latest batch."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("document_id").agg(F.max_by(F.struct("vector", "metadata", "ordinal"), "batch").alias("r"))
    return newest.select("document_id", "r.vector", "r.metadata", "r.ordinal")


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """A stream needs time stamps with a zone for its watermark; a table stays as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, events, total) in tumbling windows; on a stream, rows later than late are dropped."""
    rows = _watermarked(events, late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, events): bursts of a user's events without a longer gap."""
    rows = _watermarked(events, late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
