"""Streams: transcripts and signal logs as file sources; windows, idle sessions, running counters, one-shot ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SIGNAL = "memory_id string, vote double, at timestamp"


def source(spark: SparkSession, path: str, schema: str, fmt: str = "json", files: int = 1000) -> DataFrame:
    """Files of a directory as they arrive; the checkpoint is the ledger of those that were read."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def idle_sessions(events: DataFrame, key: str = "session_id", at: str = "at", gap: str = "5 minutes", late: str = "5 minutes") -> DataFrame:
    """(key, first_at, last_at, n) of sessions that were idle for a gap; the same for a batch and, with a watermark, for a stream."""
    if events.isStreaming:
        events = events.withWatermark(at, late)
    s = events.groupBy(key, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("closed_at"), "n")


def tumbling(events: DataFrame, at: str = "at", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        events = events.withWatermark(at, late)
    return events.groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def counters(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Running (memory_id, recall_count, positive, negative); raw counts are the state, decay is applied when they are read."""
    if log.isStreaming:
        log = log.withWatermark("at", late)
    return log.groupBy("memory_id").agg(F.count(F.lit(1)).alias("recall_count"), F.count_if(F.col("vote") >= 0.75).alias("positive"), F.count_if(F.col("vote") < 0.25).alias("negative"))


def without_repeats(events: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once, however often and late it is delivered within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop: written exactly once by batch number."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def merge_into(df: DataFrame, apply, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Every micro-batch is given to apply(batch, number), which merges it into a state by key; a repeated number must give the same state."""
    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def due(last_run: float | None, last_ingest: float | None, now: float, every: float | None = None, quiet: float | None = None) -> bool:
    """Whether a scheduled run is due: every so many seconds, or once it was quiet for so long after an ingest."""
    if every is not None and (last_run is None or now - last_run >= every):
        return True
    return quiet is not None and last_ingest is not None and (last_run or 0) < last_ingest <= now - quiet
