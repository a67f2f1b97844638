"""Windows over events: the streaming operators on a batch, and one query that drains a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from engrava.plans.registry import query
from engrava.session import load, shared_dir
from engrava.sources.tables import epoch
from engrava.streaming import events


@query("SELECT CAST(epoch_us(ts) // 3600000000 * 3600 AS BIGINT) AS start, count(*) AS n FROM events GROUP BY 1")
def tumbling_counts(spark, sf):
    w = events.tumbling(load(spark, sf, "events").select(F.col("ts").alias("at")))
    return w.select(F.unix_seconds("start").alias("start"), "n")


@query("WITH g AS (SELECT user_id, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events), h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(u) / 1e6 AS first_at, max(u) / 1e6 + 3600 AS closed_at, count(*) AS n FROM h GROUP BY user_id, k")
def idle_sessions(spark, sf, gap="1 hour"):
    s = events.idle_sessions(load(spark, sf, "events").select("user_id", F.col("ts").alias("at")), "user_id", "at", gap)
    return s.select("user_id", epoch("first_at").alias("first_at"), epoch("closed_at").alias("closed_at"), "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_available_now(spark, sf):
    """The events table read as a stream to its end, appended exactly once, then counted."""
    import uuid

    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    events.drain(src.select("event_id", "event_type"), f"{base}/out", f"{base}/ledger").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
