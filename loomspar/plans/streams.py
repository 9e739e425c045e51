"""Streaming queries: each runs the stream over all events that are there, then gives the table it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomspar.session import ensure_importable, shared_dir, table
from loomspar.streaming import sinks


def _events(spark, d):
    ensure_importable(spark)
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque*").withColumn("ts", F.col("ts").cast("timestamp"))


def _done(spark, stream, mode):
    where = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    sinks.run_to_end(stream, mode, where)
    return spark.read.parquet(f"{where}/rows")


def stream_windows(spark, d):
    """Counts per hour and type."""
    s = _done(spark, sinks.windowed_counts(_events(spark, d), "ts", "1 hour", "1 day", ["event_type"]), "complete")
    return s.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def stream_first_seen(spark, d):
    """Users and types that occur, each once."""
    return _done(spark, sinks.first_seen(_events(spark, d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "3650 days"), "append").select("user_id", "event_type")


def stream_sink(spark, d):
    """Rows of a filtered stream as they came, counted from the sink."""
    return _done(spark, _events(spark, d).where("value > 100"), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_batches(spark, d):
    """Batches of a budget per user: how many, and the fullest."""
    e = _events(spark, d).where("value is not null").select("user_id", "event_id", F.ceil("value").cast("bigint").alias("size"))
    b = _done(spark, sinks.packed_batches(e, "user_id", "size", 500, "event_id"), "append").groupBy("user_id", "batch").agg(F.sum("size").alias("load"))
    return b.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_batches"), F.max("load").alias("fullest"))


def stream_thresholds(spark, d):
    t = _done(spark, sinks.moving_thresholds(_events(spark, d).select("event_type", "event_id", "value"), "event_type", "value", "event_id", 50, 0.25), "update")
    return t.select("event_type", F.round("lower", 8).alias("lower"), F.round("upper", 8).alias("upper"), "n")


QUERIES = {f.__name__: f for f in (stream_windows, stream_first_seen, stream_sink, stream_batches, stream_thresholds)}
SQL = {
    "stream_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_first_seen": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_sink": "SELECT event_type, count(*) AS n FROM events WHERE value > 100 GROUP BY 1",
    "stream_batches": "WITH RECURSIVE e AS (SELECT user_id, CAST(ceil(value) AS BIGINT) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id, ceil(value)) AS k FROM events WHERE value IS NOT NULL), r AS (SELECT user_id, k, 0 AS batch, s AS load FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN load > 0 AND load + s > 500 THEN batch + 1 ELSE batch END, CASE WHEN load > 0 AND load + s > 500 THEN s ELSE load + s END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1), b AS (SELECT user_id, batch, max(load) AS load FROM r GROUP BY ALL) SELECT user_id, count(*) AS n_batches, max(load) AS fullest FROM b GROUP BY 1",
    "stream_thresholds": "WITH t AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) SELECT event_type, round(quantile_cont(value, 0.25), 8) AS lower, round(quantile_cont(value, 0.75), 8) AS upper, count(value) AS n FROM t WHERE k <= 50 GROUP BY 1",
}
