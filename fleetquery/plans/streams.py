"""Streams over the events, run to their end and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetquery.operators.folds import positive_ms
from fleetquery.plans import fleet
from fleetquery.session import shared_path
from fleetquery.streaming import stateful

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("tie"), "event_type", "value")


def _run(stream: DataFrame, spark: SparkSession, what: str, mode: str = "update") -> DataFrame:
    out = shared_path(spark, what)
    write: Callable[[DataFrame], None] = lambda df: df.write.mode("append").parquet(out)
    stateful.each_batch(stream, write, shared_path(spark, f"{what}-log"), mode).awaitTermination()
    return spark.read.parquet(out)


def stream_latency_ewma(spark: SparkSession, d: str) -> DataFrame:
    samples = _events(spark, d).withColumn("value", positive_ms(F.col("value")))
    found = _run(stateful.stream_ewma(samples), spark, "stream-ewma")
    last = found.groupBy("key").agg(F.max_by(F.struct("samples", "ewma"), "samples").alias("r"))
    return last.select(F.col("key").alias("user_id"), "r.samples", F.round("r.ewma", 6).alias("ewma_ms"))


def stream_risk_streak(spark: SparkSession, d: str) -> DataFrame:
    reports = _events(spark, d).withColumn("risky", F.col("event_type") == "error")
    found = _run(stateful.stream_streaks(reports), spark, "stream-streaks")
    return found.select(F.col("key").alias("user_id"), "risk_streak", "healthy_streak")


def stream_window_latency(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.col("at").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
    found = _run(stateful.windowed_latency(rows), spark, "stream-windows", "complete")
    return found.select(F.unix_seconds("start").alias("start"), "kind", "samples", F.round("worst", 6).alias("worst"))


QUERIES = {
    "stream_latency_ewma": stream_latency_ewma,
    "stream_risk_streak": stream_risk_streak,
    "stream_window_latency": stream_window_latency,
}
SQL = {
    "stream_latency_ewma": fleet.SQL["latency_ewma"],
    "stream_risk_streak": fleet.SQL["risk_streak"],
    "stream_window_latency": """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type AS kind, count(*) AS samples,
      round(max(value), 6) AS worst FROM events GROUP BY 1, 2""",
}
