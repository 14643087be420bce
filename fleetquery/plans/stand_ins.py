"""Stand-ins for fleet tables: which benchmark columns play which part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetquery.operators.capacity import usage

NOW = 1_100_000.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def disks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as disks, line items as the shards on them."""
    supplier = read(spark, sf_dir, "supplier")
    lineitem = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    rows = usage(supplier, "s_suppkey", lineitem, "l_suppkey", F.floor("l_quantity").cast("long"))
    k = F.col("s_suppkey")
    status = (
        F.when(k % 11 == 3, "degraded").when(k % 11 == 5, "draining").when(k % 13 == 7, "failed")
        .when(k % 17 == 9, "offline").when(k % 19 == 4, "removed").otherwise("online")
    )
    return rows.select(
        k.alias("id"),
        status.alias("status"),
        F.col("used_bytes").cast("long").alias("used_bytes"),
        F.when(k % 9 == 1, 0).otherwise(F.floor(F.abs("s_acctbal") * 4) + 5000).cast("long").alias("capacity_bytes"),
        F.when(k % 3 == 0, "user-override").otherwise("auto-probe").alias("capacity_source"),
        F.col("s_nationkey").alias("domain"),
        ((k * 37) % 500).alias("reallocated_sectors"),
        ((k * 13) % 12).alias("pending_sectors"),
        ((k * 7) % 90).alias("crc_errors"),
        ((k * 11) % 60).alias("io_errors"),
        ((k * 29) % 700).cast("double").alias("latency_ms"),
        ((k * 17) % 110).cast("double").alias("wear_percent"),
        ((k * 19) % 60 + 30).cast("double").alias("temperature_c"),
        F.when(k % 4 == 0, 0.0).otherwise(1_000_000.0 + (k * 900) % 90_000).alias("last_smart_refresh_at"),
        ((k * 5) % 40).cast("double").alias("read_ms"),
        ((k * 3) % 50).cast("double").alias("write_ms"),
        ((k % 8) + 1).cast("double").alias("weight"),
        F.when(k % 3 == 1, "hot").when(k % 3 == 2, "cold").otherwise("warm").alias("tier"),
    )


DISKS_SQL = """
used AS (SELECT l_suppkey, sum(CAST(floor(l_quantity) AS BIGINT)) AS used FROM lineitem GROUP BY 1),
disks AS (
  SELECT s_suppkey AS id,
    CASE WHEN s_suppkey % 11 = 3 THEN 'degraded' WHEN s_suppkey % 11 = 5 THEN 'draining' WHEN s_suppkey % 13 = 7 THEN 'failed'
         WHEN s_suppkey % 17 = 9 THEN 'offline' WHEN s_suppkey % 19 = 4 THEN 'removed' ELSE 'online' END AS status,
    CAST(coalesce(used, 0) AS BIGINT) AS used_bytes,
    CASE WHEN s_suppkey % 9 = 1 THEN 0 ELSE CAST(floor(abs(s_acctbal) * 4) + 5000 AS BIGINT) END AS capacity_bytes,
    CASE WHEN s_suppkey % 3 = 0 THEN 'user-override' ELSE 'auto-probe' END AS capacity_source,
    s_nationkey AS domain,
    (s_suppkey * 37) % 500 AS reallocated_sectors, (s_suppkey * 13) % 12 AS pending_sectors,
    (s_suppkey * 7) % 90 AS crc_errors, (s_suppkey * 11) % 60 AS io_errors,
    CAST((s_suppkey * 29) % 700 AS DOUBLE) AS latency_ms, CAST((s_suppkey * 17) % 110 AS DOUBLE) AS wear_percent,
    CAST((s_suppkey * 19) % 60 + 30 AS DOUBLE) AS temperature_c,
    CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE 1000000.0 + (s_suppkey * 900) % 90000 END AS last_smart_refresh_at,
    CAST((s_suppkey * 5) % 40 AS DOUBLE) AS read_ms, CAST((s_suppkey * 3) % 50 AS DOUBLE) AS write_ms,
    CAST(s_suppkey % 8 + 1 AS DOUBLE) AS weight,
    CASE WHEN s_suppkey % 3 = 1 THEN 'hot' WHEN s_suppkey % 3 = 2 THEN 'cold' ELSE 'warm' END AS tier
  FROM supplier LEFT JOIN used ON l_suppkey = s_suppkey)"""

SCORE_SQL = """least(1.0,
    CASE status WHEN 'failed' THEN 1.0 WHEN 'offline' THEN 1.0 WHEN 'degraded' THEN 0.35 WHEN 'draining' THEN 0.35 ELSE 0.0 END::DOUBLE
    + CASE WHEN reallocated_sectors > 0 THEN least(reallocated_sectors / 400.0::DOUBLE, 0.25::DOUBLE) ELSE 0 END
    + CASE WHEN pending_sectors > 0 THEN least(pending_sectors / 100.0::DOUBLE, 0.25::DOUBLE) ELSE 0 END
    + CASE WHEN crc_errors > 0 THEN least(crc_errors / 500.0::DOUBLE, 0.12::DOUBLE) ELSE 0 END
    + CASE WHEN io_errors > 0 THEN least(io_errors / 100.0::DOUBLE, 0.25::DOUBLE) ELSE 0 END
    + CASE WHEN latency_ms > 50 THEN least((latency_ms - 50) / 500.0::DOUBLE, 0.20::DOUBLE) ELSE 0 END
    + CASE WHEN wear_percent > 80 THEN least((wear_percent - 80) / 100.0::DOUBLE, 0.20::DOUBLE) ELSE 0 END
    + CASE WHEN temperature_c > 55 THEN least((temperature_c - 55) / 80.0::DOUBLE, 0.10::DOUBLE) ELSE 0 END
    + CASE WHEN capacity_bytes > 0 AND used_bytes::DOUBLE / capacity_bytes > 0.92 THEN 0.10 ELSE 0 END::DOUBLE)"""

PREDICTED_SQL = "(round(score, 9) >= 0.65 OR pending_sectors >= 8 OR io_errors >= 40 OR status = 'failed')"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of a device (the user) in order of (ts, event_id)."""
    return read(spark, sf_dir, "events")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as extents: an order's days from shipping on."""
    rows = read(spark, sf_dir, "lineitem")
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return rows.select(
        F.col("l_orderkey").alias("ino"),
        F.col("l_suppkey").alias("disk"),
        start.alias("start"),
        (start + F.floor("l_quantity").cast("long")).alias("end"),
    )


INTERVALS_SQL = """
ivals AS (SELECT l_orderkey AS ino, l_suppkey AS disk, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS s,
  date_diff('day', DATE '1995-01-01', l_shipdate::DATE) + CAST(floor(l_quantity) AS BIGINT) AS e FROM lineitem)"""


def dentries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a tree: each hangs below number (key - 1) div 2 of it."""
    nation = read(spark, sf_dir, "nation").where("n_nationkey > 0")
    return nation.select(
        F.expr("(n_nationkey - 1) div 2").alias("parent"),
        F.col("n_name").alias("name"),
        F.col("n_nationkey").cast("long").alias("child"),
    )
