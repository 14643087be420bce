"""Device health in JSON, of both common shapes (OP-S11, OP-H18, OP-X03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Attributes of the table shape and the counter each feeds.
ATTRIBUTES = {5: "reallocated_sectors", 197: "pending_sectors", 199: "crc_errors"}
EXPECTED = ("temperature_c", "wear_percent", "reallocated_sectors", "pending_sectors", "crc_errors", "io_errors")
SCHEMA = (
    "smart_status STRUCT<passed:BOOLEAN>, temperature STRUCT<current:DOUBLE>, "
    "nvme_smart_health_information_log STRUCT<percentage_used:DOUBLE,media_errors:BIGINT,temperature:DOUBLE>, "
    "ata_smart_attributes STRUCT<table:ARRAY<STRUCT<id:INT,raw:STRUCT<value:BIGINT>>>>"
)
FAILED_ERRORS = 100


def parse(text: Column) -> Column:
    return F.from_json(text, SCHEMA)


def counters(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with one column for each counter and ``missing``, the expected
    ones that the report does not hold, in their order. A device that says it
    has failed counts as having at least 100 I/O errors."""
    parsed = rows.withColumn("report", parse(F.col(text)))
    log, table = "report.nvme_smart_health_information_log", F.col("report.ata_smart_attributes.table")
    found = {name: F.array_max(F.transform(_rows(table, i), _raw)) for i, name in ATTRIBUTES.items()}
    errors = F.col(f"{log}.media_errors")
    failed = F.when(~F.col("report.smart_status.passed"), F.greatest(F.coalesce(errors, F.lit(0)), F.lit(FAILED_ERRORS)))
    found |= {
        "io_errors": F.coalesce(failed, errors),
        "wear_percent": F.col(f"{log}.percentage_used"),
        "temperature_c": F.coalesce("report.temperature.current", f"{log}.temperature"),
    }
    parsed = parsed.withColumns(found)
    names = F.array(*[F.lit(n) for n in EXPECTED])
    seen = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in EXPECTED]))
    return parsed.withColumn("missing", F.array_except(names, seen)).drop("report")


def _rows(table: Column, number: int) -> Column:
    return F.filter(table, lambda a: a["id"] == number)


def _raw(attribute: Column) -> Column:
    return attribute["raw"]["value"]


def reports(spark: SparkSession, path: str) -> DataFrame:
    """source and counters of each report file below ``path``."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), "value")
    return counters(rows, "value").drop("value")
