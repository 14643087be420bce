"""Metadata copies and journals (OP-S01, OP-S02)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetquery.schema import TABLES


def metadata_copies(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row for each copy: source, valid, error, and the document's columns.

    A copy that is no document of the schema has its text in ``error``.
    """
    schema = f"{TABLES['metadata']}, error STRING"
    rows = spark.read.schema(schema).option("multiLine", "true").option("columnNameOfCorruptRecord", "error")
    rows = rows.json(list(paths)).withColumn("source", F.col("_metadata.file_name"))
    valid = F.col("error").isNull() & F.col("meta_hash").eqNullSafe(F.sha2(F.coalesce("body", F.lit("")), 256))
    return rows.withColumn("valid", valid)


def journal(spark: SparkSession, path: str, volume: str = "volume") -> DataFrame:
    """Records of a log of JSON lines: file, seq, ok and the record's columns.

    A line that does not parse is a row of its own with ``ok`` false, and
    spoils no other. ``seq`` is the record's txid, or null for a broken line.
    """
    schema = f"{TABLES['journal']}, broken STRING"
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": "broken"})
    rows = lines.where(F.trim("value") != "").withColumn("record", parsed)
    ok = F.col("record").isNotNull() & F.col("record.broken").isNull() & F.col("record.record_type").isNotNull()
    return rows.select("file", F.col("record.txid").alias("seq"), ok.alias("ok"), "record.*").drop("broken")
