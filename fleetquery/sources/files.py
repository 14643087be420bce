"""Files, trees and their metadata (OP-S08, OP-S09, OP-S10, OP-S13, OP-S07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, relpath, size, modified of all files below ``root``.

    Only the listing is read: contents are pruned from the scan. Spark gives
    files without a byte no task, so they are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    plain = F.regexp_replace("path", "^file:/*/", "/")
    relative = F.substring(plain, F.lit(len(base) + 2), F.length(plain))
    return files.select("path", relative.alias("relpath"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def directory_size(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def hashed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """relpath, size, hash (SHA-256 of the content) of all files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    plain = F.regexp_replace("path", "^file:/*/", "/")
    relative = F.substring(plain, F.lit(len(base) + 2), F.length(plain))
    return files.select(relative.alias("relpath"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def content_range(content: Column, offset: int, length: int) -> Column:
    return F.substring(content, offset + 1, length)


def cache_index(spark: SparkSession, root: str) -> DataFrame:
    """Entries of an on-disk cache as an LRU reads them: touched, then path."""
    return listing(spark, root).select("relpath", "size", F.col("modified").alias("touched"))
