"""Writers (OP-K01 to OP-K03, OP-K08 to OP-K11, OP-K13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetquery.functions.text import path_depth


class Conflict(Exception):
    """What is stored is newer than what the writer has read."""


def write_copies(document: DataFrame, paths: Sequence[str]) -> None:
    """The same rows to each path, one after the other; each commit is atomic."""
    for path in paths:
        document.coalesce(1).write.mode("overwrite").json(path)


def append_checked(records: DataFrame, path: str, expected_txid: int | None) -> None:
    """Appends to a log unless it holds a txid above ``expected_txid``."""
    spark = records.sparkSession
    try:
        stored = spark.read.schema(records.schema).parquet(path).agg(F.max("txid")).first()[0]
    except Exception as e:  # a log that is not there yet has no records
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    if expected_txid is not None and stored is not None and stored > expected_txid:
        raise Conflict(f"log is at {stored}, writer expected {expected_txid}")
    records.write.mode("append").parquet(path)


def snapshot(table: DataFrame, root: str, name: str) -> str:
    """A named copy that never replaces another."""
    import re

    path = f"{root.rstrip('/')}/{re.sub('[^A-Za-z0-9._-]', '_', name)}"
    table.write.mode("errorifexists").parquet(path)
    return path


def write_lines(lines: DataFrame, path: str) -> None:
    """A text table, such as metric samples."""
    lines.select("line").write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def export_order(entries: DataFrame, path: str) -> DataFrame:
    """Parents before what they hold."""
    return entries.orderBy(path_depth(F.col(path)), path)
