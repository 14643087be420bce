"""A session with the settings that the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    name: str = "fleetquery",
    options: dict[str, str] | None = None,
) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive execution with skew-join splitting."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (options or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset and the master is local (tests) a temporary folder of the driver
    takes its place: on a cluster executors would each write to their own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fleetquery-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/fleetquery/{what}-{uuid.uuid4().hex}"
