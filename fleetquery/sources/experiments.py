"""Results of experiments (OP-S16) and policies (OP-S14, OP-F13)."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "rootfs_perf": (
        "scenario STRING, status STRING, iteration INT, large_write_mib_s DOUBLE, large_read_mib_s DOUBLE, "
        "small_create_files_s DOUBLE, small_stat_files_s DOUBLE, reason STRING"
    ),
    "failure_matrix": "scenario STRING, run INT, status STRING, duration_sec DOUBLE, commands INT",
    "workload_shift": (
        "phase INT, hot_set STRING, files_written INT, bytes_written BIGINT, rebalance_files INT, "
        "foreground_p50_ms DOUBLE, foreground_p95_ms DOUBLE, hot_tier_fraction DOUBLE, fsck_errors INT"
    ),
}


def results(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Rows of JSON lines, or of CSV with a header, by the file's ending."""
    reader = spark.read.schema(SCHEMAS[name])
    return reader.csv(path, header=True) if path.endswith(".csv") else reader.json(path)


@dataclass(frozen=True)
class Policy:
    """What maintenance may do. Unknown settings and bad values are refused."""

    mode: str = "balanced"
    target_foreground_ms: float = 20.0
    max_read_mib_s: float | None = None
    max_write_mib_s: float | None = None
    pause_foreground_ms: float | None = None
    pinned_paths: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.mode not in ("observe", "safe", "balanced", "aggressive"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if not (math.isfinite(self.target_foreground_ms) and self.target_foreground_ms > 0):
            raise ValueError("target_foreground_ms must be above 0")
        for name in ("max_read_mib_s", "max_write_mib_s", "pause_foreground_ms"):
            value = getattr(self, name)
            if value is not None and not (math.isfinite(value) and value >= 0):
                raise ValueError(f"{name} must be finite and not negative")
        for path in self.pinned_paths:
            if not path.startswith("/") or ".." in PurePosixPath(path).parts:
                raise ValueError(f"{path!r} is not an absolute path without '..'")

    @classmethod
    def load(cls, text: str) -> Policy:
        held = json.loads(text)
        known = {f.name for f in fields(cls)}
        if unknown := set(held) - known:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in held.items()})
