"""Risk, heat, decisions and throttles of devices and files (OP-H05, OP-H13,
OP-W05, OP-W17, OP-W18, OP-W19, OP-F09, OP-F11)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the risk model: counter, reason, divisor, most it adds.
COUNTERS = (
    ("reallocated_sectors", "reallocated-sectors", 400.0, 0.25),
    ("pending_sectors", "pending-sectors", 100.0, 0.25),
    ("crc_errors", "crc-errors", 500.0, 0.12),
    ("io_errors", "io-errors", 100.0, 0.25),
)
# Gauge, reason, level above which it counts, divisor, most it adds.
GAUGES = (
    ("latency_ms", "high-latency", 50.0, 500.0, 0.20),
    ("wear_percent", "wear", 80.0, 100.0, 0.20),
    ("temperature_c", "temperature", 55.0, 80.0, 0.10),
)
STATUS_RISK = {"failed": 1.0, "offline": 1.0, "degraded": 0.35, "draining": 0.35}
NEAR_FULL, NEAR_FULL_RISK = 0.92, 0.10
STALE_SECONDS = 86400.0
PREDICTED_AT, PREDICTED_PENDING, PREDICTED_IO = 0.65, 8, 40


def available(capacity: Column, used: Column) -> Column:
    return F.greatest(capacity - used, F.lit(0))


def smart_stale(last: Column, now: float) -> Column:
    """Never refreshed, or more than a day ago."""
    return (last <= 0) | (F.lit(now) - last > STALE_SECONDS)


def _nearly_full() -> Column:
    return (F.col("capacity_bytes") > 0) & (F.col("used_bytes") / F.col("capacity_bytes") > NEAR_FULL)


def risk_score() -> Column:
    """Capped sum over the columns of a disk row, 0 to 1."""
    parts = [F.coalesce(*[F.when(F.col("status") == s, F.lit(v)) for s, v in STATUS_RISK.items()], F.lit(0.0))]
    for name, _, divisor, most in COUNTERS:
        parts.append(F.when(F.col(name) > 0, F.least(F.col(name) / divisor, F.lit(most))).otherwise(0.0))
    for name, _, level, divisor, most in GAUGES:
        parts.append(F.when(F.col(name) > level, F.least((F.col(name) - level) / divisor, F.lit(most))).otherwise(0.0))
    parts.append(F.when(_nearly_full(), NEAR_FULL_RISK).otherwise(0.0))
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.least(total, F.lit(1.0))


def risk_reasons(now: float) -> Column:
    """What adds to the score, in a fixed order."""
    found = [F.when(F.col("status").isin(*STATUS_RISK), F.col("status"))]
    found += [F.when(F.col(name) > 0, F.lit(reason)) for name, reason, *_ in COUNTERS]
    found += [F.when(F.col(name) > level, F.lit(reason)) for name, reason, level, *_ in GAUGES]
    found.append(F.when(smart_stale(F.col("last_smart_refresh_at"), now), "smart-stale-or-unavailable"))
    found.append(F.when(_nearly_full(), "near-capacity"))
    return F.array_compact(F.array(*found))


def predicted_failure(score: Column) -> Column:
    return (
        (score >= PREDICTED_AT)
        | (F.col("pending_sectors") >= PREDICTED_PENDING)
        | (F.col("io_errors") >= PREDICTED_IO)
        | (F.col("status") == "failed")
    )


def drain_decision(
    score: Column, io_errors: Column, streak: Column, next_action_after: Column, now: Column, critical: float, confirmations: int
) -> Column:
    urgent = (score >= critical) | (io_errors >= PREDICTED_IO) | (streak >= confirmations)
    return F.when(now < next_action_after, "cooldown").when(urgent, "drain").otherwise("observe")


def due(last_at: Column, interval: Column, now: Column, never: int = (1 << 63) - 1) -> Column:
    """``interval`` of ``never`` switches an action off; last 0 has not run."""
    return (interval != never) & ((last_at <= 0) | (now - last_at >= interval))


def decay(age_seconds: Column) -> Column:
    """Half for each day, for 30 days at most."""
    hours = F.least(F.greatest(age_seconds, F.lit(0.0)) / 3600.0, F.lit(720.0))
    return F.pow(F.lit(0.5), hours / 24.0)


def heat(before: Column, reads: Column, read_age: Column, writes: Column, write_age: Column) -> Column:
    return before * 0.70 + reads * decay(read_age) + writes * 2.0 * decay(write_age)


def tier_of(kind: Column, boot_critical: Column, score: Column, size: Column) -> Column:
    hot = boot_critical | (score >= 8.0) | ((score >= 3.0) & (size <= 8 << 20))
    return (
        F.when(kind != "file", "warm").when(hot, "hot").when((score < 0.5) & (size >= 1 << 20), "cold").otherwise("warm")
    )


def adaptive_budget(base: Column, utility: Column) -> Column:
    factor = F.when(utility > 3.0, 2.0).when(utility < -0.5, 0.5).otherwise(1.0)
    scaled = F.floor(base * factor + 0.5).cast("long")
    return F.when(base == 0, F.lit(0).cast("long")).otherwise(F.least(F.greatest(scaled, F.lit(1)), base * 4))


@dataclass(frozen=True)
class ThrottlePolicy:
    mode: str = "balanced"
    target_ms: float = 20.0
    max_read_mib_s: float | None = None
    max_write_mib_s: float | None = None
    pause_ms: float | None = None
    pause_load: float | None = None

    def rate(self, action: str) -> float | None:
        given = [x for x in (self.max_read_mib_s, self.max_write_mib_s) if x is not None]
        if action in ("scrub", "repair"):
            return self.max_read_mib_s
        return min(given, default=None) if action in ("rebalance", "drain") else None


def throttled_budget(policy: ThrottlePolicy, action: str, requested: Column, latency: Column, load: Column | None = None) -> Column:
    """Budget that background work gets while the foreground is this slow."""
    if policy.mode == "observe":
        return F.lit(0).cast("long")
    budget = requested
    if policy.mode != "aggressive":
        half = F.greatest(F.floor(requested / 2).cast("long"), F.lit(1))
        budget = (
            F.when(latency > policy.target_ms * 2, F.least(requested, F.lit(1)))
            .when(latency > policy.target_ms, F.least(requested, half))
            .otherwise(requested)
        )
    if (rate := policy.rate(action)) is not None:
        budget = F.least(budget, F.lit(int(rate)))
    if policy.pause_ms is not None:
        budget = F.when(latency > policy.pause_ms, 0).otherwise(budget)
    if policy.pause_load is not None and load is not None:
        budget = F.when(load > policy.pause_load, 0).otherwise(budget)
    return budget.cast("long")


CLASS_WEIGHT = {"nvme": 4.0, "ssd": 2.5}


def recommended_weight(kind: Column, read_mib_s: Column, write_mib_s: Column) -> Column:
    base = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in CLASS_WEIGHT.items()], F.lit(1.0))
    measured = F.least(F.greatest((read_mib_s + write_mib_s) / 2 / 180.0, F.lit(0.5)), F.lit(6.0))
    measured = F.when((read_mib_s > 0) | (write_mib_s > 0), measured).otherwise(base)
    return F.least(F.greatest((base + measured) / 2, F.lit(0.25)), F.lit(8.0))


def recommended_tier(kind: Column, weight: Column) -> Column:
    unknown = F.when(weight >= 2.0, "hot").otherwise("warm")
    return F.when(kind.isin("nvme", "ssd"), "hot").when(kind == "hdd", "cold").otherwise(unknown)


def one_of(value: Column, names: Sequence[str]) -> Column:
    return value.isin(*names)


#: Three sets that must not be confused (OP-F02).
BOOTABLE = ("online", "degraded")
READABLE = ("online", "degraded", "draining")
UNAVAILABLE = ("failed", "offline", "removed")
