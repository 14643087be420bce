"""Ordered folds in closed form (OP-W03, OP-W04, OP-W06, OP-W10, OP-W12,
OP-O02): windows that sort and spill, where a fold would gather a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ewma(samples: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, alpha: float) -> DataFrame:
    """keys, ewma, samples: seeded with the first sample, then (1-a)*e + a*x.

    Sample i of n weighs a * (1-a)^(n-i), the first (1-a)^(n-1). Right for a
    state that restarts at 0 or less too, so long as samples are positive.
    """
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    rows = samples.select(*keys, value.alias("x"), (F.row_number().over(down) - 1).alias("age"))
    sums = rows.groupBy(*keys).agg(
        F.sum(F.col("x") * F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("age"))).alias("weighted"),
        F.max_by("x", "age").alias("first"),
        F.count("*").alias("samples"),
    )
    seed = F.col("first") * F.lit(1 - alpha) * F.pow(F.lit(1 - alpha), F.col("samples") - 1)
    return sums.select(*keys, (F.col("weighted") + seed).alias("ewma"), "samples")


def throughput_ewma(samples: DataFrame, keys: Sequence[str], order: Sequence[str], size: Column, seconds: Column) -> DataFrame:
    """keys, mib_s: average of MiB a second, each sample weighing a fifth.
    Samples without bytes leave it as it was; 0 where none has any (OP-W03)."""
    rate = size / F.lit(1048576.0) / F.greatest(seconds, F.lit(1e-6))
    moved = ewma(samples.where(size > 0), keys, order, rate, 0.2).select(*keys, "ewma")
    every = samples.select(*keys).distinct().join(moved, list(keys), "left")
    return every.select(*keys, F.coalesce("ewma", F.lit(0.0)).alias("mib_s"))


def positive_ms(seconds: Column) -> Column:
    """Milliseconds of a duration of at least a microsecond."""
    return F.greatest(seconds, F.lit(1e-6)) * 1000.0


def risk_streaks(history: DataFrame, key: str, order: Sequence[str], risky: Column, now: Column) -> DataFrame:
    """key, risk_streak, healthy_streak, cleared_at after all of its reports.

    Two healthy reports in a row clear the risk; the streak is what is risky
    after the last such place. ``cleared_at``: least ``now`` of them, or null.
    """
    up = Window.partitionBy(key).orderBy(*order)
    rows = history.select(
        key,
        risky.alias("risky"),
        now.alias("now"),
        F.row_number().over(up).alias("rn"),
        F.lag(risky).over(up).alias("before"),
    )
    clears = ~F.col("risky") & ~F.coalesce("before", F.lit(True))
    whole = Window.partitionBy(key)
    rows = rows.select(
        key,
        "risky",
        "rn",
        F.when(clears, F.col("now")).alias("at"),
        F.coalesce(F.max(F.when(clears, F.col("rn"))).over(whole), F.lit(0)).alias("last_clear"),
        F.coalesce(F.max(F.when(F.col("risky"), F.col("rn"))).over(whole), F.lit(0)).alias("last_risk"),
    )
    return rows.groupBy(key).agg(
        F.count_if(F.col("risky") & (F.col("rn") > F.col("last_clear"))).alias("risk_streak"),
        (F.max("rn") - F.max("last_risk")).cast("long").alias("healthy_streak"),
        F.min("at").alias("cleared_at"),
    )


def lru_evicted(entries: DataFrame, cache: str, touched: Sequence[str], size: str, limit: int) -> DataFrame:
    """Entries that go: those which newer ones and themselves exceed ``limit``."""
    newest = Window.partitionBy(cache).orderBy(*[F.desc(c) for c in touched])
    kept = F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("held", kept).where(F.col("held") > limit).drop("held")


def cyclic_page(rows: DataFrame, key: str, cursor: int | None, limit: int | None) -> DataFrame:
    """Up to ``limit`` rows after ``cursor``, going round; all without a limit."""
    if limit is None:
        return rows.orderBy(key)
    if cursor is None:
        return rows.orderBy(key).limit(limit)
    return rows.orderBy(F.col(key) <= cursor, key).limit(limit)


def commit_batches(events: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """``events`` with the number of the group commit that takes them."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return events.withColumn("batch", F.floor(rn / size).cast("long"))
