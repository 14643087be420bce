"""Summaries of experiments and fleets (OP-A12, OP-A13, OP-A19 to OP-A25,
OP-J23, OP-J25, OP-K08, OP-H32)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def variation(value: str) -> Column:
    """Coefficient of variation in percent; 0 for fewer than two or a mean of 0."""
    usable = (F.count(value) >= 2) & (F.avg(value) != 0)
    return F.when(usable, F.stddev_samp(value) / F.avg(value) * 100).otherwise(0.0)


def perf_summary(rows: DataFrame, scenario: str, value: str, baseline: str) -> DataFrame:
    """scenario, runs, median, cv, ratio of medians to the baseline's. The
    baseline joins as one row."""
    sums = rows.groupBy(scenario).agg(
        F.count("*").alias("runs"), F.median(value).alias("median"), variation(value).alias("cv")
    )
    base = sums.where(F.col(scenario) == baseline).agg(F.max("median").alias("base"))
    ratio = F.when(F.col("base") != 0, F.col("median") / F.col("base"))
    return sums.join(F.broadcast(base)).select(scenario, "runs", "median", "cv", ratio.alias("ratio"))


def pass_fail(rows: DataFrame, scenario: str, passed: Column) -> DataFrame:
    return rows.groupBy(scenario).agg(
        F.count("*").alias("runs"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed")
    )


def grid_status(rows: DataFrame, left: str, right: str, status: Column, rights: Sequence[str]) -> DataFrame:
    """Each left value with each of the named right ones: its status, or missing."""
    cells = rows.groupBy(left, right).agg(status.alias("status"))
    grid = rows.select(left).distinct().select(left, F.explode(F.array(*[F.lit(r) for r in rights])).alias(right))
    return grid.join(cells, [left, right], "left").select(left, right, F.coalesce("status", F.lit("missing")).alias("status"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, p50 (the value of rank n div 2, from 0), p95 (the largest)."""
    up = Window.partitionBy(key).orderBy(value)
    ranked = rows.select(key, value, (F.row_number().over(up) - 1).alias("rank"))
    n = F.count("*").over(Window.partitionBy(key))
    ranked = ranked.withColumn("middle", F.floor(n / 2))
    return ranked.groupBy(key).agg(
        F.max(F.when(F.col("rank") == F.col("middle"), F.col(value))).alias("p50"), F.max(value).alias("p95")
    )


def hit_ratio(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def adaptive_mode(stats: DataFrame) -> DataFrame:
    """One row, mode: reduced if failures lead and are two or more."""
    sums = stats.agg(F.coalesce(F.sum("failures"), F.lit(0)).alias("f"), F.coalesce(F.sum("successes"), F.lit(0)).alias("s"))
    reduced = (F.col("f") > F.col("s")) & (F.col("f") >= 2)
    return sums.select(F.when(reduced, "reduced").otherwise("normal").alias("mode"))


def exposition(rows: DataFrame, label: str, label_value: Column, metrics: Sequence[str], prefix: str) -> DataFrame:
    """line: one sample in text form for each row and metric."""
    pairs = F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("string").alias("value")) for m in metrics])
    cells = rows.select(label_value.alias("of"), F.explode(pairs).alias("cell"))
    line = F.format_string(f'{prefix}_%s{{{label}="%s"}} %s', "cell.name", "of", "cell.value")
    return cells.select(line.alias("line"))


def preflight(pools: DataFrame, writable: bool) -> DataFrame:
    """``pools`` (pool, devices, available, all_online, redundancy) with
    missing, degraded, issues and ok."""
    missing = F.greatest(F.col("devices") - F.col("available"), F.lit(0))
    rows = pools.withColumn("missing", missing).withColumn("degraded", (missing > 0) | ~F.col("all_online"))
    issues = F.array_compact(
        F.array(
            F.when(F.col("degraded") & F.lit(writable), "degraded-rootfs-requires-explicit-mode"),
            F.when(F.col("missing") > F.col("redundancy"), "insufficient-redundancy"),
        )
    )
    return rows.withColumn("issues", issues).withColumn("ok", F.size("issues") == 0)


def ordered_scenarios(rows: DataFrame, scenario: str, known: Sequence[str]) -> DataFrame:
    """scenario, place: the scenarios that occur, ``known`` ones first in their
    order, then all others by name (OP-O09)."""
    at = F.array_position(F.array(*[F.lit(k) for k in known]), F.col(scenario))
    place = F.when(at > 0, at).otherwise(len(known) + 1).cast("int")
    return rows.select(scenario).distinct().withColumn("place", place).orderBy("place", scenario)


def column_summary(rows: DataFrame, scenario: str, value: str) -> DataFrame:
    """scenario, records, mean, most of a column of measurements (OP-A21)."""
    return rows.groupBy(scenario).agg(
        F.count("*").alias("records"), F.avg(value).alias("mean"), F.max(value).alias("most")
    )
