"""Usage and capacity (OP-A01 to OP-A08, OP-A15 to OP-A18, OP-J11, OP-J16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(owners: DataFrame, key: str, pieces: DataFrame, piece_key: str, size: Column) -> DataFrame:
    """``owners`` with used_bytes and pieces: sums over their pieces, 0 if none."""
    sums = pieces.groupBy(F.col(piece_key).alias("of_key")).agg(F.sum(size).alias("used"), F.count("*").alias("n"))
    joined = owners.join(sums, F.col(key) == F.col("of_key"), "left")
    return joined.select(
        owners["*"], F.coalesce("used", F.lit(0)).alias("used_bytes"), F.coalesce("n", F.lit(0)).alias("pieces")
    )


def usage_skew(disks: DataFrame) -> DataFrame:
    """One row, skew: the wider of the range of fill ratios and the range of
    used bytes over their mean (1 at most). Fewer than two disks have none; a
    disk without a capacity counts its bytes as its ratio."""
    ratio = F.when(F.col("capacity_bytes") > 0, F.col("used_bytes") / F.col("capacity_bytes")).otherwise(
        F.col("used_bytes").cast("double")
    )
    row = disks.where("status = 'online'").agg(
        F.count("*").alias("n"),
        (F.max(ratio) - F.min(ratio)).alias("ratios"),
        (F.max("used_bytes") - F.min("used_bytes")).alias("bytes"),
        (F.sum("used_bytes") / F.count("*")).alias("mean"),
    )
    relative = F.when(F.col("mean") > 0, F.least(F.col("bytes") / F.col("mean"), F.lit(1.0))).otherwise(0.0)
    return row.select(F.when(F.col("n") < 2, 0.0).otherwise(F.greatest("ratios", relative)).alias("skew"))


def effective_capacity(disks: DataFrame, filesystem: str) -> DataFrame:
    """Disks with what their shared filesystem has: capacity once, usage summed.

    Sums are aggregated and joined back, so a filesystem that a third of all
    disks share is never one window. Only probed capacities are shared."""
    shared = (F.col("capacity_source") == "auto-probe") & F.col(filesystem).isNotNull()
    groups = (
        disks.where(shared)
        .groupBy(F.col(filesystem).alias("fleet_fs"))
        .agg(F.max("capacity_bytes").alias("fs_capacity"), F.sum("used_bytes").alias("fs_used"))
    )
    joined = disks.join(groups, shared & (F.col(filesystem) == F.col("fleet_fs")), "left")
    return joined.select(
        disks["*"],
        F.coalesce("fs_capacity", "capacity_bytes").alias("effective_capacity"),
        F.coalesce("fs_used", "used_bytes").alias("effective_used"),
    )


def two_level_capacity(disks: DataFrame, filesystem: str, k: int, m: int) -> DataFrame:
    """One row: configured and usable bytes. Disks that share a filesystem
    count once, with the largest; others, and overridden ones, on their own."""
    alone = F.col(filesystem).isNull() | (F.col("capacity_source") == "user-override")
    online = disks.where("status = 'online'")
    single = online.where(alone).select("capacity_bytes")
    grouped = online.where(~alone).groupBy(filesystem).agg(F.max("capacity_bytes").alias("capacity_bytes"))
    total = single.unionByName(grouped.select("capacity_bytes")).agg(
        F.coalesce(F.sum("capacity_bytes"), F.lit(0)).alias("configured")
    )
    return total.select("configured", F.expr(f"(configured * {k}) div {max(k + m, 1)}").alias("usable"))


def max_stripe_units(disks: DataFrame, group: Sequence[str], capacity: str, width: int) -> DataFrame:
    """The most units that stripes of ``width`` disks can hold, by group.

    Largest x with sum(min(c, x)) >= x * width, which is the least over
    j < width of floor(sum of all but the j largest / (width - j)); fewer
    disks than ``width`` give 0. Only the ``width`` largest are ranked out.
    """
    order = Window.partitionBy(*group).orderBy(F.desc(capacity))
    ranked = disks.select(*group, F.col(capacity).alias("c"), F.row_number().over(order).alias("rn"))
    sums = ranked.groupBy(*group).agg(
        F.count("*").alias("n"),
        *[F.coalesce(F.sum(F.when(F.col("rn") > j, F.col("c"))), F.lit(0)).alias(f"rest_{j}") for j in range(width)],
    )
    each = [F.call_function("div", F.col(f"rest_{j}").cast("long"), F.lit(width - j)) for j in range(width)]
    units = F.least(*each) if width > 1 else each[0]
    return sums.select(*group, F.when(F.col("n") < width, F.lit(0)).otherwise(units).cast("long").alias("units"))


def allocator_free(allocators: DataFrame, extents: DataFrame) -> DataFrame:
    """disk_id, free_bytes: block-aligned tail and free extents."""
    block = F.greatest("block_size", F.lit(4096))
    tail = F.greatest(F.col("data_end") - F.col("next_offset"), F.lit(0))
    joined = extents.join(allocators.select("disk_id", block.alias("block")), "disk_id")
    sums = joined.groupBy("disk_id").agg(F.sum(F.expr("(length div block) * block")).alias("aligned"))
    rows = allocators.withColumn("block", block).withColumn("tail", tail).join(sums, "disk_id", "left")
    return rows.select("disk_id", (F.expr("(tail div block) * block") + F.coalesce("aligned", F.lit(0))).alias("free_bytes"))


def next_numbered(ids: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row, next_id: one above the largest number after ``prefix``."""
    number = F.regexp_extract(column, f"^{prefix}([0-9]+)$", 1).try_cast("long")
    top = F.coalesce(F.max(number), F.lit(-1)) + 1
    return ids.agg(F.concat(F.lit(prefix), F.lpad(top.cast("string"), 4, "0")).alias("next_id"))


def minimum_redundancy(blocks: DataFrame, layouts: DataFrame, fallback: int) -> DataFrame:
    """One row, redundancy: least m of layouts in use; unknown ones are skipped."""
    used = blocks.select(F.coalesce(F.nullif("layout_id", F.lit("")), F.lit("layout-0000")).alias("id")).distinct()
    return used.join(layouts, "id").agg(F.coalesce(F.min("m"), F.lit(fallback)).alias("redundancy"))


def widest_layout(layouts: DataFrame, least: int) -> DataFrame:
    """Most shards that a stripe of any layout has, ``least`` at least (OP-A16)."""
    width = F.coalesce(F.max(F.col("k") + F.col("m")), F.lit(0))
    return layouts.agg(F.greatest(width, F.lit(least)).alias("width"))
