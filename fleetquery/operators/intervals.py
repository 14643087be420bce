"""Intervals: half-open, start and end (OP-W07 to OP-W09, OP-J09, OP-J10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows meant for one task: what it sorts does not grow with the table.
TASK_ROWS = 250_000


def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` by their keys, to more tasks than the session's where they
    would be too many for these; a key's rows stay together, and spill."""
    tasks = -(-rows.count() // TASK_ROWS)
    more = tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys) if more else rows


def coalesce(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end: overlapping and touching intervals joined; empty ones
    are dropped.

    One sort, and rows are not grouped again: an island ends with the row after
    which nothing starts within its reach, and has started with the last row
    that was beyond the reach of all before it.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt(rows.where(F.col("start") < F.col("end")).select(*keys, "start", "end"), keys)
    reach, after = F.max("end").over(so_far), F.lead("start").over(order)
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select(*keys, "start", "end", before.alias("before"), reach.alias("reach"), after.alias("after"))
    opens = F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), F.col("start"))
    rows = rows.select(*keys, F.max(opens).over(so_far).alias("start"), F.col("reach").alias("end"), "after")
    return rows.where(F.col("after").isNull() | (F.col("after") > F.col("end"))).drop("after")


def overlaps(rows: DataFrame, keys: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """Intervals that begin before the one ahead of them has ended."""
    order = Window.partitionBy(*keys).orderBy("start", "end", *ties)
    marked = rows.withColumn("previous_end", F.lag("end").over(order))
    return marked.where(F.col("start") < F.col("previous_end"))


def next_data(islands: DataFrame, keys: Sequence[str], offset: Column) -> DataFrame:
    """keys, data, hole: first byte held, and first not held, from ``offset``
    on. ``islands`` are coalesced."""
    inside = (F.col("start") <= offset) & (F.col("end") > offset)
    return islands.groupBy(*keys).agg(
        F.min(F.when(F.col("end") > offset, F.greatest("start", offset))).alias("data"),
        F.coalesce(F.max(F.when(inside, F.col("end"))), offset).alias("hole"),
    )


def clip(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Intervals that meet [low, high), cut to it."""
    met = rows.where((F.col("start") < high) & (F.col("end") > low))
    return met.withColumns({"start": F.greatest("start", low), "end": F.least("end", high)})


def _bucket(value: Column, bucket: int) -> Column:
    """The bucket that holds ``value``, in whole numbers."""
    return F.call_function("div", value - F.pmod(value, F.lit(bucket)), F.lit(bucket))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bucket: int) -> DataFrame:
    """Pairs of intervals of one key that overlap: left columns, right_start
    and right_end, and other right columns under right_<name>.

    Both sides are dealt to buckets of ``bucket`` units that they touch and
    meet by equality; a pair counts in the bucket where its overlap begins.
    """
    spread = lambda df: df.where("start < end").withColumn(
        "bucket_no", F.explode(F.sequence(_bucket(F.col("start"), bucket), _bucket(F.col("end") - 1, bucket)))
    )
    rest = [c for c in right.columns if c not in keys]
    other = spread(right).withColumnsRenamed({c: f"right_{c}" for c in rest})
    joined = spread(left).join(other, [*keys, "bucket_no"])
    met = (F.col("start") < F.col("right_end")) & (F.col("right_start") < F.col("end"))
    first = _bucket(F.greatest("start", "right_start"), bucket) == F.col("bucket_no")
    return joined.where(met & first).drop("bucket_no")
