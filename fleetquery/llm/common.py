"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetquery.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, order: Sequence[str], weights: Sequence[str], what: str) -> DataFrame:
    """``df`` with each row's place in a global order, without a global task.

    Rows are range-partitioned and written with the number of their range;
    ranges are summed (one row each), the sums are accumulated over the
    ranges, and a window inside each range adds what comes before the row.
    Adds ``before_rows`` and ``before_<w>`` for each of ``weights``; what is
    broadcast has one row for each range.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).withColumn("range_no", F.spark_partition_id())
    ranged = written(ranged.sortWithinPartitions(*order), what)
    sums = {"rows": F.lit(1), **{w: F.col(w) for w in weights}}
    totals = ranged.groupBy("range_no").agg(*[F.sum(c).alias(f"total_{k}") for k, c in sums.items()])
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("range_no").alias("start_no"),
        *[F.coalesce(F.sum(f"total_{k}").over(earlier), F.lit(0)).alias(f"start_{k}") for k in sums],
    )
    inside = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"inside_{k}") for k, c in sums.items()])
    rows = rows.join(F.broadcast(starts), F.col("range_no") == F.col("start_no"))
    return rows.select(*df.columns, *[(F.col(f"start_{k}") + F.col(f"inside_{k}")).alias(f"before_{k}") for k in sums])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Elements of an array that ``scan`` takes together.
SCAN = 256


def scan(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """state and out after a walk over ``items`` in order.

    ``step`` takes the state and an item and gives the next state and an array
    of type ``kind`` to add to ``out``, or null. Additions are gathered by
    SCAN items, so that long arrays are not copied for each of them.
    """
    none, nones = F.from_json(F.lit("[]"), f"array<{kind}>"), F.from_json(F.lit("[]"), f"array<array<{kind}>>")

    def inner(held: Column, x: Column) -> Column:
        then, more = step(held["state"], x)
        out = F.when(more.isNotNull(), F.concat(held["out"], more)).otherwise(held["out"])
        return F.struct(then.alias("state"), out.alias("out"))

    def walk(own: Column) -> Column:
        def outer(held: Column, i: Column) -> Column:
            first = F.struct(held["state"].alias("state"), none.alias("out"))
            add = lambda d: F.struct(d["state"].alias("state"), F.concat(held["out"], F.array(d["out"])).alias("out"))
            return F.aggregate(F.slice(own, i * SCAN + 1, SCAN), first, inner, add)

        first = F.struct(state.alias("state"), nones.alias("out"))
        parts = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / SCAN).cast("int"))
        end = lambda held: F.struct(held["state"].alias("state"), F.flatten(held["out"]).alias("out"))
        empty = F.struct(state.alias("state"), none.alias("out"))
        return F.when(F.size(own) > 0, F.aggregate(parts, first, outer, end)).otherwise(empty)

    return let(items, walk)


def below(values: Column, key: Column) -> Column:
    """How many of the sorted ``values`` are at most ``key``: binary search."""
    most = F.floor(F.log2(F.size(values) + F.lit(1.0))).cast("int")
    steps = F.transform(F.sequence(most, F.lit(0), F.lit(-1)), lambda n: F.call_function("shiftleft", F.lit(1), n))

    def advance(at: Column, by: Column) -> Column:
        within = (at + by <= F.size(values)) & (F.get(values, at + by - 1) <= key)
        return F.when(F.coalesce(within, F.lit(False)), at + by).otherwise(at)

    return F.aggregate(steps, F.lit(0), advance)


def bit_of(position: Column, bitmap: Column) -> Column:
    """Bit ``position`` of a bitmap that ``bitmap_construct_agg`` has made."""
    place = position.cast("int")
    byte = F.hex(F.substring(bitmap, F.shiftright(place, 3) + 1, F.lit(1)))
    high = F.shiftright(place, 2).bitwiseAND(F.lit(1))  # which of the two digits
    digit = F.ascii(F.substring(byte, 2 - high, F.lit(1)))
    value = digit - F.when(digit > F.lit(57), 55).otherwise(48)  # 0 to 9, A to F
    return F.getbit(value, place.bitwiseAND(F.lit(3))) == 1


#: 2**23 bits hold 1 MB, and rows of 64 bytes make that 2 MB when broadcast.
FILTER_BITS = 23
_ROW_BYTES = 64


#: Most slots of a bitmap, as a power of 2: 16 MB when broadcast.
MOST_BITS = 26


def bits_for(keys: int) -> int:
    """Slots for a bitmap of ``keys`` keys, as a power of 2: sixteen or more a
    key, within bounds."""
    return min(max(keys.bit_length() + 4, 15), MOST_BITS)


def _slot(keys: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits)) + 1


def bitmap_of(rows: DataFrame, keys: list[str], bits: int = FILTER_BITS) -> DataFrame:
    """Bitmaps of the slots that the rows' keys hash to: of a fixed size,
    however many rows there are. They are cut into short rows, since a look at
    one bit copies its row."""
    slots = rows.select(_slot(keys, bits).alias("slot"))
    made = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")
    )
    each = 4096 // _ROW_BYTES  # a bitmap has 4096 bytes
    cut = made.select("*", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("n"))
    part = F.substring(F.col("bitmap"), F.col("n") * _ROW_BYTES + 1, F.lit(_ROW_BYTES))
    cut = cut.select((F.col("bucket") * each + F.col("n")).alias("fq_row"), part.alias("fq_bitmap"))
    return cut.where(F.col("fq_bitmap") != F.lit(bytes(_ROW_BYTES)))


def in_bitmap(rows: DataFrame, bitmaps: DataFrame, keys: list[str], name: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with a boolean ``name``: false if surely no row of
    ``bitmap_of`` has its keys."""
    slot, each = _slot(keys, bits), 4096 // _ROW_BYTES
    place = F.bitmap_bit_position(slot)
    row = F.bitmap_bucket_number(slot) * each + F.shiftright(place, 3 + (_ROW_BYTES.bit_length() - 1))
    marked = rows.join(F.broadcast(bitmaps), row == F.col("fq_row"), "left")
    found = F.coalesce(bit_of(place.bitwiseAND(F.lit(8 * _ROW_BYTES - 1)), F.col("fq_bitmap")), F.lit(False))
    return marked.select(*[rows[c] for c in rows.columns], found.alias(name))


#: Rows from which a key counts as hot, and the parts it is dealt to.
HOT_ROWS, HOT_PARTS = 500, 32


def join_groups(rows: DataFrame, key: str, groups: DataFrame, group_key: str, size: str) -> DataFrame:
    """``rows`` left-joined to ``groups`` (one row a key, ``size`` rows each).

    Keys of more than HOT_ROWS rows are dealt to HOT_PARTS parts: their group
    is repeated for each part and their rows spread over them at random by
    doc_id. Which keys are hot travels as a bitmap of fixed size; a key that
    shares a bit with a hot one is dealt in the same way on both sides.
    """
    hot = bitmap_of(groups.where(F.col(size) > HOT_ROWS).select(F.col(group_key).alias(key)), [key])
    left = in_bitmap(rows, hot, [key], "fq_hot")
    right = in_bitmap(groups.withColumn(key, F.col(group_key)), hot, [key], "fq_hot").drop(key)
    part = F.when(F.col("fq_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(HOT_PARTS))).otherwise(0)
    left = left.withColumn("fq_part", part.cast("int")).drop("fq_hot")
    parts = F.when(F.col("fq_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("fq_of_part", F.explode(parts)).drop("fq_hot")
    joined = left.join(right, (F.col(key) == F.col(group_key)) & (F.col("fq_part") == F.col("fq_of_part")), "left")
    return joined.drop("fq_part", "fq_of_part")
