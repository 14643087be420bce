"""References, differences and damage (OP-J01 to OP-J08, OP-J13, OP-J20 to
OP-J22, OP-A14, OP-X01 to OP-X08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dangling(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows that name a parent which is not there."""
    return children.join(parents.select(F.col(parent_key).alias("there")), F.col(key) == F.col("there"), "left_anti")


def unreferenced(stored: DataFrame, referenced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows that nothing refers to."""
    return stored.join(referenced.select(*keys).distinct(), list(keys), "left_anti")


def damage_class(
    disk_there: Column, status: Column, slot_ok: Column, file_there: Column, hash_ok: Column, unavailable: Sequence[str]
) -> Column:
    """First failure that a shard shows; ``ok`` if none."""
    return (
        F.when(~slot_ok, "invalid-slot")
        .when(~disk_there, "missing-disk")
        .when(status.isin(*unavailable), "unavailable")
        .when(~file_there, "missing")
        .when(~hash_ok, "checksum")
        .otherwise("ok")
    )


def page_delta(old: DataFrame, new: DataFrame, keys: Sequence[str], body: str) -> DataFrame:
    """keys, op: put for new or changed rows, delete for vanished ones."""
    a, b = old.select(*keys, F.col(body).alias("was")), new.select(*keys, F.col(body).alias("now"))
    joined = a.join(b, list(keys), "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return joined.select(*keys, F.when(F.col("now").isNull(), "delete").otherwise("put").alias("op"))


def tree_compare(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, verdict: missing (right lacks it), extra, or the first differing field."""
    a = left.select(key, F.struct(*fields).alias("a"))
    b = right.select(key, F.struct(*fields).alias("b"))
    joined = a.join(b, key, "full_outer")
    verdict = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra")
    for f in fields:
        verdict = verdict.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f)
    return joined.select(key, verdict.alias("verdict")).where("verdict is not null")


def flat_json_delta(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pointer, op, value between two tables of (keys, pointer, value)."""
    on = [*keys, "pointer"]
    joined = old.withColumnRenamed("value", "was").join(new.withColumnRenamed("value", "now"), on, "full_outer")
    op = F.when(F.col("now").isNull(), "remove").when(F.col("was").isNull(), "add").otherwise("replace")
    return joined.where(~F.col("was").eqNullSafe(F.col("now"))).select(*on, op.alias("op"), F.col("now").alias("value"))


def linked_groups(entries: DataFrame, identity: str, name: str) -> DataFrame:
    """identity, links, first_name of identities with more than one name."""
    groups = entries.groupBy(identity).agg(F.count("*").alias("links"), F.min(name).alias("first_name"))
    return groups.where("links > 1")


def covering(pairs: DataFrame, holder: str, item: str) -> DataFrame:
    """Holders of every item that occurs (relational division). What is
    broadcast is one number."""
    needed = pairs.agg(F.count_distinct(item).alias("needed"))
    held = pairs.groupBy(holder).agg(F.count_distinct(item).alias("held"))
    return held.join(F.broadcast(needed), F.col("held") == F.col("needed")).select(holder, "held")


def reassembled(core: DataFrame, key: str, pages: DataFrame, page: str, items: str) -> DataFrame:
    """``core`` with the items of its pages in order; rows without pages get
    an empty array. Pages are bounded in size and few for each key."""
    gathered = pages.groupBy(F.col(key).alias("of_key")).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(page, items))), lambda p: p[items])).alias("all_items")
    )
    joined = core.join(gathered, F.col(key) == F.col("of_key"), "left")
    return joined.select(core["*"], F.coalesce("all_items", F.array().cast(pages.schema[items].dataType)).alias("items"))


def paged(rows: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """``rows`` with page and slot: fixed-size pages in order within a key."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("slot", (rn % size).cast("int")).withColumn("page", F.floor(rn / size).cast("long"))


def duplicated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: an aggregate, so hot keys combine early."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    ordered = [*order, *rest]
    return rows.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("first")).select(*keys, "first.*").select(*rows.columns)


def encrypted_blocks(blocks: DataFrame, encrypted: Column) -> DataFrame:
    """How many blocks are encrypted, of how many (OP-F06)."""
    return blocks.agg(F.count_if(encrypted).alias("encrypted"), F.count("*").alias("blocks"))


def source_layouts(blocks: DataFrame, layout: str, target: str) -> DataFrame:
    """Layouts that blocks move away from, in order of name (OP-A17)."""
    return blocks.where(F.col(layout) != target).select(layout).distinct().orderBy(layout)


def either(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that stand in one of two tables or in both, once (OP-X02)."""
    return left.unionByName(right).distinct()
