"""Changes as events, and the state that they leave (OP-M01 to OP-M13, OP-P03,
OP-P05, OP-F05 to OP-F07, OP-F10, OP-J05, OP-J17).

Nothing is updated in place: a table and its events give the next table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetquery.functions.text import clean_path, parent_path
from fleetquery.session import shared_path


def upserted(base: DataFrame, events: DataFrame, keys: Sequence[str], order: str, deleted: str) -> DataFrame:
    """``base`` after ``events``: the last event of a key says what its row is,
    or, where ``deleted`` is true, that there is none. Events have the columns
    of ``base``, ``order`` and ``deleted``."""
    rest = [c for c in base.columns if c not in keys]
    old = base.select(*keys, *rest, F.lit(None).cast(dict(events.dtypes)[order]).alias(order), F.lit(False).alias(deleted))
    every = old.unionByName(events.select(*old.columns))
    # nulls order first, so any event comes after the row it changes
    last = every.groupBy(*keys).agg(F.max_by(F.struct(*rest, deleted), F.struct(F.col(order).isNotNull(), order)).alias("last"))
    return last.where(~F.col(f"last.{deleted}")).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def link_counts(inodes: DataFrame, dentries: DataFrame, roots: Sequence[int] = (1,)) -> DataFrame:
    """id, kind, nlink, live: directories count themselves and their
    subdirectories; what nothing names, roots apart, is to be reaped."""
    names = dentries.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("names"))
    kinds = inodes.select(F.col("id").alias("child"), F.col("kind").alias("child_kind"))
    subs = dentries.join(kinds, "child").where("child_kind = 'directory'")
    subs = subs.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("subs"))
    rows = inodes.select("id", "kind").join(names, "id", "left").join(subs, "id", "left").fillna(0, ["names", "subs"])
    live = (F.col("names") > 0) | F.col("id").isin(*roots)
    nlink = F.when(F.col("kind") == "directory", F.lit(2) + F.col("subs")).otherwise(F.col("names"))
    return rows.select("id", "kind", F.when(live, nlink).otherwise(0).cast("long").alias("nlink"), live.alias("live"))


def blocks_after_write(blocks: DataFrame, writes: DataFrame, key: str, width: int) -> DataFrame:
    """Blocks that stay when windows of a file are written anew, and the
    stripe-aligned windows in place of the others: key, start, end, kept."""
    window = writes.select(
        key,
        (F.floor(F.col("start") / width) * width).alias("w_start"),
        (F.ceil(F.col("end") / width) * width).alias("w_end"),
    )
    met = (blocks[key] == window[key]) & (F.col("start") < F.col("w_end")) & (F.col("end") > F.col("w_start"))
    kept = blocks.join(window, met, "left_anti").select(key, "start", "end", F.lit(True).alias("kept"))
    new = window.select(key, F.col("w_start").alias("start"), F.col("w_end").alias("end"), F.lit(False).alias("kept"))
    return kept.unionByName(new)


def drainable(disks: DataFrame, width: int) -> DataFrame:
    """id, drainable: the online disks without it still hold a stripe."""
    online = disks.agg(F.count_if(F.col("status") == "online").alias("online"))
    others = F.col("online") - (F.col("status") == "online").cast("int")
    return disks.join(F.broadcast(online)).select("id", (others >= width).alias("drainable"))


def with_present_paths(disks: DataFrame, scanned: DataFrame) -> DataFrame:
    """``disks`` at the paths where a scan found them; others are offline,
    unless they were removed."""
    found = scanned.select(F.col("id").alias("found_id"), F.col("path").alias("found_path"))
    rows = disks.join(found, F.col("id") == F.col("found_id"), "left")
    lost = F.col("found_path").isNull() & (F.col("status") != "removed")
    return rows.withColumns(
        {"path": F.coalesce("found_path", "path"), "status": F.when(lost, "offline").otherwise(F.col("status"))}
    ).select(*disks.columns)


def layout_id(column: Column) -> Column:
    """Blocks from before layouts had names belong to the first."""
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("layout-0000"))


def optional(rows: DataFrame, column: str, value: object | None) -> DataFrame:
    """Rows of one value, or all without one."""
    return rows if value is None else rows.where(F.col(column) == F.lit(value))


def under(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.where(F.col(column).startswith(prefix))


def moves_allowed(moves: DataFrame, paths: DataFrame) -> DataFrame:
    """``moves`` (child, new_parent) with allowed: a directory does not move
    below itself. ``paths``: id and seen, the ids on its way from the root."""
    up = paths.select(F.col("id").alias("new_parent"), "seen")
    joined = moves.join(up, "new_parent", "left")
    fine = F.col("seen").isNotNull() & ~F.array_contains("seen", F.col("child"))
    return joined.select(*moves.columns, F.coalesce(fine, F.lit(False)).alias("allowed"))


def resolved(requests: DataFrame, nodes: DataFrame, limit: int = 40) -> DataFrame:
    """``requests`` (path) with resolved and id: symlinks on the way are
    followed, the first one first; null if there is no such node or ``limit``
    links did not lead to one. ``nodes``: path, id, target (null: no link).

    A round follows one link of every request at once; rounds go on while any
    request still has one, and each is written to the shared folder.
    """
    spark = requests.sparkSession
    links = nodes.where("target is not null").select(F.col("path").alias("link"), "target")
    rows = requests.select("path").distinct().select("path", clean_path(F.col("path")).alias("now"))
    for _ in range(limit):
        steps = F.filter(F.split("now", "/"), lambda p: p != "")
        prefix = F.explode(
            F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, n), "/")))
        )
        met = rows.where("now <> '/'").select("path", "now", prefix.alias("link")).join(links, "link")
        first = met.groupBy("path", "now").agg(F.min_by(F.struct("link", "target"), F.length("link")).alias("l"))
        rest = F.substring(F.col("now"), F.length("l.link") + 1, F.length("now"))
        base = F.when(F.col("l.target").startswith("/"), "").otherwise(F.concat(parent_path(F.col("l.link")), F.lit("/")))
        stepped = first.select("path", clean_path(F.concat(base, "l.target", rest)).alias("then"))
        out = shared_path(spark, "resolve")
        rows.join(stepped, "path", "left").select("path", F.coalesce("then", "now").alias("now"), F.col("then").isNotNull().alias("moved")).write.parquet(out)
        done = spark.read.schema("path string, now string, moved boolean").parquet(out)
        rows = done.select("path", "now")
        if done.where("moved").isEmpty():
            break
    ends = nodes.where("target is null").select(F.col("path").alias("end"), "id")
    found = rows.join(ends, F.col("now") == F.col("end"), "left")
    return found.select("path", F.when(F.col("id").isNotNull(), F.col("now")).alias("resolved"), "id")
