"""Trees of names (OP-J01, OP-J14, OP-J17 to OP-J19, OP-P01, OP-O05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetquery.functions.text import path_depth

STAT_BLOCK = 512


def stat(inodes: DataFrame) -> DataFrame:
    blocks = F.when(F.col("kind") == "file", F.call_function("div", F.col("size") + (STAT_BLOCK - 1), F.lit(STAT_BLOCK))).otherwise(0).cast("long")
    return inodes.select("*", blocks.alias("blocks"))


def readdir(dentries: DataFrame, inodes: DataFrame) -> DataFrame:
    """parent, name, child, kind; children that are not there are left out,
    and each directory holds itself as ``.`` and its parent as ``..``."""
    kinds = inodes.select(F.col("id").alias("child"), "kind")
    listed = dentries.join(kinds, "child").select("parent", "name", "child", "kind")
    directories = inodes.where("kind = 'directory'").select(F.col("id").alias("parent"))
    up = dentries.groupBy(F.col("child").alias("parent")).agg(F.min("parent").alias("up"))
    dots = directories.join(up, "parent", "left").select("parent", F.coalesce("up", "parent").alias("up"))
    one = dots.select("parent", F.lit(".").alias("name"), F.col("parent").alias("child"), F.lit("directory").alias("kind"))
    two = dots.select("parent", F.lit("..").alias("name"), F.col("up").alias("child"), F.lit("directory").alias("kind"))
    return listed.unionByName(one).unionByName(two)


def parents(dentries: DataFrame) -> DataFrame:
    """child, parent: the least directory that holds it."""
    return dentries.groupBy("child").agg(F.min("parent").alias("parent"))


def paths(dentries: DataFrame, root: int) -> DataFrame:
    """id, path, depth of all that hangs below ``root``, by a recursive query.

    Levels are joined one after the other; a loop of names would not end, so
    an entry whose path already holds its id is not followed.
    """
    dentries.createOrReplaceTempView("fleetquery_dentries")
    return dentries.sparkSession.sql(f"""
        WITH RECURSIVE walk(id, path, depth, seen) MAX RECURSION LEVEL 4096 AS (
          SELECT CAST({root} AS BIGINT), CAST('' AS STRING), 0, array(CAST({root} AS BIGINT))
          UNION ALL
          SELECT CAST(d.child AS BIGINT), concat(w.path, '/', d.name), w.depth + 1,
                 array_append(w.seen, CAST(d.child AS BIGINT))
          FROM walk w JOIN fleetquery_dentries d ON d.parent = w.id
          WHERE NOT array_contains(w.seen, CAST(d.child AS BIGINT)))
        SELECT id, CASE WHEN depth = 0 THEN '/' ELSE path END AS path, depth, seen FROM walk
    """)


def below(dentries: DataFrame, ancestor: int) -> DataFrame:
    """ids that ``ancestor`` reaches, itself included (cycle guard of moves)."""
    return paths(dentries, ancestor).select("id").distinct()


def by_depth(rows: DataFrame, path: str) -> DataFrame:
    return rows.withColumn("depth", path_depth(F.col(path)).cast("int")).orderBy("depth", path)
