"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetquery.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of ``edges``.

    ``edges``: src, dst (long). Alternates two steps until nothing changes:
    each node hands the least of its neighbours first to its larger, then to
    its smaller ones, which turns every component into a star around its
    least node in a number of rounds that grows with the logarithm of its
    size. Each step is an aggregation and a join, never a list of neighbours;
    each round is written to the shared folder.
    """
    now = edges.select(F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high"))
    now = written(now.where("low < high").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(low, high))")).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
                now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
            )
        seen = mark
        both = now.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
            now.select(F.col("high").alias("u"), F.col("low").alias("v"))
        )
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high"))
        large = large.where("low < high").distinct()
        large = written(large, "edges")
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a < b")
        now = written(small.select(F.col("a").alias("low"), F.col("b").alias("high")).distinct(), "edges")
