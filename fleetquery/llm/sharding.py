"""Contiguous balanced shards from global byte-size prefix sums (operator 6).

Rows stay in the order of doc_id. Each range of that order has its bytes
summed, the sums are accumulated, and a row's prefix sum is what the ranges
before it and the rows before it in its range hold. Shards are cut where the
prefix sum passes equal parts of the total, so each holds a contiguous run
and is off its target by no more than about one row. Law: ``bytes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetquery.llm.common import in_order, table

ROW_OVERHEAD = 16


def balanced_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, offset_bytes.

    A row's shard is the one in whose part of the total its middle byte lies.
    Size: bytes of the text in UTF-8 (null: none) plus 16. Rows with the same
    doc_id follow each other by checksum and size; a null doc_id comes first.
    No rows give no shards. Broadcast: a row for each range or shard.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = in_order(sized, ["doc_id", "text_crc32", "size"], ["size"], "sharding")
    total = placed.agg(F.max(F.col("before_size") + F.col("size")).alias("total"))
    rows = placed.join(F.broadcast(total)).withColumn(
        "shard", F.least(F.lit(shards - 1), F.expr(f"((2 * before_size + size) * {shards}) div (2 * total)")).cast("int")
    )
    firsts = rows.groupBy(F.col("shard").alias("first_shard")).agg(F.min("before_rows").alias("first_row"))
    rows = rows.join(F.broadcast(firsts), F.col("shard") == F.col("first_shard"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before_rows") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("before_size").cast("long").alias("offset_bytes"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"))


def _crc_table() -> list[int]:
    """The table of the reflected polynomial 0xEDB88320, by its rule."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return table


OP6_SQL = f"""
WITH k AS MATERIALIZED (SELECT {_crc_table()}::UINTEGER[] AS k),
b AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + {ROW_OVERHEAD} AS BIGINT) AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::UINTEGER) AS bytes
      FROM documents),
s AS (SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(4294967295::UINTEGER, bytes),
        lambda a, x: xor(a >> 8, k[xor(a, x) % 256 + 1])), 4294967295::UINTEGER) AS BIGINT) AS text_crc32 FROM b, k),
o AS (SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY doc_id, text_crc32, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(size) OVER () AS BIGINT) AS total FROM s),
p AS (SELECT *, CAST(least(39, ((2 * before + size) * 40) // (2 * total)) AS INT) AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS slot,
       CAST(NULL AS INT) AS grown_shard, before AS offset_bytes
FROM p
"""
