"""Exact deduplication by progressive refinement (operator 3, native).

Rows are grouped by byte length, rows of repeated lengths by the hash of a
short prefix, and only rows that still share a group have their whole text
hashed. Which lengths and prefixes repeat is kept in bitmaps of a fixed
number of bits, so what is broadcast has a size that no corpus changes; two
groups that meet in one bit cost a needless hash, never a wrong answer. Each
bitmap and the groups are written once: what reads them would otherwise repeat
all steps before them, and the plan would double with every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetquery.llm.common import FILTER_BITS, bitmap_of, in_bitmap, join_groups, table, written

PREFIX_CHARS = 64


def repeated_keys(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Bitmaps of the keys that at least two rows hold."""
    return bitmap_of(rows.groupBy(*keys).count().where("count > 1"), keys, bits)


def refine(docs: DataFrame, bits: int = FILTER_BITS, prefix_chars: int = PREFIX_CHARS) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``fq_suspect``, and the groups of equal texts.

    Groups: fq_digest (SHA-256 of the text), fq_keep (largest doc_id),
    fq_size, fq_ties (rows that share that doc_id); groups of one are left out.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumn("fq_bytes", F.octet_length(text).cast("long")).withColumn(
        "fq_prefix", F.xxhash64(F.substring(text, 1, prefix_chars))
    )
    lengths = written(repeated_keys(keyed, ["fq_bytes"], bits), "exact-lengths")
    keyed = in_bitmap(keyed, lengths, ["fq_bytes"], "fq_same_length", bits)
    keys = ["fq_bytes", "fq_prefix"]
    prefixes = written(repeated_keys(keyed.where("fq_same_length"), keys, bits), "exact-prefixes")
    keyed = in_bitmap(keyed, prefixes, keys, "fq_same_prefix", bits)
    marked = keyed.withColumn("fq_suspect", F.col("fq_same_length") & F.col("fq_same_prefix"))
    marked = marked.select(*docs.columns, "fq_suspect")
    suspects = marked.where("fq_suspect").select("doc_id", F.sha2(text, 256).alias("fq_digest"))
    per_id = suspects.groupBy("fq_digest", "doc_id").count()
    groups = per_id.groupBy("fq_digest").agg(
        F.max(F.struct("doc_id", "count")).alias("last"), F.sum("count").alias("fq_size")
    )
    groups = groups.where("fq_size > 1").select(
        "fq_digest", F.col("last.doc_id").alias("fq_keep"), "fq_size", F.col("last.count").alias("fq_ties")
    )
    return marked, written(groups, "exact-groups")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept,
    text_sha256, refined (whether it came to hashing the whole text to decide).

    A null text counts as empty. The largest doc_id of equal texts stays; rows
    that repeat both doc_id and text are one document and all say so. An empty
    table gives an empty result; further columns are ignored.
    """
    marked, groups = refine(docs.select("doc_id", "text"))
    rows = marked.select("doc_id", "fq_suspect", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    rows = join_groups(rows, "text_sha256", groups, "fq_digest", "fq_size")
    keep = F.coalesce("fq_keep", "doc_id")
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("fq_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
        F.col("fq_suspect").alias("refined"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: that of the largest
    doc_id (any one of rows that repeat it). All columns stay as they are."""
    marked, groups = refine(docs)
    lone = marked.where(~F.col("fq_suspect")).select(*docs.columns)
    rows = marked.where("fq_suspect").withColumn("fq_own", F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = join_groups(rows, "fq_own", groups, "fq_digest", "fq_size")
    stays = rows.where(F.col("fq_digest").isNull() | F.col("fq_keep").eqNullSafe(F.col("doc_id")))
    single = stays.where(F.coalesce("fq_ties", F.lit(1)) == 1).select(*docs.columns)
    tied = stays.where("fq_ties > 1").dropDuplicates(["fq_digest"]).select(*docs.columns)
    return lone.unionByName(single).unionByName(tied)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256,
       (n_len > 1 AND n_pre > 1) AS refined
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
             max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
             count(*) OVER (PARTITION BY strlen(coalesce(text, ''))) AS n_len,
             count(*) OVER (PARTITION BY strlen(coalesce(text, '')), left(coalesce(text, ''), 64)) AS n_pre
      FROM documents)
"""
