"""Token ids in ORC files (operator 1).

Each document is one row: its id, the number of its tokens and the ids, which
ORC keeps as run-length encoded integers in stripes. Files are written in
ascending order of doc_id with row indexes and a Bloom filter on doc_id, so a
reader takes any stripe alone, and a search for documents skips files, stripes
and row groups by their minima, maxima and filters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetquery.llm.common import partitions, shared_path, table, written
from fleetquery.llm.tokens import in_blocks, library_encoder

END_ID = 2
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def id_lists(ids: list[bytes]) -> pa.ListArray:
    """Packed ids of each row as an Arrow array of lists."""
    values = np.frombuffer(b"".join(ids), np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), pa.array(values))


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, ids of every row in its order; ``end_id`` closes each."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        for batch in batches:
            at = 0
            for texts in in_blocks(batch.column("text").to_pylist()):
                ids = [x + end for x in encoder.encode(texts)]
                part = batch.column("doc_id").slice(at, len(ids))
                at += len(ids)
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part, counts, id_lists(ids)], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes ``docs`` (doc_id, text) to ORC files under ``path``.

    Null texts count as empty and hold the end id alone; rows that share a
    doc_id follow each other by the text's checksum; an empty table gives
    files without rows. Ranges are cut and sorted before encoding, as texts.
    """
    ranged = docs.select("doc_id", "text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("tie"))
    ranged = ranged.repartitionByRange(partitions(docs.sparkSession), "doc_id", "tie")
    ranged = ranged.sortWithinPartitions("doc_id", "tie")
    encoded(ranged, tokenizer, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids; with ``doc_ids`` only theirs, by pushed filters."""
    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents under ``path``.

    ``start``: ids of all documents before it. Files are in order by number;
    their totals, one row a file, are accumulated and broadcast. Rows that share
    a doc_id count in the order of n_tokens and checksum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            parts = [values[a:b] for a, b in zip(ends, ends[1:])]
            columns = [
                batch.column("file"),
                batch.column("doc_id"),
                pa.array([len(x) for x in parts], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["file", "doc_id", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "ids")
    rows = written(rows.mapInArrow(run, "file string, doc_id long, n_tokens long, ids_crc32 long"), "token-index")
    earlier = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")  # names sort wrongly from 100,000 files on
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("held")).withColumn("number", number)
    files = files.select("file", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("file_start"))
    inside = Window.partitionBy("file").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    rows = rows.join(F.broadcast(files), "file")
    return rows.select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_index(spark, path)
