"""Best-fit packing planned over a histogram of lengths (operator 9).

Pieces are at most as long as a sequence, so their lengths form a histogram of
bounded size. Best fit decreasing runs over its counts on the driver, with
open sequences held as runs of equal room; it yields a plan of runs, each of
which says where the pieces of a length take their places from a rank on.
Pieces then find their run by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetquery.llm.common import table, written
from fleetquery.llm.token_store import id_lists
from fleetquery.llm.tokens import in_blocks, library_encoder

SEQUENCE = 2048
PAD_ID = 0


@dataclass(frozen=True)
class Run:
    """``count`` pieces of ``length`` from ``rank`` on fill sequences from
    ``first`` on, ``each`` to a sequence, beginning at ``offset`` in it."""

    length: int
    rank: int
    count: int
    first: int
    each: int
    offset: int


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[Run]:
    """Best fit decreasing over counts. The number of runs depends on the
    lengths that occur, of which there are ``size`` at most, not on counts."""
    runs: list[Run] = []
    rooms: list[int] = []  # the different rooms of open sequences, ascending
    open_at: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)
    made = 0

    def leave(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_at:
                insort(rooms, room)
            open_at.setdefault(room, []).append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, rest = 0, histogram[length]
        while rest:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
            else:
                room, first, count = size, made, -(-rest // (size // length))
                made += count
            each = room // length
            take = min(rest, count * each)
            full, part = divmod(take, each)
            runs.append(Run(length, rank, take, first, each, size - room))
            leave(room - each * length, first, full)
            if part:
                leave(room - part * length, first + full, 1)
            leave(room, first + full + bool(part), count - full - bool(part))
            rank, rest = rank + take, rest - take
    return runs


def pieces(docs: DataFrame, tokenizer: str, pad_id: int = PAD_ID, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids if asked for) of every row.

    A null text counts as empty: its one piece is the closing id alone.
    """
    end = np.array([pad_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} {'int' if n == 'piece' else 'long'}" for n in names[:5]) + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        for batch in batches:
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in in_blocks(batch.column("text").to_pylist()):
                rows, cut = [], []
                for doc_id, ids in zip(doc_ids[at:], encoder.encode(texts)):
                    ids += end
                    for n, start in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[start : start + 4 * size]
                        rows.append((doc_id, n, start // 4, len(part) // 4, zlib.crc32(part)))
                        if with_ids:
                            cut.append(part)
                at += len(texts)
                kinds = [pa.int32() if n == "piece" else pa.int64() for n in names[:5]]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns + [id_lists(cut)] * with_ids, names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def ranked(cut: DataFrame, what: str) -> DataFrame:
    """``cut`` with ``rank``: a number for each row among those of its length.

    Ranks are gapless from 0. The rows are written with the number of their
    task; rows are counted by task and length, the counts accumulate over the
    tasks, and a window numbers the rows of one task and length only, so a
    length that a third of all pieces share is still dealt to many tasks.
    """
    rows = written(cut.withColumn("task", F.spark_partition_id()), what)
    counts = rows.groupBy("length", "task").count()
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("length").alias("of_length"),
        F.col("task").alias("of_task"),
        F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("rank_start"),
    )
    inside = Window.partitionBy("length", "task").orderBy("doc_id", "piece", "ids_crc32")
    rows = rows.withColumn("inside", F.row_number().over(inside) - 1)
    rows = rows.join(starts, (F.col("length") == F.col("of_length")) & (F.col("task") == F.col("of_task")))
    return rows.select(*cut.columns, (F.col("rank_start") + F.col("inside")).alias("rank"))


def pack(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """``cut`` (of ``pieces``) with sequence_id and offset.

    What comes to the driver is the histogram, ``size`` rows at most; what
    goes to the tasks is the plan, whose length that bounds.
    """
    rows = ranked(cut, "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    runs = sorted(plan(histogram, size), key=lambda r: (r.length, r.rank))
    columns_of = ("length", "rank", "first", "each", "offset")
    planned = {n: np.array([getattr(r, n) for r in runs], np.int64) for n in columns_of}
    held = cut.sparkSession.sparkContext.broadcast(planned)
    out = [*cut.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = held.value
        starts = np.searchsorted(table_of["length"], np.arange(size + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own, a, b = length == n, starts[n], starts[n + 1]
                run[own] = a + np.searchsorted(table_of["rank"][a:b], rank[own], "right") - 1
            inner, each = rank - table_of["rank"][run], table_of["each"][run]
            sequence = table_of["first"][run] + inner // each
            offset = table_of["offset"][run] + inner % each * length
            columns = [c for n, c in zip(batch.schema.names, batch.columns) if n != "rank"]
            columns += [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, out)

    fields = ", ".join(f"{n} {t}" for n, t in cut.dtypes)
    return rows.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
