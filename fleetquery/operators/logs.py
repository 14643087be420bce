"""Logs of records (OP-S02, OP-W01, OP-W02, OP-K04, OP-O03, OP-O04, OP-O07,
OP-A09 to OP-A11, OP-H17)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def record_hash(previous: str, body: str) -> str:
    return hashlib.sha256(f"{previous}{body}".encode()).hexdigest()


def _streamed(rows: DataFrame, key: str, order: Sequence[str], schema: str, begin: Callable, step: Callable) -> DataFrame:
    """Each key's rows in order through ``step(state, row) -> output row``.

    Tasks stream their sorted rows and hold one key's state, however long its
    log is; logs of different keys run side by side.
    """
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    spark_rows = rows.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Batches) -> Batches:
        at, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != at:
                    at, state = row[key], begin()
                if (made := step(state, row)) is not None:
                    out.append(made)
            if out:
                table = pa.Table.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)
                yield from table.combine_chunks().to_batches()

    kinds = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
    arrow = pa.schema([(f.strip().split(" ")[0], kinds[f.strip().split(" ")[1]]) for f in schema.split(",")])
    return spark_rows.mapInArrow(run, schema)


def verify_chain(log: DataFrame, key: str = "volume") -> DataFrame:
    """key, seq, valid of each record of (key, seq, body, previous, hash).

    A record is valid if its hash is right and its ``previous`` is the hash of
    the last valid record. One that is not leaves that hash as it was. Records
    without a hash are of an old kind: valid, and they leave it too.
    """

    def step(state: dict, row: dict) -> tuple:
        if not row["hash"]:
            return row[key], row["seq"], True
        valid = row["previous"] == state["hash"] and record_hash(row["previous"], row["body"]) == row["hash"]
        if valid:
            state["hash"] = row["hash"]
        return row[key], row["seq"], valid

    kind = dict(log.dtypes)[key]
    return _streamed(log, key, ["seq"], f"{key} {kind}, seq long, valid boolean", lambda: {"hash": ""}, step)


def _apply(document: object, op: dict) -> object:
    """One add, replace or remove at a JSON pointer."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in op["path"].split("/")[1:]]
    if not steps:
        return op.get("value")
    at = document
    for s in steps[:-1]:
        at = at[int(s)] if isinstance(at, list) else at[s]
    last = steps[-1]
    if isinstance(at, list):
        if op["op"] == "add":
            at.insert(len(at) if last == "-" else int(last), op["value"])
        elif op["op"] == "replace":
            at[int(last)] = op["value"]
        else:
            del at[int(last)]
    elif op["op"] == "remove":
        del at[last]
    elif op["op"] == "replace" and last not in at:
        raise KeyError(last)
    else:
        at[last] = op["value"]
    return document


def replay(log: DataFrame, key: str = "volume") -> DataFrame:
    """key, seq, applied, state: the document after each record of (key, seq,
    snapshot, delta). A snapshot is a whole document in JSON, a delta an array
    of operations; after a delta that fails, records are passed over until the
    next snapshot."""

    def step(state: dict, row: dict) -> tuple:
        applied = False
        if row["snapshot"]:
            state["document"], state["live"], applied = row["snapshot"], True, True
        elif state["live"]:
            try:
                document = json.loads(state["document"])
                for op in json.loads(row["delta"] or "[]"):
                    document = _apply(document, op)
                state["document"], applied = json.dumps(document, sort_keys=True), True
            except (KeyError, IndexError, ValueError, TypeError):
                state["live"] = False
        return row[key], row["seq"], applied, state["document"]

    kind = dict(log.dtypes)[key]
    begin = lambda: {"document": None, "live": False}
    return _streamed(log, key, ["seq"], f"{key} {kind}, seq long, applied boolean, state string", begin, step)


def last_writes(log: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """keys and the last value: what replay leaves when no record fails."""
    return log.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def compact(log: DataFrame, key: str, is_checkpoint: str, order: Sequence[str]) -> DataFrame:
    """Records from each key's last checkpoint on; all if it has none."""
    place = F.struct(*order)
    last = log.where(is_checkpoint).groupBy(F.col(key).alias("of_key")).agg(F.max(place).alias("from_here"))
    rows = log.join(last, F.col(key) == F.col("of_key"), "left")
    return rows.where(F.col("from_here").isNull() | (place >= F.col("from_here"))).select(*log.columns)


def quorum(candidates: DataFrame, group: Sequence[str], version: Sequence[str], member: str, members: int) -> DataFrame:
    """The newest version of each group that a majority of members holds."""
    need = max(members, 1) // 2 + 1
    held = candidates.groupBy(*group, *version).agg(F.count_distinct(member).alias("votes"))
    newest = F.max(F.struct(*version, "votes")).alias("best")
    return held.where(F.col("votes") >= need).groupBy(*group).agg(newest).select(*group, "best.*")


def double_write_mismatches(copies: DataFrame, group: Sequence[str]) -> DataFrame:
    """Invalid copies, other hashes than one, and one more if none is valid."""
    valid = F.col("present") & F.col("valid")
    sums = copies.groupBy(*group).agg(
        F.count_if(F.col("present") & ~F.col("valid")).alias("invalid"),
        F.count_distinct(F.when(valid, F.col("hash"))).alias("hashes"),
        F.count_if(F.col("present")).alias("present"),
    )
    none_valid = F.when((F.col("present") > 0) & (F.col("hashes") == 0), 1).otherwise(0)
    other = F.greatest(F.col("hashes") - 1, F.lit(0))
    return sums.select(*group, (F.col("invalid") + other + none_valid).cast("long").alias("mismatches"))


def latest(candidates: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row of each group that is greatest by ``order``."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("best")
    return candidates.groupBy(*group).agg(best).select(*group, "best.*")


def head_quorum(members: DataFrame, group: Sequence[str], head: Sequence[str]) -> DataFrame:
    """group, quorum: whether a majority of all members, of those that are
    readable and have no invalid entry, has the same head. ``members`` has one
    row a member; a group without rows is not listed."""
    sound = F.col("readable") & (F.col("invalid_entries") == 0)
    heads = members.groupBy(*group, *head).agg(F.count("*").alias("rows"), F.count_if(sound).alias("held"))
    majority = F.call_function("div", F.sum("rows"), F.lit(2)) + 1
    return heads.groupBy(*group).agg((F.max("held") >= majority).alias("quorum"))
