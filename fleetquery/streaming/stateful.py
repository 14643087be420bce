"""Per-device state over streams of samples (OP-T04, OP-T06, OP-W03, OP-W06,
OP-W12, OP-T08, OP-K10)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_ewma(samples: DataFrame, alpha: float = 0.2) -> DataFrame:
    """key, samples, ewma after each micro-batch, of (key, at, tie, value).

    State is two numbers a key. Samples of a batch are ordered by (at, tie);
    a sample that arrives in a later batch counts as later. A state of 0 or
    less starts anew with the next sample.
    """

    def update(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, ewma = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["at", "tie"], kind="stable")
        for x in rows["value"]:
            ewma = x if ewma <= 0 else ewma * (1 - alpha) + x * alpha
        count += len(rows)
        state.update((count, float(ewma)))
        yield pd.DataFrame({"key": [key[0]], "samples": [count], "ewma": [float(ewma)]})

    return samples.groupBy("key").applyInPandasWithState(
        update, "key long, samples long, ewma double", "samples long, ewma double", "update", GroupStateTimeout.NoTimeout
    )


def stream_streaks(reports: DataFrame) -> DataFrame:
    """key, risk_streak, healthy_streak after each micro-batch, of (key, at,
    tie, risky): two healthy reports in a row clear the risk."""

    def update(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        risk, healthy = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["at", "tie"], kind="stable")
        for risky in rows["risky"]:
            risk, healthy = (risk + 1, 0) if risky else (0 if healthy >= 1 else risk, healthy + 1)
        state.update((risk, healthy))
        yield pd.DataFrame({"key": [key[0]], "risk_streak": [risk], "healthy_streak": [healthy]})

    return reports.groupBy("key").applyInPandasWithState(
        update, "key long, risk_streak long, healthy_streak long", "risk long, healthy long", "update", GroupStateTimeout.NoTimeout
    )


def stream_group_commit(writes: DataFrame, size: int = 128, wait_ms: int = 5000) -> DataFrame:
    """key, commit_no, writes: a commit for every ``size`` writes, and for the
    rest when ``wait_ms`` of processing time pass without reaching it."""

    def update(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, waiting = state.get if state.exists else (0, 0)
        sizes = []
        if state.hasTimedOut:
            sizes, waiting = [waiting], 0
        else:
            waiting += sum(len(b) for b in batches)
            while waiting >= size:
                sizes.append(size)
                waiting -= size
        numbers = [number + n for n in range(len(sizes))]
        state.update((number + len(sizes), waiting))
        if waiting:
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame({"key": [key[0]] * len(sizes), "commit_no": numbers, "writes": sizes})

    return writes.groupBy("key").applyInPandasWithState(
        update, "key long, commit_no long, writes long", "number long, waiting long", "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def merged_writes(writes: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Extents of one key's writes in order: a write that touches or overlaps
    the open extent joins it while it stays within ``limit`` bytes."""
    out: list[list[int]] = []
    for start, end in zip(writes["start"], writes["end"]):
        if out and start <= out[-1][1] and end >= out[-1][0] and max(end, out[-1][1]) - min(start, out[-1][0]) <= limit:
            out[-1] = [min(start, out[-1][0]), max(end, out[-1][1]), out[-1][2] + 1]
        else:
            out.append([start, end, 1])
    return pd.DataFrame(out, columns=["start", "end", "writes"])


def stream_merged_writes(writes: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """key, start, end, writes: the write-back extents that are closed by a
    write that does not join them; the open one waits in the state."""

    def update(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "tie"], kind="stable")[["start", "end"]]
        counts = 0
        if state.exists:
            start, end, counts = state.get
            rows = pd.concat([pd.DataFrame({"start": [start], "end": [end]}), rows])
        found = merged_writes(rows, limit)
        if counts:
            found.loc[0, "writes"] += counts - 1
        last = found.iloc[-1]
        state.update((int(last["start"]), int(last["end"]), int(last["writes"])))
        yield found.iloc[:-1].assign(key=key[0])[["key", "start", "end", "writes"]]

    return writes.groupBy("key").applyInPandasWithState(
        update, "key long, start long, end long, writes long", "start long, end long, writes long", "append", GroupStateTimeout.NoTimeout
    )


def windowed_latency(samples: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Spark-native extra: mean and maximum by tumbling window and kind."""
    late = samples.withWatermark("ts", lateness).groupBy(F.window("ts", width), "kind")
    found = late.agg(F.count("*").alias("samples"), F.avg("value").alias("mean"), F.max("value").alias("worst"))
    return found.select(F.col("window.start").alias("start"), "kind", "samples", "mean", "worst")


def each_batch(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Runs what is there now through ``write``, batch by batch (metrics, audit)."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda df, _: write(df)).start()
