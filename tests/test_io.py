"""Sources, sinks and streams on small files."""

import hashlib
import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetquery.sources import experiments, files, journal, sinks, smart
from fleetquery.streaming import stateful


def test_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.bin").write_bytes(b"12345")
    (tmp_path / "a/b/y.bin").write_bytes(b"67")
    root = f"file://{tmp_path}/a"
    assert {(r.relpath, r.size) for r in files.listing(spark, root).collect()} == {("x.bin", 5), ("b/y.bin", 2)}
    assert files.directory_size(spark, root).first().bytes == 7
    assert {r.hash for r in files.hashed(spark, root, "x*").collect()} == {hashlib.sha256(b"12345").hexdigest()}
    plan = files.listing(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_metadata_copies(spark, tmp_path):
    body = "{}"
    good = {"uuid": "u", "txid": 3, "generation": 1, "body": body, "meta_hash": hashlib.sha256(body.encode()).hexdigest()}
    (tmp_path / "one.json").write_text(json.dumps(good))
    (tmp_path / "two.json").write_text(json.dumps({**good, "meta_hash": "0"}))
    (tmp_path / "three.json").write_text("{broken")
    rows = {r.source: r for r in journal.metadata_copies(spark, [f"file://{tmp_path}/{n}.json" for n in ("one", "two", "three")]).collect()}
    assert rows["one.json"].valid and not rows["two.json"].valid and not rows["three.json"].valid
    assert rows["three.json"].error == "{broken"


def test_journal(spark, tmp_path):
    lines = [json.dumps({"record_type": "tx", "txid": 1, "action": "a"}), "{oops", "", json.dumps({"record_type": "tx", "txid": 2})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    rows = journal.journal(spark, f"file://{tmp_path}/log.jsonl").collect()
    assert sorted((r.seq or 0, r.ok) for r in rows) == [(0, False), (1, True), (2, True)]


def test_smart(spark):
    nvme = {"smart_status": {"passed": False}, "nvme_smart_health_information_log": {"percentage_used": 7, "media_errors": 3, "temperature": 40}}
    ata = {"temperature": {"current": 33}, "ata_smart_attributes": {"table": [{"id": 5, "raw": {"value": 9}}, {"id": 5, "raw": {"value": 4}}, {"id": 197, "raw": {"value": 1}}]}}
    df = spark.createDataFrame([(1, json.dumps(nvme)), (2, json.dumps(ata)), (3, "{}")], "id int, text string")
    rows = {r.id: r for r in smart.counters(df, "text").collect()}
    assert (rows[1].io_errors, rows[1].wear_percent, rows[1].temperature_c) == (100, 7.0, 40.0)
    assert (rows[2].reallocated_sectors, rows[2].pending_sectors, rows[2].temperature_c) == (9, 1, 33.0)
    assert rows[2].missing == ["wear_percent", "crc_errors", "io_errors"] and rows[3].missing == list(smart.EXPECTED)


def test_policy():
    policy = experiments.Policy.load('{"mode": "safe", "max_read_mib_s": 4.5, "pinned_paths": ["/boot"]}')
    assert policy.pinned_paths == ("/boot",)
    for bad in ('{"mode": "wild"}', '{"target_foreground_ms": 0}', '{"max_read_mib_s": -1}', '{"pinned_paths": ["/a/../b"]}', '{"other": 1}'):
        with pytest.raises(ValueError):
            experiments.Policy.load(bad)


def test_sinks(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    records = lambda n: spark.createDataFrame([(n, "a")], "txid long, action string")
    sinks.append_checked(records(1), log, 0)
    sinks.append_checked(records(2), log, 1)
    with pytest.raises(sinks.Conflict):
        sinks.append_checked(records(3), log, 1)
    path = sinks.snapshot(records(1), f"file://{tmp_path}", "before/upgrade")
    assert path.endswith("before_upgrade")
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.snapshot(records(1), f"file://{tmp_path}", "before/upgrade")
    sinks.write_copies(records(1), [f"file://{tmp_path}/c{n}" for n in range(3)])
    assert spark.read.schema("txid long, action string").json(f"file://{tmp_path}/c2").count() == 1
    sinks.write_report(records(1), f"file://{tmp_path}/r.csv")
    assert experiments.results(spark, "failure_matrix", f"file://{tmp_path}/r.csv").columns[0] == "scenario"
    sinks.write_lines(sinks.as_json(records(1)), f"file://{tmp_path}/lines")
    assert spark.read.text(f"file://{tmp_path}/lines").first().value == '{"txid":1,"action":"a"}'


def test_group_commit(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spark.range(300).select((F.col("id") % 2).alias("key")).write.mode("append").parquet(f"file://{source}")
    rows = spark.readStream.schema("key long").parquet(f"file://{source}")
    stream = stateful.stream_group_commit(rows, 64, 200)
    query = stream.writeStream.outputMode("append").format("memory").queryName("commits").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("commits").agg(F.sum("writes")).first()[0] != 300:
            time.sleep(0.5)
        sizes = sorted(r.writes for r in spark.table("commits").collect())
    finally:
        query.stop()
    assert sizes == [22, 22, 64, 64, 64, 64]


def test_merged_writes():
    rows = pd.DataFrame({"start": [0, 10, 5, 100, 90, 300], "end": [10, 20, 8, 110, 100, 900]})
    got = stateful.merged_writes(rows, 500)
    assert got.values.tolist() == [[0, 20, 3], [90, 110, 2], [300, 900, 1]]


def test_streamed_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 1, 0, 10), (1, 2, 2, 10, 20), (1, 3, 3, 50, 60)], "key long, at long, tie long, start long, end long")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = stateful.stream_merged_writes(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), 100)
    out = f"file://{tmp_path}/out"
    stateful.each_batch(stream, lambda df: df.write.mode("append").parquet(out), f"file://{tmp_path}/log", "append").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(1, 0, 20, 2)]
