"""Known values of single functions and operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetquery.functions import access, hashing, health, text
from fleetquery.operators import capacity, changes, folds, integrity, intervals, logs, namespace, placement

NOW = 1_000_000.0
COUNTERS = "reallocated_sectors long, pending_sectors long, crc_errors long, io_errors long, latency_ms double, wear_percent double, temperature_c double, last_smart_refresh_at double"
DISK = f"id string, status string, used_bytes long, capacity_bytes long, {COUNTERS}"


def disk(name="d", status="online", used=0, size=0, reallocated=0, pending=0, crc=0, io=0, ms=0.0, wear=0.0, temp=0.0, smart=NOW):
    return (name, status, used, size, reallocated, pending, crc, io, ms, wear, temp, smart)


def values(spark, column, rows=None, schema="x int"):
    return [r[0] for r in spark.createDataFrame(rows or [(1,)], schema).select(column).collect()]


def test_risk(spark):
    bad = disk("bad", "failed", 99, 100, 1000, 100, 1000, 100, 1000.0, 100.0, 100.0, 0.0)
    states = [disk(s, s) for s in ("online", "draining", "offline", "removed")]
    rows = spark.createDataFrame([bad, *states], DISK).select("id", health.risk_score().alias("s"), health.risk_reasons(NOW).alias("r"))
    got = {r.id: r for r in rows.collect()}
    assert got["bad"].s == 1.0 and got["bad"].r == [
        "failed", "reallocated-sectors", "pending-sectors", "crc-errors", "io-errors", "high-latency", "wear", "temperature",
        "smart-stale-or-unavailable", "near-capacity",
    ]
    assert [got[s].s for s in ("online", "draining", "offline", "removed")] == [0.0, 0.35, 1.0, 0.0]


def test_decisions_and_budgets(spark):
    rows = [(0.9, 0, 0, 99.0), (0.1, 40, 0, 99.0), (0.1, 0, 2, 99.0), (0.1, 0, 1, 99.0), (1.0, 99, 9, 10.0)]
    decision = health.drain_decision(F.col("s"), F.col("io"), F.col("k"), F.lit(50.0), F.col("now"), 0.85, 2)
    assert values(spark, decision, rows, "s double, io long, k long, now double") == ["drain"] * 3 + ["observe", "cooldown"]
    budgets = values(spark, health.adaptive_budget(F.col("b"), F.col("u")), [(0, 9.0), (10, 0.0), (10, 4.0), (9, -1.0)], "b long, u double")
    assert budgets == [0, 10, 20, 5]


@pytest.mark.parametrize(
    ("policy", "latency", "want"),
    [
        (health.ThrottlePolicy(mode="observe"), 0.0, 0),
        (health.ThrottlePolicy(mode="aggressive"), 999.0, 9),
        (health.ThrottlePolicy(), 41.0, 1),
        (health.ThrottlePolicy(), 21.0, 4),
        (health.ThrottlePolicy(pause_ms=5.0), 6.0, 0),
        (health.ThrottlePolicy(max_read_mib_s=3.9, max_write_mib_s=2.9), 0.0, 2),
    ],
)
def test_throttle(spark, policy, latency, want):
    assert values(spark, health.throttled_budget(policy, "rebalance", F.lit(9).cast("long"), F.lit(latency))) == [want]


def test_tiers(spark):
    day = 86400.0
    rows = [("directory", 9.0, 0, True), ("file", 0.0, 0, True), ("file", 10.0, 0, False), ("file", 0.0, 2 << 20, False), ("file", 1.0, 2 << 20, False)]
    tier = health.tier_of(F.col("k"), F.col("b"), F.col("s"), F.col("n"))
    assert values(spark, tier, rows, "k string, s double, n long, b boolean") == ["warm", "hot", "hot", "cold", "warm"]
    assert values(spark, health.decay(F.col("a")), [(0.0,), (day,), (-5.0,)], "a double") == [1.0, 0.5, 1.0]


def test_stable_u01(spark):
    import hashlib

    word = int.from_bytes(hashlib.sha256(b"a\0b7\0").digest()[:8], "big")
    assert values(spark, hashing.stable_u01(F.lit("a"), F.lit("b7"))) == [(float(word) + 1) / 2**64]


def test_paths(spark):
    rows = [("/a/./b//../c",), ("../..",), ("",), ("x/y",)]
    assert values(spark, text.clean_path(F.col("p")), rows, "p string") == ["/a/c", "/", "/", "/x/y"]
    assert values(spark, text.parent_path(F.col("p")), rows, "p string") == ["/a", None, None, "/x"]
    assert values(spark, text.base_name(F.col("p")), rows[3:], "p string") == ["y"]
    names = [("ok",), (".",), ("..",), ("",), ("a/b",), ("x" * 256,), ("é" * 128,)]
    assert values(spark, text.is_entry_name(F.col("n")), names, "n string") == [True] + [False] * 6


def test_skew(spark):
    rows = lambda *xs: spark.createDataFrame([("online", u, c) for u, c in xs], "status string, used_bytes long, capacity_bytes long")
    skew = lambda *xs: capacity.usage_skew(rows(*xs)).first().skew
    assert skew() == 0 and skew((5, 10)) == 0
    assert skew((50, 100), (100, 200)) == pytest.approx(2 / 3)
    assert skew((10, 0), (0, 0)) == 10.0


def brute_units(sizes, width):
    if len(sizes) < width:
        return 0
    best = 0
    for x in range(sum(sizes) // width + 1):
        if sum(min(c, x) for c in sizes) >= x * width:
            best = x
    return best


@pytest.mark.parametrize("sizes", [[100] * 3, [300, 10, 10], [100] * 6, [100, 100], [7, 5, 3, 3, 1], [0, 0, 9, 9]])
def test_stripe_units(spark, sizes):
    df = spark.createDataFrame([(1, c) for c in sizes], "g int, c long")
    assert capacity.max_stripe_units(df, ["g"], "c", 3).first().units == brute_units(sizes, 3)


def test_shared_filesystem(spark):
    rows = [("a", "auto-probe", "fs", 150, 20), ("b", "auto-probe", "fs", 100, 30), ("c", "user-override", "fs", 70, 1), ("d", "auto-probe", None, 9, 9)]
    df = spark.createDataFrame(rows, "id string, capacity_source string, fs string, capacity_bytes long, used_bytes long")
    got = {r.id: (r.effective_capacity, r.effective_used) for r in capacity.effective_capacity(df, "fs").collect()}
    assert got == {"a": (150, 50), "b": (150, 50), "c": (70, 1), "d": (9, 9)}


def test_next_layout(spark):
    df = spark.createDataFrame([("layout-0007",), ("layout-x",), ("other-0099",)], "id string")
    assert capacity.next_numbered(df, "id", "layout-").first().next_id == "layout-0008"


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 30, 40), (1, 35, 38), (1, 50, 50)], "k int, start long, end long")
    islands = intervals.coalesce(df, ["k"])
    assert sorted((r.start, r.end) for r in islands.collect()) == [(0, 20), (30, 40)]
    assert [(r.data, r.hole) for r in intervals.next_data(islands, ["k"], F.lit(20)).collect()] == [(30, 20)]
    assert [(r.data, r.hole) for r in intervals.next_data(islands, ["k"], F.lit(5)).collect()] == [(5, 20)]
    assert [r.start for r in intervals.overlaps(df, ["k"]).collect()] == [35]
    other = spark.createDataFrame([(1, 15, 36), (2, 0, 99)], "k int, start long, end long")
    pairs = sorted((r.start, r.right_start) for r in intervals.overlap_join(df, other, ["k"], 8).collect())
    assert pairs == [(10, 15), (30, 15), (35, 15)]


def test_directories(spark):
    entries = spark.createDataFrame([(1, "b", 2), (2, "c", 3), (1, "gone", 9), (3, "loop", 2)], "parent long, name string, child long")
    inodes = spark.createDataFrame([(1, "directory"), (2, "directory"), (3, "file")], "id long, kind string")
    rows = {(r.parent, r.name, r.child) for r in namespace.readdir(entries, inodes).collect()}
    assert rows == {(1, "b", 2), (2, "c", 3), (3, "loop", 2), (1, ".", 1), (1, "..", 1), (2, ".", 2), (2, "..", 1)}
    assert {r.path for r in namespace.paths(entries, 1).collect()} == {"/", "/b", "/b/c", "/gone"}
    assert integrity.dangling(entries, "child", inodes, "id").count() == 1


def test_placement_reserves_room(spark):
    rows = [(f"d{n}", f"r{n % 2}", float(n), "fs" if n < 3 else f"d{n}", 100 if n < 3 else 0, 70 if n < 3 else 0) for n in range(6)]
    fleet = spark.createDataFrame(rows, "disk string, domain string, score double, fs string, capacity long, used long")
    stripes = spark.createDataFrame([(7,)], "stripe long")
    scores = lambda keys, held: np.tile(held["score"], (len(keys), 1))
    got = {r.position: r.disk for r in placement.choose(stripes, fleet, scores, "stripe", "disk", 3, 20).collect()}
    assert got == {0: "d0", 1: "d3", 2: "d4"}  # d1 and d2 share the room that d0 took
    with pytest.raises(ValueError):
        placement.choose(stripes, fleet, scores, "stripe", "disk", 3, 20, size=2)
    assert placement.choose(stripes, fleet.where("false"), scores, "stripe", "disk", 3).count() == 0


@pytest.mark.parametrize("domains", [1, 2, 7])
def test_placement_of_one_block_and_of_many(spark, domains):
    rows = [(n, (n * 7) % domains, n, 0, 0) for n in range(60)]
    fleet = spark.createDataFrame(rows, "disk long, domain long, fs long, capacity long, used long")
    stripes = spark.range(40).toDF("stripe")
    scores = lambda keys, held: ((keys[:, None] * 31 + held["disk"] * 17) % 23).astype(float)
    pairs = placement.every_pair(stripes, fleet, "disk", 9)
    assert pairs.count() == 40 * 60
    pairs = pairs.withColumn("score", ((F.col("stripe") * 31 + F.col("disk") * 17) % 23).cast("double"))
    want = {tuple(r) for r in placement.spread_top(pairs, "stripe", "domain", "disk", 3).select("stripe", "position", "disk").collect()}
    for size in (9, 100):
        assert {tuple(r) for r in placement.choose(stripes, fleet, scores, "stripe", "disk", 3, size=size).collect()} == want


def test_scores_of_columns_and_arrays_agree(spark, small):
    from fleetquery.plans import fleet as plans

    rows = plans.rendezvous_score(spark, small).where("stripe < 40").collect()
    held = plans._fleet(plans.disks(spark, small)).orderBy("id").toPandas()
    arrays = {n: held[n].to_numpy() for n in held.columns}
    scores = plans._scores(np.arange(40), arrays)
    at = {int(x): n for n, x in enumerate(arrays["id"])}
    assert len(rows) == 40 * len(at)
    assert all(r.score == pytest.approx(scores[r.stripe, at[r.id]], abs=2e-9) for r in rows)


def test_whole_numbers_above_doubles(spark):
    big = F.lit(9007199254740993)
    assert values(spark, text.align_up(big, 1)) == [9007199254740993]
    assert values(spark, text.align_down(big, 2)) == [9007199254740992] and values(spark, text.align_up(big, 2)) == [9007199254740994]


def test_access_rules(spark):
    acl = F.array(
        F.struct(F.lit("mask").alias("tag"), F.lit(None).cast("int").alias("id"), F.lit(4).alias("perms")),
        F.struct(F.lit("user").alias("tag"), F.lit(5).alias("id"), F.lit(6).alias("perms")),
    )
    check = lambda uid, want: access.posix_access(acl, F.lit(0o640), F.lit(1), F.lit(1), F.lit(uid), F.array(F.lit(9)), F.lit(want))
    assert [values(spark, check(*a))[0] for a in ((1, 6), (5, 6), (5, 4), (7, 4))] == [True, False, True, False]
    none = F.array().cast("array<struct<type:string,principal:string,flags:array<string>,bits:int>>")
    posix = F.array().cast("array<struct<tag:string,id:int,perms:int>>")
    root = lambda kind, mode, want: access.access(F.lit(kind), F.lit(mode), F.lit(1), F.lit(1), none, posix, F.lit(0), F.array(F.lit(0)), F.lit(want))
    assert [values(spark, root(*a))[0] for a in (("file", 0, 6), ("file", 0, 1), ("file", 0o100, 1), ("directory", 0, 1))] == [True, False, True, True]


def test_chain_skips_bad_records(spark):
    rows, previous = [], ""
    for seq in range(6):
        body = f"b{seq}"
        good = logs.record_hash(previous, body)
        if seq == 2:
            rows.append(("v", seq, body, previous, "0" * 64))  # its successors still point at record 1
            continue
        if seq == 4:
            rows.append(("v", seq, body, previous, ""))  # of the old kind
            continue
        rows.append(("v", seq, body, previous, good))
        previous = good
    rows.append(("v", 6, "x", "elsewhere", logs.record_hash("elsewhere", "x")))
    df = spark.createDataFrame(rows, "volume string, seq long, body string, previous string, hash string")
    assert [r.valid for r in logs.verify_chain(df).orderBy("seq").collect()] == [True, True, False, True, True, True, False]


def test_replay_stops_at_a_bad_delta(spark):
    rows = [
        ("v", 1, None, '[{"op":"add","path":"/a","value":1}]'),
        ("v", 2, '{"a": {"b": [1]}}', None),
        ("v", 3, None, '[{"op":"add","path":"/a/b/-","value":2},{"op":"add","path":"/x~1y","value":0}]'),
        ("v", 4, None, '[{"op":"remove","path":"/missing"}]'),
        ("v", 5, None, '[{"op":"add","path":"/late","value":1}]'),
        ("v", 6, '{"n": 1}', None),
    ]
    df = spark.createDataFrame(rows, "volume string, seq long, snapshot string, delta string")
    got = logs.replay(df).orderBy("seq").collect()
    assert [r.applied for r in got] == [False, True, True, False, False, True]
    assert got[2].state == '{"a": {"b": [1, 2]}, "x/y": 0}' and got[4].state == got[2].state


def test_quorum(spark):
    rows = [("g", 3, "m1"), ("g", 3, "m1"), ("g", 2, "m1"), ("g", 2, "m2"), ("g", 1, "m1"), ("g", 1, "m2"), ("g", 1, "m3")]
    df = spark.createDataFrame(rows, "g string, txid long, member string")
    got = logs.quorum(df, ["g"], ["txid"], "member", 3).first()
    assert (got.txid, got.votes) == (2, 2)


def test_cyclic_page(spark):
    df = spark.range(6).withColumnRenamed("id", "ino")
    page = lambda *a: [r.ino for r in folds.cyclic_page(df, "ino", *a).collect()]
    assert page(3, 4) == [4, 5, 0, 1] and page(None, 2) == [0, 1] and page(3, None) == list(range(6)) and page(9, 9) == list(range(6))


def test_lru(spark):
    rows = [("c", n, dt.datetime(2024, 1, 1 + n), 10) for n in range(5)]
    df = spark.createDataFrame(rows, "cache string, id int, at timestamp, size int")
    assert sorted(r.id for r in folds.lru_evicted(df, "cache", ["at", "id"], "size", 30).collect()) == [0, 1]


def test_symlinks_are_followed(spark):
    nodes = [("/", 0, None), ("/a", 1, None), ("/a/f", 2, None), ("/l", 3, "a"), ("/m", 4, "/l/./f"), ("/a/up", 5, "../l"), ("/loop", 6, "loop")]
    df = spark.createDataFrame(nodes, "path string, id long, target string")
    asked = ["/l/f", "/m", "/a/up/up/f", "/loop", "/gone", "/a/../a/f", "/"]
    requests = spark.createDataFrame([(p,) for p in asked], "path string")
    got = {r.path: r.resolved for r in changes.resolved(requests, df, 6).collect()}
    assert got == {"/l/f": "/a/f", "/m": "/a/f", "/a/up/up/f": "/a/f", "/loop": None, "/gone": None, "/a/../a/f": "/a/f", "/": "/"}


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    rows = [(1, "x", 5, False), (1, "y", 4, False), (2, "z", 1, True), (4, "n", 1, True), (4, "m", 2, False)]
    events = spark.createDataFrame(rows, "k int, v string, seq long, gone boolean")
    got = sorted(tuple(r) for r in changes.upserted(base, events, ["k"], "seq", "gone").collect())
    assert got == [(1, "x"), (3, "c"), (4, "m")]


def test_missing_members_go_offline(spark):
    disks = spark.createDataFrame([(1, "/a", "online"), (2, "/b", "online"), (3, "/c", "removed")], "id int, path string, status string")
    seen = spark.createDataFrame([(1, "/z")], "id int, path string")
    got = {r.id: (r.path, r.status) for r in changes.with_present_paths(disks, seen).collect()}
    assert got == {1: ("/z", "online"), 2: ("/b", "offline"), 3: ("/c", "removed")}


def test_small_filters(spark):
    df = spark.createDataFrame([("a/x", 1), ("b/y", 2)], "p string, n int")
    assert changes.optional(df, "n", None).count() == 2 and changes.optional(df, "n", 2).count() == 1
    assert changes.under(df, "p", "a/").count() == 1
    assert values(spark, changes.layout_id(F.col("l")), [("",), (None,), ("layout-0003",)], "l string") == ["layout-0000"] * 2 + ["layout-0003"]


def test_binary_acl(spark):
    import struct

    spec = "u::rw-,user:70000:r-x,g::r--,m::rwx,other::---"
    want = struct.pack("<I", 2) + b"".join(
        struct.pack("<HHI", *e) for e in ((1, 6, 0xFFFFFFFF), (2, 5, 70000), (4, 4, 0xFFFFFFFF), (16, 7, 0xFFFFFFFF), (32, 0, 0xFFFFFFFF))
    )
    df = spark.createDataFrame([(spec,)], "s string").select(access.parse_acl_text(F.col("s")).alias("a"))
    row = df.select("a", access.acl_to_binary(F.col("a")).alias("b")).select("a", "b", access.acl_from_binary(F.col("b")).alias("c")).first()
    assert bytes(row.b) == want and row.c == row.a
    broken = [(bytearray(want[:-1]),), (bytearray(b"\x01" + want[1:]),), (bytearray(want[:4]),)]
    assert values(spark, access.acl_from_binary(F.col("b")), broken, "b binary") == [None, None, []]


@pytest.mark.parametrize("domains, systems, required", [(2, 5, 30), (7, 40, 30), (1, 40, 30), (7, 40, 0), (2, 3, 90)])
def test_placement_stops_where_no_other_disk_can_be_chosen(spark, domains, systems, required):
    """Bounds and room of 500 disks: chunks of them give what the whole fleet gives."""
    rng = np.random.default_rng(domains * 100 + systems)
    base = rng.integers(0, 9, 500) / 4.0
    rows = [(n, int(rng.integers(domains)), int(rng.integers(systems)), 100, int(rng.integers(0, 80)), float(base[n])) for n in range(500)]
    fleet = spark.createDataFrame(rows, "disk long, domain long, fs long, capacity long, used long, least double")
    stripes = spark.range(50).toDF("stripe")
    scores = lambda keys, held: held["least"] + ((keys[:, None] * 31 + held["disk"] * 17) % 97) // 8 / 8.0
    held = {n: np.array([r[i] for r in rows]) for i, n in enumerate(("disk", "domain", "fs", "capacity", "used", "least"))}
    want = set()
    for stripe, row in enumerate(scores(np.arange(50), held)):
        order = np.lexsort((held["disk"], row))
        want |= {(stripe, n, at) for n, at in enumerate(placement.choose_one(order, held, 3, required))}
    counted = spark.sparkContext.accumulator(0)

    def counting(keys, some):
        counted.add(len(keys) * len(some["disk"]))
        return scores(keys, some)

    got = placement.choose(stripes, fleet, counting, "stripe", "disk", 3, required, least="least")
    assert {tuple(r) for r in got.collect()} == want
    if domains == 7 and required == 0:
        assert counted.value < 50 * 500


def test_reserved_placement_on_a_fleet_beyond_one_block(spark, small, tmp_path):
    """placement_reserved and placement_topk on 20,000 disks, as their SQL."""
    import duckdb

    from fleetquery.plans import fleet as plans

    con = duckdb.connect()
    for name, columns, copies in (("supplier", "s_suppkey + i * 1000 AS s_suppkey", 2000), ("lineitem", "l_suppkey + i * 1000 AS l_suppkey", 2), ("orders", "o_orderkey + i AS o_orderkey", 1)):
        some = "WHERE o_orderkey < 30" if name == "orders" else ""
        con.execute(f"COPY (SELECT * REPLACE ({columns}) FROM '{small}/{name}.parquet', range({copies}) t(i) {some}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    assert con.execute("SELECT count(*) FROM supplier").fetchone()[0] > 2 * placement.FLEET_BLOCK - 1
    for name in ("placement_reserved", "placement_topk"):
        want = con.execute(plans.SQL[name]).fetchall()
        assert sorted(tuple(r) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)


def test_batches_are_cut_between_keys():
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4, 7, 7]
    for size in (1, 2, 3, 11):
        batches = pa.table({"k": keys}).to_batches(max_chunksize=size) + [pa.RecordBatch.from_pydict({"k": pa.array([], pa.int64())})]
        got = [b.column("k").to_pylist() for b in placement.cut_between(iter(batches), "k")]
        assert sum(got, []) == keys and sum(len(set(b)) for b in got) == 5


def test_chance_of_fewer_events():
    rng = np.random.default_rng(4)
    for events, count in ((1, 1), (2, 3), (7, 2), (9, 3)):
        p = rng.random(events)
        happen = np.array([[n >> i & 1 for i in range(events)] for n in range(1 << events)])
        want = np.where(happen, p, 1 - p).prod(axis=1)[happen.sum(axis=1) < count].sum()
        assert placement.fewer(p, count) == pytest.approx(want)


@pytest.mark.parametrize("domains, far, required, missed", [(25, 0, 0, 1e-3), (2, 0, 1500, 1e-3), (25, 0, 0, 0.7), (2, 0, 1500, 0.7), (3, 1, 0, 1e-3)])
def test_placement_hashes_no_pair_in_python_but_near_ones(spark, monkeypatch, domains, far, required, missed):
    """Disks near a stripe come from a join; where they do not settle it (often, if ``missed`` is) the result is the same."""
    from fleetquery.plans import fleet as plans

    monkeypatch.setattr(placement, "MISSED", missed)
    if far:
        monkeypatch.setattr(placement, "NEAR", 20)
    rng = np.random.default_rng(domains)
    rows = []
    for n in range(1, 601):
        # the last domain is far, if one is: its disks are half full
        capacity = 10_000 if n % domains >= domains - far else int(rng.choice([0, 0, 4000]))
        used = 5000 if capacity == 10_000 else int(rng.integers(0, 4200))
        rows.append((n * 97, n % domains, n % 5, capacity, used, str(rng.choice(["hot", "cold", "warm"])), float(n % 8), float(n % 40), float(n % 50)))
    fleet = spark.createDataFrame(rows, "id long, domain long, fs long, capacity long, used long, tier string, weight double, read_ms double, write_ms double")
    fill = F.when(F.col("capacity") > 0, F.least(F.col("used") / F.col("capacity"), F.lit(2.0))).otherwise(0.0)
    fleet = fleet.withColumn("least", fill - 1e-9).localCheckpoint()
    stripes = spark.range(400).select((F.col("id") * 7919 + 3).alias("stripe"))
    hashed = spark.sparkContext.accumulator(0)

    def scores(keys, held):
        hashed.add(len(keys) * len(held["id"]))
        return plans._scores(keys, held)

    want = {tuple(r) for r in placement.choose(stripes, fleet, scores, "stripe", "id", 3, required).collect()}
    assert hashed.value == 400 * 600
    before = hashed.value
    got = placement.choose(stripes, fleet, scores, "stripe", "id", 3, required, least="least", drawn=plans._drawn())
    assert {tuple(r) for r in got.collect()} == want and len(want) == 1200
    if not far and missed < 0.1:
        assert hashed.value - before < 400 * 600 / 50
    else:
        assert hashed.value > before
    if not far:
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("BroadcastHashJoin") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_islands_with_ties_in_many_small_tasks(spark, monkeypatch):
    """Islands are the runs of the units held; tasks grow in number with the rows, not in size."""
    rng = np.random.default_rng(3)
    start, length = rng.integers(0, 300, 1500), rng.integers(-1, 5, 1500)
    rows = [(int(n % 20) if n % 3 else 7, int(s), int(s + w)) for n, (s, w) in enumerate(zip(start, length))]
    rows += rows[::5]  # ties
    want = set()
    for key in range(20):
        held = sorted({x for k, s, e in rows if k == key for x in range(s, e)})
        starts = [x for x in held if x - 1 not in held]
        want |= {(key, s, next(x for x in range(s, 400) if x not in held)) for s in starts}
    frame = spark.createDataFrame(rows, "ino long, start long, end long")
    assert sorted(tuple(r) for r in intervals.coalesce(frame, ["ino"]).collect()) == sorted(want)
    monkeypatch.setattr(intervals, "TASK_ROWS", 50)
    islands = intervals.coalesce(frame, ["ino"])
    assert islands.rdd.getNumPartitions() >= len([r for r in rows if r[1] < r[2]]) / 50
    assert sorted(tuple(r) for r in islands.collect()) == sorted(want)
    plan = islands._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan


def test_pairs_are_scored_in_batches_as_by_columns(spark, small):
    """Every pair once, with the score of the column function; no pair is hashed or rounded row by row."""
    from fleetquery.plans import fleet as plans

    got = plans.rendezvous_score(spark, small)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sha2(" not in plan
    disks = plans.disks(spark, small)
    pairs = placement.every_pair(spark.range(50).toDF("stripe"), disks, "id")
    want = {(r.stripe, r.id): r.score for r in plans._scored(pairs).select("stripe", "id", "score").collect()}
    rows = got.where("stripe < 50").collect()
    assert len(rows) == len(want) and all(r.score == pytest.approx(want[r.stripe, r.id], abs=2e-9) for r in rows)


def test_pairs_of_one_task_do_not_grow(spark, small, monkeypatch):
    """Tasks of all pairs grow in number with them, not in size; the rows are the same."""
    from fleetquery.plans import fleet as plans

    want = sorted(tuple(r) for r in plans.rendezvous_score(spark, small).collect())
    monkeypatch.setattr(placement, "TASK_PAIRS", 200)
    got = plans.rendezvous_score(spark, small)
    sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(sizes) <= 2 * 200 and len(sizes) % (3 * spark.sparkContext.defaultParallelism) == 0
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["placement_reserved", "placement_topk"])
def test_hashes_of_one_task_do_not_grow(spark, small, monkeypatch, name):
    """As for all pairs, where disks come from a join."""
    from fleetquery.plans import fleet as plans

    want = sorted(tuple(r) for r in plans.QUERIES[name](spark, small).collect())
    tasks = plans.QUERIES[name](spark, small).rdd.getNumPartitions()
    monkeypatch.setattr(placement, "TASK_PAIRS", 60)
    got = plans.QUERIES[name](spark, small)
    assert got.rdd.getNumPartitions() > tasks
    assert sorted(tuple(r) for r in got.collect()) == want
