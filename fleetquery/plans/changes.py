"""Changes of state, modes and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetquery.functions import modes
from fleetquery.operators import changes, namespace
from fleetquery.plans.stand_ins import DISKS_SQL, INTERVALS_SQL, dentries, disks, intervals, micros, read

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # type: ignore[no-untyped-def]
    def register(f):  # type: ignore[no-untyped-def]
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query(
    "entry_events",
    """WITH b AS (SELECT o_orderkey AS k, o_custkey AS v, -1 AS s, false AS gone FROM orders
      UNION ALL SELECT event_id, user_id, epoch_us(ts), event_type = 'error' FROM events),
    l AS (SELECT k, arg_max(v, s) AS v, arg_max(gone, s) AS gone FROM b GROUP BY 1) SELECT k AS name, v AS child FROM l WHERE NOT gone""",
)
def entry_events(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_custkey").alias("child"))
    events = read(spark, d, "events").select(
        F.col("event_id").alias("name"), F.col("user_id").alias("child"), micros(F.col("ts")).alias("seq"),
        (F.col("event_type") == "error").alias("gone"),
    )
    return changes.upserted(base, events, ["name"], "seq", "gone")


@query(
    "link_counts",
    """WITH d AS (SELECT (n_nationkey - 1) // 2 AS parent, n_nationkey AS child FROM nation WHERE n_nationkey > 0 AND n_nationkey % 7 <> 6),
    i AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey < 12 THEN 'directory' ELSE 'file' END AS kind FROM nation)
    SELECT id, kind, CAST(CASE WHEN NOT (id = 0 OR EXISTS (SELECT 1 FROM d WHERE child = id)) THEN 0
      WHEN kind = 'directory' THEN 2 + (SELECT count(*) FROM d JOIN i c ON c.id = d.child WHERE d.parent = i.id AND c.kind = 'directory')
      ELSE (SELECT count(*) FROM d WHERE child = i.id) END AS BIGINT) AS nlink, (id = 0 OR EXISTS (SELECT 1 FROM d WHERE child = id)) AS live FROM i""",
)
def link_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("n_nationkey") < 12, "directory").otherwise("file")
    inodes = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), kind.alias("kind"))
    return changes.link_counts(inodes, dentries(spark, d).where("child % 7 <> 6"), roots=(0,))


@query(
    "blocks_after_write",
    f"""WITH {INTERVALS_SQL}, w AS (SELECT o_orderkey AS ino, (o_orderkey % 40 * 60) // 64 * 64 AS s, CAST(ceil((o_orderkey % 40 * 60 + 100) / 64.0) AS BIGINT) * 64 AS e FROM orders WHERE o_orderkey % 3 = 0)
    SELECT ino, s AS "start", e AS "end", true AS kept FROM ivals i WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.ino = i.ino AND i.s < w.e AND i.e > w.s)
    UNION ALL SELECT ino, s, e, false FROM w""",
)
def blocks_after_write(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("o_orderkey") % 40 * 60
    writes = read(spark, d, "orders").where("o_orderkey % 3 = 0")
    writes = writes.select(F.col("o_orderkey").alias("ino"), start.alias("start"), (start + 100).alias("end"))
    return changes.blocks_after_write(intervals(spark, d), writes, "ino", 64)


@query(
    "drainable",
    f"""WITH {DISKS_SQL} SELECT id, (SELECT count(*) FROM disks WHERE status = 'online') - (status = 'online')::INT >= 6 AS drainable FROM disks""",
)
def drainable(spark: SparkSession, d: str) -> DataFrame:
    return changes.drainable(disks(spark, d), 6)


@query(
    "present_paths",
    f"""WITH {DISKS_SQL} SELECT id, CASE WHEN id % 4 <> 0 THEN '/dev/new' || id ELSE '/dev/old' || id END AS path,
      CASE WHEN id % 4 = 0 AND status <> 'removed' THEN 'offline' ELSE status END AS status FROM disks""",
)
def present_paths(spark: SparkSession, d: str) -> DataFrame:
    known = disks(spark, d).select("id", F.concat(F.lit("/dev/old"), F.col("id")).alias("path"), "status")
    seen = known.where("id % 4 <> 0").select("id", F.concat(F.lit("/dev/new"), F.col("id")).alias("path"))
    return changes.with_present_paths(known, seen)


@query(
    "moves_allowed",
    """WITH RECURSIVE d AS (SELECT (n_nationkey - 1) // 2 AS parent, n_nationkey AS child FROM nation WHERE n_nationkey > 0),
    up(id, a) AS (SELECT n_nationkey, n_nationkey FROM nation UNION ALL SELECT up.id, d.parent FROM up JOIN d ON d.child = up.a),
    m AS (SELECT n_nationkey::BIGINT AS child, (n_nationkey * 5 % 25)::BIGINT AS new_parent FROM nation WHERE n_nationkey > 0)
    SELECT child, new_parent, NOT EXISTS (SELECT 1 FROM up WHERE up.id = new_parent AND up.a = child) AS allowed FROM m""",
)
def moves_allowed(spark: SparkSession, d: str) -> DataFrame:
    moves = read(spark, d, "nation").where("n_nationkey > 0").select(
        F.col("n_nationkey").cast("long").alias("child"), (F.col("n_nationkey") * 5 % 25).cast("long").alias("new_parent")
    )
    return changes.moves_allowed(moves, namespace.paths(dentries(spark, d), 0))


@query("resolved_paths")
def resolved_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every node by its path, some of them links: rows only, tested on a small tree."""
    paths = namespace.paths(dentries(spark, d), 0).select("path", "id")
    target = F.when(F.col("id") % 6 == 4, F.concat(F.lit("../"), F.element_at(F.split("path", "/"), -1), F.lit("/.")))
    nodes = paths.withColumn("target", target)
    return changes.resolved(paths.select("path"), nodes, limit=8)


@query(
    "mode_bits",
    """WITH c AS (SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN 32768 WHEN 1 THEN 16384 WHEN 2 THEN 40960 ELSE 49152 END + c_custkey * 13 % 4096 AS INT) AS mode FROM customer)
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'directory' WHEN 2 THEN 'symlink' ELSE 'socket' END AS type,
      CASE WHEN c_custkey % 4 = 1 THEN mode ELSE mode & ~3072 END AS written, CASE c_custkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 6 END AS request,
      CASE c_custkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'exists' WHEN 2 THEN 'no-space' WHEN 3 THEN 'not-empty' ELSE 'io' END AS error FROM c""",
)
def mode_bits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    top = F.when(k % 4 == 0, 0o100000).when(k % 4 == 1, 0o040000).when(k % 4 == 2, 0o120000).otherwise(0o140000)
    number = F.when(k % 5 == 0, 2).when(k % 5 == 1, 17).when(k % 5 == 2, 28).when(k % 5 == 3, 39).otherwise(999)
    rows = read(spark, d, "customer").select("c_custkey", (top + k * 13 % 4096).cast("int").alias("mode"))
    return rows.select(
        "c_custkey",
        modes.file_type(F.col("mode")).alias("type"),
        modes.cleared_setid(F.col("mode"), k % 4 == 1).alias("written"),
        modes.open_request((k % 3).cast("int")).alias("request"),
        modes.error_class(number).alias("error"),
    )


@query(
    "enum_names",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'host' WHEN 1 THEN 'loop' WHEN 2 THEN 'raw' ELSE 'unknown' END AS backend FROM documents""",
)
def enum_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    name = F.when(k == 0, "HostFS").when(k == 1, " Loop-Block ").when(k == 2, "RAW").otherwise("other")
    known = modes.enum_value(name, ("host", "loop", "raw"), {"hostfs": "host", "loop-block": "loop"})
    return read(spark, d, "documents").select("doc_id", F.coalesce(known, F.lit("unknown")).alias("backend"))


@query(
    "acl_modes",
    """WITH c AS (SELECT c_custkey AS k, CAST(c_custkey * 7 % 512 AS INT) AS mode FROM customer)
    SELECT k, (5 << 6) | (CASE WHEN k % 2 = 0 THEN 6 ELSE 3 END << 3) | (mode & 7) AS implied,
      CASE WHEN k % 2 = 0 THEN (mode >> 6) || ',' || 3 || ',' || ((mode >> 3) & 7) ELSE (mode >> 6) || ',' || ((mode >> 3) & 7) END AS after FROM c""",
)
def acl_modes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    entry = lambda tag, perms: F.struct(F.lit(tag).alias("tag"), F.lit(None).cast("long").alias("id"), F.lit(perms).alias("perms"))
    plain = [entry("user_obj", 5), entry("group_obj", 3)]
    acl = F.when(k % 2 == 0, F.array(*plain, entry("mask", 6))).otherwise(F.array(*plain))
    rows = read(spark, d, "customer").select(k.alias("k"), (k * 7 % 512).cast("int").alias("mode"), acl.alias("acl"))
    after = F.transform(modes.acl_after_chmod(F.col("acl"), F.col("mode")), lambda e: e["perms"].cast("string"))
    return rows.select("k", modes.mode_of_acl(F.col("acl"), F.col("mode")).alias("implied"), F.array_join(after, ",").alias("after"))


@query(
    "file_times",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE CAST(round((doc_id * 1.5 + 0.25) * 1000000) AS BIGINT) END AS micros FROM documents""",
)
def file_times(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.when(F.col("doc_id") % 3 == 0, -1.0).otherwise(F.col("doc_id") * F.lit(1.5) + F.lit(0.25))
    return read(spark, d, "documents").select("doc_id", F.unix_micros(modes.timestamp_of(seconds)).alias("micros"))
