"""Logs, replicas and experiment reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetquery.functions import text
from fleetquery.operators import folds, logs, reports
from fleetquery.plans.stand_ins import read

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
    "quorum_select",
    """WITH g AS (SELECT l_orderkey, l_returnflag AS version, count(DISTINCT l_suppkey) AS votes FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, max(version) AS version, arg_max(votes, version) AS votes FROM g WHERE votes >= 2 GROUP BY 1""",
)
def quorum_select(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("version"), "l_suppkey")
    return logs.quorum(rows, ["l_orderkey"], ["version"], "l_suppkey", 3)


@query(
    "double_write_mismatch",
    """WITH c AS (SELECT l_orderkey, l_discount < 0.09 AS present, l_tax < 0.07 AS valid, l_returnflag AS h FROM lineitem),
    s AS (SELECT l_orderkey, count(*) FILTER (present AND NOT valid) AS bad, count(DISTINCT CASE WHEN present AND valid THEN h END) AS hs,
      count(*) FILTER (present) AS p FROM c GROUP BY 1)
    SELECT l_orderkey, CAST(bad + greatest(hs - 1, 0) + CASE WHEN p > 0 AND hs = 0 THEN 1 ELSE 0 END AS BIGINT) AS mismatches FROM s""",
)
def double_write_mismatch(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(
        "l_orderkey",
        (F.col("l_discount") < 0.09).alias("present"),
        (F.col("l_tax") < 0.07).alias("valid"),
        F.col("l_returnflag").alias("hash"),
    )
    return logs.double_write_mismatches(rows, ["l_orderkey"])


@query(
    "latest_copy",
    """SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY 1""",
)
def latest_copy(spark: SparkSession, d: str) -> DataFrame:
    return logs.latest(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_id", "value"])


def _chained(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log per user whose records each name the hash of the one
    before, bodies taken singly; every 17th has a wrong predecessor."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    body = F.concat_ws(":", "event_type", "event_id")
    rows = read(spark, d, "events").select("user_id", F.row_number().over(order).cast("long").alias("seq"), "event_id", body.alias("body"))
    first = F.sha2(F.col("body"), 256)
    before = F.coalesce(F.lag(first).over(Window.partitionBy("user_id").orderBy("seq")), F.lit(""))
    return rows.select("user_id", "seq", "event_id", "body", first.alias("hash"), before.alias("previous"))


@query(
    "chain_links",
    """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, sha256(event_type || ':' || event_id) AS h FROM events)
    SELECT user_id, seq, coalesce(lag(h) OVER (PARTITION BY user_id ORDER BY seq), '') AS previous, h AS hash FROM r""",
)
def chain_links(spark: SparkSession, d: str) -> DataFrame:
    return _chained(spark, d).select("user_id", "seq", "previous", "hash")


@query("chain_verify")
def chain_verify(spark: SparkSession, d: str) -> DataFrame:
    """The validity-dependent chain: rows only, tested against a plain fold."""
    rows = _chained(spark, d)
    wrong = F.when(F.col("event_id") % 17 == 0, "broken").otherwise(F.col("previous"))
    log = rows.select(
        F.col("user_id").alias("volume"), "seq", "body", wrong.alias("previous"),
        F.when(F.col("event_id") % 23 == 0, "").otherwise(F.sha2(F.concat(wrong, "body"), 256)).alias("hash"),
    )
    return logs.verify_chain(log)


@query("log_replay")
def log_replay(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots and deltas of JSON documents: rows only, tested on small logs."""
    rows = _chained(spark, d).select("user_id", "seq", "event_id", "body")
    delta = F.to_json(
        F.array(F.struct(F.lit("add").alias("op"), F.concat(F.lit("/k"), F.col("seq") % 5).alias("path"), F.col("body").alias("value")))
    )
    snapshot = F.when((F.col("seq") - 1) % 128 == 0, F.to_json(F.struct(F.col("body").alias("k0"))))
    log = rows.select(F.col("user_id").alias("volume"), "seq", snapshot.alias("snapshot"), delta.alias("delta"))
    return logs.replay(log)


@query(
    "log_replay_lww",
    "SELECT user_id, event_type, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY 1, 2",
)
def log_replay_lww(spark: SparkSession, d: str) -> DataFrame:
    return logs.last_writes(read(spark, d, "events"), ["user_id", "event_type"], "value", ["ts", "event_id"])


@query(
    "log_compaction",
    """WITH c AS (SELECT user_id, max({'t': ts, 'e': event_id}) AS m FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT events.user_id, event_id FROM events LEFT JOIN c ON c.user_id = events.user_id WHERE m IS NULL OR {'t': ts, 'e': event_id} >= m""",
)
def log_compaction(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.compact(read(spark, d, "events"), "user_id", "event_type = 'signup'", ["ts", "event_id"])
    return rows.select("user_id", "event_id")


@query(
    "group_commit_batches",
    """SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 128 AS batch FROM events""",
)
def group_commit_batches(spark: SparkSession, d: str) -> DataFrame:
    return folds.commit_batches(read(spark, d, "events"), "user_id", ["ts", "event_id"], 128).select("user_id", "event_id", "batch")


@query(
    "json_props",
    "SELECT user_id, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1",
)
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    return read(spark, d, "events").groupBy("user_id").agg(F.max(k).alias("k"))


@query(
    "perf_summary",
    """WITH s AS (SELECT event_type, count(*) AS runs, median(value) AS med,
      CASE WHEN count(*) >= 2 AND avg(value) <> 0 THEN stddev_samp(value) / avg(value) * 100 ELSE 0 END AS cv FROM events GROUP BY 1)
    SELECT event_type, runs, round(med, 6) AS median, round(cv, 6) AS cv, round(med / (SELECT med FROM s WHERE event_type = 'view'), 6) AS ratio FROM s""",
)
def perf_summary(spark: SparkSession, d: str) -> DataFrame:
    found = reports.perf_summary(read(spark, d, "events"), "event_type", "value", "view")
    return found.select("event_type", "runs", *[F.round(c, 6).alias(c) for c in ("median", "cv", "ratio")])


@query(
    "passfail_pivot",
    """SELECT event_type, count(*) AS runs, count(*) FILTER (value < 90) AS passed, count(*) FILTER (NOT value < 90) AS failed FROM events GROUP BY 1""",
)
def passfail_pivot(spark: SparkSession, d: str) -> DataFrame:
    return reports.pass_fail(read(spark, d, "events"), "event_type", F.col("value") < 90)


@query(
    "grid_completeness",
    """WITH t(event_type) AS (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('resize')),
    g AS (SELECT DISTINCT user_id FROM events), o AS (SELECT user_id, event_type, CASE WHEN max(value) > 60 THEN 'pass' ELSE 'fail' END AS status FROM events GROUP BY 1, 2)
    SELECT g.user_id, t.event_type, coalesce(status, 'missing') AS status FROM g CROSS JOIN t LEFT JOIN o ON o.user_id = g.user_id AND o.event_type = t.event_type""",
)
def grid_completeness(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.max("value") > 60, "pass").otherwise("fail")
    kinds = ["click", "error", "purchase", "signup", "view", "resize"]
    return reports.grid_status(read(spark, d, "events"), "user_id", "event_type", status, kinds)


@query(
    "workload_shift",
    """WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS day, value, event_type, row_number() OVER (PARTITION BY ts::DATE ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY ts::DATE) AS n FROM events)
    SELECT day, max(CASE WHEN rn = n // 2 THEN value END) AS p50, max(value) AS p95,
      round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0) / sum(value), 6) AS hot_fraction FROM r GROUP BY 1""",
)
def workload_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    hot = F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)) / F.sum("value")
    shares = rows.groupBy("day").agg(F.round(hot, 6).alias("hot_fraction"))
    return reports.upper_median(rows, "day", "value").join(shares, "day")


@query(
    "cache_hit_ratio",
    """SELECT user_id, CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) > 0 THEN
      count(*) FILTER (event_type = 'view')::DOUBLE / count(*) FILTER (event_type IN ('view', 'click')) ELSE 0.0 END AS ratio FROM events GROUP BY 1""",
)
def cache_hit_ratio(spark: SparkSession, d: str) -> DataFrame:
    sums = read(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses")
    )
    return sums.select("user_id", reports.hit_ratio(F.col("hits"), F.col("misses")).alias("ratio"))


@query(
    "scenario_rotation",
    """WITH s(scenario, pos) AS (VALUES ('strict', 0), ('deferred', 1), ('batched', 2)), i AS (SELECT DISTINCT user_id % 6 AS iteration FROM events)
    SELECT iteration, scenario, CAST((pos + iteration) % 3 AS INT) AS slot FROM s, i""",
)
def scenario_rotation(spark: SparkSession, d: str) -> DataFrame:
    names = [("strict", 0), ("deferred", 1), ("batched", 2)]
    runs = read(spark, d, "events").select((F.col("user_id") % 6).alias("iteration")).distinct()
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(p).alias("pos")) for n, p in names])).alias("s")
    rows = runs.select("iteration", cells)
    return rows.select("iteration", "s.scenario", ((F.col("s.pos") + F.col("iteration")) % len(names)).cast("int").alias("slot"))


@query(
    "journal_head_quorum",
    """WITH h AS (SELECT l_orderkey, l_returnflag AS head, count(*) AS n, count(*) FILTER (l_discount < 0.09 AND l_tax <= 0.07) AS held
      FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, max(held) >= sum(n) // 2 + 1 AS quorum FROM h GROUP BY 1""",
)
def journal_head_quorum(spark: SparkSession, d: str) -> DataFrame:
    members = read(spark, d, "lineitem").select(
        "l_orderkey",
        (F.col("l_discount") < 0.09).alias("readable"),
        F.when(F.col("l_tax") > 0.07, 1).otherwise(0).alias("invalid_entries"),
        F.col("l_returnflag").alias("head"),
    )
    return logs.head_quorum(members, ["l_orderkey"], ["head"])


@query(
    "scenario_order",
    """SELECT DISTINCT event_type, CAST(coalesce(list_position(['view', 'click'], event_type), 3) AS INT) AS place FROM events""",
)
def scenario_order(spark: SparkSession, d: str) -> DataFrame:
    return reports.ordered_scenarios(read(spark, d, "events"), "event_type", ["view", "click"])


@query(
    "column_summary",
    """SELECT event_type, format('{:,}', count(*)) AS records, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1""",
)
def column_summary(spark: SparkSession, d: str) -> DataFrame:
    found = reports.column_summary(read(spark, d, "events"), "event_type", "value")
    return found.select("event_type", text.thousands(F.col("records")).alias("records"), F.round("mean", 6).alias("mean"), "most")
