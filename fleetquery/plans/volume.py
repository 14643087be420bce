"""Namespace, integrity, intervals, access and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetquery.functions import access, hashing, health, text
from fleetquery.operators import folds, integrity, intervals, namespace, placement
from fleetquery.plans import stand_ins
from fleetquery.plans.stand_ins import DISKS_SQL, INTERVALS_SQL, dentries, disks, read

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
    "node_kind_counts",
    """SELECT count(*) FILTER (o_orderstatus = 'F') AS files, count(*) FILTER (o_orderstatus = 'O') AS directories,
      count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS others FROM orders""",
)
def node_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("o_orderstatus")
    return read(spark, d, "orders").agg(
        F.count_if(kind == "F").alias("files"),
        F.count_if(kind == "O").alias("directories"),
        F.count_if(~kind.isin("F", "O")).alias("others"),
    )


@query(
    "stat",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN CAST(ceil(n_chars / 512.0) AS BIGINT) ELSE 0 END AS blocks FROM documents""",
)
def stat(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "file").otherwise("directory")
    rows = read(spark, d, "documents").select("doc_id", kind.alias("kind"), F.col("n_chars").alias("size"))
    return namespace.stat(rows).select("doc_id", "blocks")


@query(
    "readdir",
    """WITH d AS (SELECT n_regionkey AS parent, n_name AS name, 100 + n_nationkey AS child FROM nation WHERE n_nationkey % 6 <> 5),
    i AS (SELECT r_regionkey AS id, 'directory' AS kind FROM region UNION ALL SELECT 100 + n_nationkey, 'file' FROM nation WHERE n_nationkey % 5 <> 2)
    SELECT parent, name, child, kind FROM d JOIN i ON child = id
    UNION ALL SELECT id, '.', id, kind FROM i WHERE kind = 'directory' UNION ALL SELECT id, '..', id, kind FROM i WHERE kind = 'directory'""",
)
def readdir(spark: SparkSession, d: str) -> DataFrame:
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    entries = nation.where("n_nationkey % 6 <> 5").select(
        F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).alias("child")
    )
    files = nation.where("n_nationkey % 5 <> 2").select((F.col("n_nationkey") + 100).alias("id"), F.lit("file").alias("kind"))
    inodes = region.select(F.col("r_regionkey").alias("id"), F.lit("directory").alias("kind")).unionByName(files)
    return namespace.readdir(entries, inodes)


TREE_SQL = "d AS (SELECT (n_nationkey - 1) // 2 AS parent, n_name AS name, n_nationkey AS child FROM nation WHERE n_nationkey > 0)"
WALK_SQL = f"""{TREE_SQL}, walk AS (SELECT {{0}}::BIGINT AS id, '' AS path, 0 AS depth
  UNION ALL SELECT d.child, walk.path || '/' || d.name, walk.depth + 1 FROM walk JOIN d ON d.parent = walk.id)"""


@query(
    "namespace_paths",
    f"WITH RECURSIVE {WALK_SQL.format(0)} SELECT id, CASE WHEN depth = 0 THEN '/' ELSE path END AS path, depth FROM walk",
)
def namespace_paths(spark: SparkSession, d: str) -> DataFrame:
    return namespace.paths(dentries(spark, d), 0).select("id", "path", "depth")


@query("reachability", f"WITH RECURSIVE {WALK_SQL.format(2)} SELECT id FROM walk")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    return namespace.below(dentries(spark, d), 2)


@query("parent_lookup", f"WITH {TREE_SQL} SELECT child, min(parent) AS parent FROM d GROUP BY 1")
def parent_lookup(spark: SparkSession, d: str) -> DataFrame:
    return namespace.parents(dentries(spark, d))


@query(
    "path_depth_sort",
    "SELECT page_id, CAST(length(url) - length(replace(url, '/', '')) AS INT) AS depth FROM pages",
)
def path_depth_sort(spark: SparkSession, d: str) -> DataFrame:
    return namespace.by_depth(read(spark, d, "pages").select("page_id", "url"), "url").select("page_id", "depth")


CLEAN_SQL = """'/' || array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(
  list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x])),
  lambda a, x: CASE WHEN x[1] = '..' THEN a[:-2] ELSE list_concat(a, x) END), '/')"""
PATH_SQL = "SELECT page_id, '/a/./' || page_id || '/../' || regexp_replace(url, '^https?://', '') || '/..//b' AS p FROM pages"


@query("clean_path", f"WITH r AS ({PATH_SQL}) SELECT page_id, {CLEAN_SQL} AS path FROM r")
def clean_path(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(
        F.lit("/a/./"), F.col("page_id"), F.lit("/../"), F.regexp_replace("url", "^https?://", ""), F.lit("/..//b")
    )
    return read(spark, d, "pages").select("page_id", text.clean_path(raw).alias("path"))


@query(
    "dangling_entries",
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 7 <> 0)",
)
def dangling_entries(spark: SparkSession, d: str) -> DataFrame:
    there = read(spark, d, "customer").where("c_custkey % 7 <> 0")
    return integrity.dangling(read(spark, d, "orders"), "o_custkey", there, "c_custkey").select("o_orderkey")


@query(
    "orphan_shards",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b
      WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_quantity >= 10) GROUP BY 1, 2""",
)
def orphan_shards(spark: SparkSession, d: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    shards = read(spark, d, "lineitem").select(*keys, "l_quantity")
    return integrity.unreferenced(shards, shards.where("l_quantity >= 10"), keys).groupBy(*keys).agg(F.count("*").alias("copies"))


@query(
    "damage_classes",
    f"""WITH {DISKS_SQL}, j AS (SELECT l.*, status, id FROM lineitem l LEFT JOIN (SELECT * FROM disks WHERE id % 8 <> 6) ON id = l_suppkey),
    c AS (SELECT CASE WHEN l_linenumber > 6 THEN 'invalid-slot' WHEN id IS NULL THEN 'missing-disk'
      WHEN status IN ('failed', 'offline', 'removed') THEN 'unavailable' WHEN l_discount > 0.09 THEN 'missing'
      WHEN l_tax > 0.07 THEN 'checksum' ELSE 'ok' END AS damage FROM j)
    SELECT damage, count(*) AS shards FROM c GROUP BY 1""",
)
def damage_classes(spark: SparkSession, d: str) -> DataFrame:
    fleet = disks(spark, d).where("id % 8 <> 6").select("id", "status")
    rows = read(spark, d, "lineitem").join(fleet, F.col("l_suppkey") == F.col("id"), "left")
    damage = integrity.damage_class(
        F.col("id").isNotNull(), F.col("status"), F.col("l_linenumber") <= 6, F.col("l_discount") <= 0.09,
        F.col("l_tax") <= 0.07, health.UNAVAILABLE,
    )
    return rows.groupBy(damage.alias("damage")).agg(F.count("*").alias("shards"))


LAYOUTS_SQL = "layouts AS (SELECT 'layout-' || lpad(n_nationkey::VARCHAR, 4, '0') AS id, n_nationkey % 4 + 1 AS k, n_nationkey % 3 AS m FROM nation WHERE n_nationkey % 5 <> 4)"
BLOCKS_SQL = "blocks AS (SELECT o_orderkey, CASE WHEN o_orderkey % 30 = 0 THEN '' ELSE 'layout-' || lpad((o_orderkey % 30)::VARCHAR, 4, '0') END AS layout_id FROM orders)"


def _layouts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.concat(F.lit("layout-"), F.lpad(k.cast("string"), 4, "0"))
    return read(spark, d, "nation").where("n_nationkey % 5 <> 4").select(name.alias("id"), (k % 4 + 1).alias("k"), (k % 3).alias("m"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") % 30
    name = F.when(n == 0, "").otherwise(F.concat(F.lit("layout-"), F.lpad(n.cast("string"), 4, "0")))
    return read(spark, d, "orders").select("o_orderkey", name.alias("layout_id"))


@query(
    "layout_lookup",
    f"""WITH {LAYOUTS_SQL}, {BLOCKS_SQL} SELECT o_orderkey, coalesce(nullif(layout_id, ''), 'layout-0000') AS layout_id, coalesce(k, -1) AS k, coalesce(m, -1) AS m
    FROM blocks LEFT JOIN layouts ON id = coalesce(nullif(layout_id, ''), 'layout-0000')""",
)
def layout_lookup(spark: SparkSession, d: str) -> DataFrame:
    of = F.coalesce(F.nullif("layout_id", F.lit("")), F.lit("layout-0000"))
    rows = _blocks(spark, d).select("o_orderkey", of.alias("layout_id"))
    return rows.join(_layouts(spark, d).withColumnRenamed("id", "layout_id"), "layout_id", "left").fillna(-1, ["k", "m"])


@query(
    "min_redundancy",
    f"""WITH {LAYOUTS_SQL}, {BLOCKS_SQL} SELECT coalesce(min(m), 2) AS redundancy FROM blocks
    JOIN layouts ON id = coalesce(nullif(layout_id, ''), 'layout-0000')""",
)
def min_redundancy(spark: SparkSession, d: str) -> DataFrame:
    from fleetquery.operators.capacity import minimum_redundancy

    return minimum_redundancy(_blocks(spark, d), _layouts(spark, d), 2)


@query(
    "reshape_candidates",
    f"""WITH {BLOCKS_SQL} SELECT o_custkey AS file, count(*) AS stale FROM blocks JOIN orders USING (o_orderkey)
    WHERE coalesce(nullif(layout_id, ''), 'layout-0000') <> 'layout-0003' GROUP BY 1""",
)
def reshape_candidates(spark: SparkSession, d: str) -> DataFrame:
    of = F.coalesce(F.nullif("layout_id", F.lit("")), F.lit("layout-0000"))
    rows = _blocks(spark, d).where(of != "layout-0003").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return rows.groupBy(F.col("o_custkey").alias("file")).agg(F.count("*").alias("stale"))


@query(
    "drain_targets",
    "SELECT DISTINCT l_orderkey AS file FROM lineitem WHERE l_suppkey = 3",
)
def drain_targets(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").where("l_suppkey = 3").select(F.col("l_orderkey").alias("file")).distinct()


@query(
    "page_reassembly",
    """SELECT o_orderkey, count(l_partkey) AS items, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax), '') AS parts
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""",
)
def page_reassembly(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = integrity.paged(read(spark, d, "lineitem"), "l_orderkey", order, 3)
    pages = lines.groupBy("l_orderkey", "page").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("slot", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts")
    )
    core = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = integrity.reassembled(core, "l_orderkey", pages, "page", "parts")
    return rows.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.size("items").cast("long").alias("items"),
        F.array_join(F.col("items").cast("array<string>"), ",").alias("parts"),
    )


ROW_SQL = "sha256(o_orderstatus || chr(31) || o_custkey || chr(31) || {0})"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "orders")
    part = F.col("o_orderkey")
    hashed = lambda tail: hashing.row_hash(F.col("o_orderstatus"), F.col("o_custkey"), tail).alias("body")
    old = rows.where("o_orderkey % 10 <> 3").select("o_orderkey", hashed(F.lit("a")))
    changed = F.when(part % 5 == 0, "b").otherwise("a")
    return old, rows.where("o_orderkey % 10 <> 7").select("o_orderkey", hashed(changed))


VERSIONS_SQL = f"""o AS (SELECT o_orderkey, {ROW_SQL.format("'a'")} AS body FROM orders WHERE o_orderkey % 10 <> 3),
n AS (SELECT o_orderkey, {ROW_SQL.format("CASE WHEN o_orderkey % 5 = 0 THEN 'b' ELSE 'a' END")} AS body FROM orders WHERE o_orderkey % 10 <> 7)"""


@query(
    "page_delta",
    f"""WITH {VERSIONS_SQL} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
      CASE WHEN n.body IS NULL THEN 'delete' ELSE 'put' END AS op FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey
    WHERE o.body IS DISTINCT FROM n.body""",
)
def page_delta(spark: SparkSession, d: str) -> DataFrame:
    return integrity.page_delta(*_versions(spark, d), ["o_orderkey"], "body")


@query(
    "tree_compare",
    f"""WITH {VERSIONS_SQL} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
      CASE WHEN n.body IS NULL THEN 'missing' WHEN o.body IS NULL THEN 'extra' ELSE 'body' END AS verdict
    FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.body IS DISTINCT FROM n.body""",
)
def tree_compare(spark: SparkSession, d: str) -> DataFrame:
    return integrity.tree_compare(*_versions(spark, d), "o_orderkey", ["body"])


@query(
    "json_delta",
    f"""WITH a AS (SELECT user_id, event_type AS pointer, max(value) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2),
    b AS (SELECT user_id, event_type AS pointer, max(value) AS v FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.pointer, b.pointer) AS pointer,
      CASE WHEN b.v IS NULL THEN 'remove' WHEN a.v IS NULL THEN 'add' ELSE 'replace' END AS op, b.v AS value
    FROM a FULL JOIN b ON a.user_id = b.user_id AND a.pointer = b.pointer WHERE a.v IS DISTINCT FROM b.v""",
)
def json_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumnRenamed("event_type", "pointer")
    side = lambda n: rows.where(f"event_id % {n} <> 0").groupBy("user_id", "pointer").agg(F.max("value").alias("value"))
    return integrity.flat_json_delta(side(3), side(5), ["user_id"])


@query(
    "hardlink_groups",
    "SELECT sha256(text) AS identity, count(*) AS links, min(doc_id) AS first_name FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def hardlink_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.sha2("text", 256).alias("identity"), "doc_id")
    return integrity.linked_groups(rows, "identity", "doc_id")


@query(
    "relational_division",
    """WITH p AS (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus || l_linenumber AS f FROM lineitem WHERE l_quantity > 20)
    SELECT l_suppkey, count(*) AS held FROM p GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT f) FROM p)""",
)
def relational_division(spark: SparkSession, d: str) -> DataFrame:
    item = F.concat("l_returnflag", "l_linestatus", "l_linenumber")
    pairs = read(spark, d, "lineitem").where("l_quantity > 20").select("l_suppkey", item.alias("f"))
    return integrity.covering(pairs, "l_suppkey", "f")


@query(
    "duplicate_members",
    "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicated(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "first_of_each",
    "SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1",
)
def first_of_each(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    return integrity.first_of_each(rows, ["s_nationkey"], ["s_suppkey"])


ISLANDS_SQL = f"""{INTERVALS_SQL}, m AS (SELECT *, max(e) OVER (PARTITION BY ino ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ivals WHERE s < e),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY ino ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m),
islands AS (SELECT ino, min(s) AS s, max(e) AS e FROM g GROUP BY ino, i)"""


@query("extent_coalesce", f'WITH {ISLANDS_SQL} SELECT ino, s AS "start", e AS "end" FROM islands')
def extent_coalesce(spark: SparkSession, d: str) -> DataFrame:
    return intervals.coalesce(stand_ins.intervals(spark, d), ["ino"])


@query(
    "extent_overlap",
    f"""WITH {INTERVALS_SQL}, p AS (SELECT *, lag(e) OVER (PARTITION BY ino ORDER BY s, e, disk) AS pe FROM ivals)
    SELECT ino, disk, s AS "start", e AS "end", pe AS previous_end FROM p WHERE s < pe""",
)
def extent_overlap(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlaps(stand_ins.intervals(spark, d), ["ino"], ["disk"])


@query(
    "seek_data_hole",
    f"""WITH {ISLANDS_SQL} SELECT ino, coalesce(min(CASE WHEN e > 900 THEN greatest(s, 900) END), -1) AS data,
      coalesce(max(CASE WHEN s <= 900 AND e > 900 THEN e END), 900) AS hole FROM islands GROUP BY 1""",
)
def seek_data_hole(spark: SparkSession, d: str) -> DataFrame:
    islands = intervals.coalesce(stand_ins.intervals(spark, d), ["ino"])
    return intervals.next_data(islands, ["ino"], F.lit(900).cast("long")).fillna(-1, ["data"])


@query(
    "range_window_clip",
    f'WITH {INTERVALS_SQL} SELECT ino, disk, greatest(s, 800) AS "start", least(e, 1000) AS "end" FROM ivals WHERE s < 1000 AND e > 800',
)
def range_window_clip(spark: SparkSession, d: str) -> DataFrame:
    low, high = F.lit(800).cast("long"), F.lit(1000).cast("long")
    return intervals.clip(stand_ins.intervals(spark, d), low, high)


@query(
    "range_overlap_join",
    f"""WITH {INTERVALS_SQL}, r AS (SELECT s_suppkey AS disk, s_suppkey * 37 % 2000 AS s, s_suppkey * 37 % 2000 + 90 AS e FROM supplier)
    SELECT ivals.disk, ino, ivals.s AS "start", ivals.e AS "end", r.s AS right_start, r.e AS right_end
    FROM ivals JOIN r ON ivals.disk = r.disk AND ivals.s < r.e AND r.s < ivals.e WHERE ivals.s < ivals.e""",
)
def range_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("s_suppkey") * 37 % 2000
    free = read(spark, d, "supplier").select(F.col("s_suppkey").alias("disk"), start.alias("start"), (start + 90).alias("end"))
    return intervals.overlap_join(stand_ins.intervals(spark, d), free, ["disk"], 64)


@query(
    "stripe_layout",
    """WITH s AS (SELECT doc_id, n_chars AS size, unnest(range(greatest(CAST(ceil(n_chars / 1024.0) AS BIGINT), 1))) AS stripe FROM documents)
    SELECT doc_id, stripe, printf('s%016x', doc_id * 1000000 + stripe) AS stripe_id, stripe * 1024 AS raw_offset,
      greatest(least(size - stripe * 1024, 1024), 0) AS raw_size,
      CAST(ceil(greatest(least(size - stripe * 1024, 1024), 1) / 4.0) AS BIGINT) AS shard_size FROM s""",
)
def stripe_layout(spark: SparkSession, d: str) -> DataFrame:
    rows = placement.stripes(read(spark, d, "documents").select("doc_id", "n_chars"), F.col("n_chars"), 256, 4)
    number = F.col("doc_id") * 1000000 + F.col("stripe")
    return rows.select("doc_id", "stripe", placement.stripe_id(number).alias("stripe_id"), "raw_offset", "raw_size", "shard_size")


@query(
    "cyclic_scan",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey <= 1000, o_orderkey LIMIT 700",
)
def cyclic_scan(spark: SparkSession, d: str) -> DataFrame:
    return folds.cyclic_page(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 700)


@query(
    "lru_evict",
    """WITH h AS (SELECT event_id, user_id, sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM events)
    SELECT user_id, event_id FROM h WHERE held > 100000""",
)
def lru_evict(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").withColumn("size", F.floor(F.col("value") * 100).cast("long"))
    return folds.lru_evicted(rows, "user_id", ["ts", "event_id"], "size", 100000).select("user_id", "event_id")


GIDS = "[CAST(c_custkey % 4 AS INT), CAST(c_nationkey AS INT)]"


def _identities(spark: SparkSession, d: str) -> DataFrame:
    """Customers as files: owner, group and mode from their columns, asked for
    by another's identity."""
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(
        k.alias("ino"),
        F.when(k % 5 == 0, "directory").otherwise("file").alias("kind"),
        (k * 7 % 512).cast("int").alias("mode"),
        (k % 6).cast("int").alias("owner"),
        (k % 5).cast("int").alias("grp"),
        (k % 9).cast("int").alias("uid"),
        F.array((k % 4).cast("int"), F.col("c_nationkey").cast("int")).alias("gids"),
        (k % 7 + 1).cast("int").alias("req"),
    )


IDENT_SQL = f"""f AS (SELECT c_custkey AS ino, CASE WHEN c_custkey % 5 = 0 THEN 'directory' ELSE 'file' END AS kind,
  CAST(c_custkey * 7 % 512 AS INT) AS mode, CAST(c_custkey % 6 AS INT) AS owner, CAST(c_custkey % 5 AS INT) AS grp,
  CAST(c_custkey % 9 AS INT) AS uid, {GIDS} AS gids, CAST(c_custkey % 7 + 1 AS INT) AS req FROM customer)"""
MODE_SQL = "(((CASE WHEN uid = owner THEN mode >> 6 WHEN list_contains(gids, grp) THEN mode >> 3 ELSE mode END) & 7 & req) = req)"


@query(
    "mode_access",
    f"""WITH {IDENT_SQL} SELECT ino, CASE WHEN uid = 0 THEN (req & 1) = 0 OR kind = 'directory' OR (mode & 73) <> 0 ELSE {MODE_SQL} END AS allowed FROM f""",
)
def mode_access(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<struct<type:string,principal:string,flags:array<string>,bits:int>>")
    posix = F.array().cast("array<struct<tag:string,id:int,perms:int>>")
    allowed = access.access(
        F.col("kind"), F.col("mode"), F.col("owner"), F.col("grp"), none, posix, F.col("uid"), F.col("gids"), F.col("req")
    )
    return _identities(spark, d).select("ino", allowed.alias("allowed"))


@query(
    "posix_access",
    f"""WITH {IDENT_SQL}, p AS (SELECT *, mode & 7 AS mask, (mode >> 2) & 7 AS u3, (mode >> 1) & 7 AS g2, (mode >> 4) & 7 AS g7 FROM f)
    SELECT ino, CASE WHEN uid = owner THEN (((mode >> 6) & 7) & req) = req
      WHEN uid = 3 THEN ((u3 & mask) & req) = req
      WHEN list_contains(gids, grp) OR list_contains(gids, 2) OR list_contains(gids, 7) THEN
        (((CASE WHEN list_contains(gids, grp) THEN (mode >> 3) & 7 ELSE 0 END | CASE WHEN list_contains(gids, 2) THEN g2 ELSE 0 END
          | CASE WHEN list_contains(gids, 7) THEN g7 ELSE 0 END) & mask) & req) = req
      ELSE ((mode & 7) & req) = req END AS allowed FROM p""",
)
def posix_access(spark: SparkSession, d: str) -> DataFrame:
    mode = F.col("mode")
    bits = lambda shift: F.shiftright(mode, shift).bitwiseAND(F.lit(7))
    entry = lambda tag, who, perms: F.struct(
        F.lit(tag).alias("tag"), F.lit(who).cast("int").alias("id"), perms.alias("perms")
    )
    entries = F.array(
        entry("mask", None, bits(0)), entry("user", 3, bits(2)), entry("group", 2, bits(1)), entry("group", 7, bits(4))
    )
    allowed = access.posix_access(entries, mode, F.col("owner"), F.col("grp"), F.col("uid"), F.col("gids"), F.col("req"))
    return _identities(spark, d).select("ino", allowed.alias("allowed"))


@query(
    "nfs4_access",
    f"""WITH {IDENT_SQL}, m AS (SELECT *, uid = owner AS o, list_contains(gids, grp) AS g, uid = 4 AS u4 FROM f),
    d1 AS (SELECT *, CASE WHEN u4 AND (2 & req) <> 0 THEN 1 ELSE 0 END AS denied, req AS left1 FROM m),
    a2 AS (SELECT *, CASE WHEN o THEN left1 & ~6 ELSE left1 END AS left2 FROM d1),
    a3 AS (SELECT *, CASE WHEN g THEN left2 & ~5 ELSE left2 END AS left3 FROM a2)
    SELECT ino, denied = 0 AND (CASE WHEN left3 = 0 THEN true ELSE (left3 & ~1) = 0 END) AS allowed FROM a3""",
)
def nfs4_access(spark: SparkSession, d: str) -> DataFrame:
    def ace(kind: str, principal: str, names: list[str], flags: tuple[str, ...] = ()):  # type: ignore[no-untyped-def]
        held = F.array(*[F.lit(x) for x in flags]).cast("array<string>")
        return F.struct(
            F.lit(kind).alias("type"), F.lit(principal).alias("principal"), held.alias("flags"),
            access.permission_bits(F.array(*[F.lit(n) for n in names])).alias("bits"),
        )

    entries = F.array(
        ace("deny", "EVERYONE@", ["r"], ("inherit-only",)),
        ace("deny", "uid:4", ["append-data"]),
        ace("allow", "OWNER@", ["read-data", "write-data"]),
        ace("allow", "GROUP@", ["read", "execute"]),
        ace("allow", "EVERYONE@", ["x"]),
    )
    allowed = access.nfs4_access(entries, F.col("owner"), F.col("grp"), F.col("uid"), F.col("gids"), F.col("req"))
    return _identities(spark, d).select("ino", allowed.alias("allowed"))


@query(
    "sticky_rule",
    f"""WITH {IDENT_SQL} SELECT ino, (mode & 64) = 0 OR uid = 0 OR uid = owner OR uid = grp AS allowed FROM f""",
)
def sticky_rule(spark: SparkSession, d: str) -> DataFrame:
    sticky = F.shiftleft(F.shiftright(F.col("mode"), 6).bitwiseAND(F.lit(1)), 9)
    allowed = access.sticky_allows(sticky, F.col("owner"), F.col("grp"), F.col("uid"))
    return _identities(spark, d).select("ino", allowed.alias("allowed"))


ACL_SQL = "'u::' || r || 'w-' || CASE WHEN k % 3 = 0 THEN ',user:' || k || ':r-x' ELSE '' END || CASE WHEN k % 4 = 0 THEN ',m::rwx' ELSE '' END || ',g::r--' || CASE WHEN k % 5 = 0 THEN '' ELSE ',other::---' END"


@query(
    "acl_text",
    """WITH c AS (SELECT c_custkey AS k FROM customer)
    SELECT k, CAST(3 + (k % 3 = 0)::INT + (k % 4 = 0)::INT - (k % 5 = 0)::INT AS INT) AS entries,
      concat_ws(',', CASE WHEN k % 5 = 0 THEN 'one other needed' END, CASE WHEN k % 3 = 0 AND k % 4 <> 0 THEN 'mask needed' END) AS problems,
      CASE WHEN k % 2 = 0 THEN 6 ELSE 2 END AS owner_bits FROM c""",
)
def acl_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    spec = F.concat(
        F.when(k % 2 == 0, "u::rw-").otherwise("u::-w-"),
        F.when(k % 3 == 0, F.concat(F.lit(",user:"), k, F.lit(":r-x"))).otherwise(""),
        F.when(k % 4 == 0, ",m::rwx").otherwise(""),
        F.lit(",g::r--"),
        F.when(k % 5 == 0, "").otherwise(",other::---"),
    )
    rows = read(spark, d, "customer").select(k.alias("k"), access.parse_acl_text(spec).alias("acl"))
    problems = F.concat_ws(",", access.acl_problems(F.col("acl")))
    return rows.select("k", F.size("acl").alias("entries"), problems.alias("problems"), F.element_at("acl", 1)["perms"].alias("owner_bits"))


SIZES = ["64KiB", "1_000", " 2 GB ", "5t", "x", "", "7QiB", "9999999999999999999", "3Mb", "10 b", "_", "0x10", "12kib"]


@query(
    "parse_sizes",
    """SELECT size, coalesce(bytes, -1) AS bytes FROM (VALUES ('64KiB', 65536::BIGINT), ('1_000', 1000), (' 2 GB ', 2000000000), ('5t', 5000000000000), ('x', NULL), ('', NULL),
      ('7QiB', NULL), ('9999999999999999999', NULL), ('3Mb', 3000000), ('10 b', 10), ('_', NULL), ('0x10', NULL), ('12kib', 12288)) v(size, bytes)""",
)
def parse_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in SIZES], "size string")
    return rows.select("size", F.coalesce(text.parse_byte_size(F.col("size")), F.lit(-1)).alias("bytes"))


@query(
    "parse_numbers",
    "SELECT t, coalesce(n, -1) AS n FROM (VALUES ('755', 493::BIGINT), ('75', 75), ('0x1F', 31), ('0o17', 15), ('890', 890), ('abc', NULL), (' 0644 ', 420)) v(t, n)",
)
def parse_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in ("755", "75", "0x1F", "0o17", "890", "abc", " 0644 ")], "t string")
    return rows.select("t", F.coalesce(text.parse_auto_int(F.col("t")), F.lit(-1)).alias("n"))


@query(
    "xattr_namespace",
    """WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'user.' WHEN 1 THEN 'trusted.' WHEN 2 THEN 'security.' WHEN 3 THEN 'system.' ELSE 'other.' END || source AS name FROM documents)
    SELECT doc_id, CASE WHEN starts_with(name, 'user.') THEN 'user' WHEN starts_with(name, 'trusted.') THEN 'trusted'
      WHEN starts_with(name, 'security.') THEN 'security' WHEN starts_with(name, 'system.') THEN 'system' END AS space FROM x""",
)
def xattr_namespace(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("user.", "trusted.", "security.", "system.", "other.")])
    name = F.concat(F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")), F.col("source"))
    return read(spark, d, "documents").select("doc_id", text.xattr_space(name).alias("space"))


@query(
    "smart_missing_fields",
    """SELECT c_custkey, array_to_string(list_filter(['wear', 'temperature', 'pending', 'reallocated'],
      lambda x: NOT list_contains([CASE WHEN c_custkey % 2 = 0 THEN 'wear' END, CASE WHEN c_custkey % 3 = 0 THEN 'temperature' END, 'pending'], x)), ',') AS missing FROM customer""",
)
def smart_missing_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    expected = F.array(*[F.lit(x) for x in ("wear", "temperature", "pending", "reallocated")])
    seen = F.array_compact(F.array(F.when(k % 2 == 0, "wear"), F.when(k % 3 == 0, "temperature"), F.lit("pending")))
    return read(spark, d, "customer").select("c_custkey", F.array_join(F.array_except(expected, seen), ",").alias("missing"))


@query(
    "label_escape",
    r"""SELECT page_id, replace(replace(replace(url || chr(10) || '"\', '\', '\\'), '"', '\"'), chr(10), '\n') AS label,
      regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS snapshot FROM pages""",
)
def label_escape(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("url"), F.lit('\n"\\'))
    return read(spark, d, "pages").select(
        "page_id", text.escape_label(raw).alias("label"), text.snapshot_name(F.col("url")).alias("snapshot")
    )


@query("encrypted_blocks", "SELECT count(*) FILTER (o_orderkey % 4 = 1) AS encrypted, count(*) AS blocks FROM orders")
def encrypted_blocks(spark: SparkSession, d: str) -> DataFrame:
    return integrity.encrypted_blocks(read(spark, d, "orders"), F.col("o_orderkey") % 4 == 1)


@query(
    "widest_layout",
    f"WITH {LAYOUTS_SQL} SELECT greatest(coalesce(max(k + m), 0), 3) AS width FROM layouts",
)
def widest_layout(spark: SparkSession, d: str) -> DataFrame:
    from fleetquery.operators.capacity import widest_layout as widest

    return widest(_layouts(spark, d), 3)


@query(
    "source_layouts",
    f"""WITH {BLOCKS_SQL} SELECT DISTINCT coalesce(nullif(layout_id, ''), 'layout-0000') AS layout_id FROM blocks
    WHERE coalesce(nullif(layout_id, ''), 'layout-0000') <> 'layout-0003'""",
)
def source_layouts(spark: SparkSession, d: str) -> DataFrame:
    of = F.coalesce(F.nullif("layout_id", F.lit("")), F.lit("layout-0000"))
    return integrity.source_layouts(_blocks(spark, d).select(of.alias("layout_id")), "layout_id", "layout-0003")


@query(
    "listed_attributes",
    """SELECT user_id AS file, 'user.' || event_type AS name FROM events
    UNION SELECT user_id, 'system.posix_acl_access' FROM events WHERE event_type = 'signup'""",
)
def listed_attributes(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "events").select(F.col("user_id").alias("file"), "event_type")
    stored = rows.select("file", F.concat(F.lit("user."), "event_type").alias("name"))
    made = rows.where("event_type = 'signup'").select("file", F.lit("system.posix_acl_access").alias("name"))
    return integrity.either(stored, made)
