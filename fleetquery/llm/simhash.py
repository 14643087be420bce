"""SimHash near-duplicates found with BK-trees (operator 5).

Fingerprints within a small Hamming radius r agree on at least two of r + 2
blocks of their bits, so each distinct fingerprint is dealt to one shard for
every pair of blocks. A shard is indexed by a BK-tree: a child hangs below its
parent on the edge whose key is their Hamming distance, and a search follows
only edges within the radius of the distance at hand. Shards are small
whatever the corpus; one that is not is cut into trees of bounded size, and
its fingerprints visit them in blocks of the same size, so a task holds one
tree and one block at a time. Trees are built where a shuffle brings them, not
broadcast: they hold the fingerprints of all documents, which must not pass
through the driver and have no size bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetquery.llm.common import join_groups, table, written
from fleetquery.llm.graph import components

#: Fingerprints in one BK-tree at most.
TREE_SIZE = 4096
_CHUNK = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each run of ``size`` words, in blocks."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if words and len(words) < size:
        yield np.array([digest(join(words), 42)], np.uint64)
        return
    for at in range(0, len(words) - size + 1, _CHUNK):
        part = words[at : at + _CHUNK + size - 1]
        runs = zip(*(part[i:] for i in range(size)))
        yield np.fromiter((digest(join(x), 42) for x in runs), np.uint64)


def fingerprint(words: list[bytes], size: int) -> int:
    """64 bits as a signed integer: each set in over half of the hashes."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(words, size):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0]) if total else 0


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, fp of every row. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(words_of(x.as_py()), size) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


_ALL_BITS = (1 << 64) - 1


def hamming(a: int, b: int) -> int:
    """Differing bits of two 64-bit integers; of signed ones too, whose XOR
    may be negative, and a negative integer counts the bits of its opposite."""
    return ((a ^ b) & _ALL_BITS).bit_count()


class BKTree:
    """64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node, edges = self.root
        while distance := hamming(node, value):
            if distance not in edges:
                edges[distance] = (value, {})
                return
            node, edges = edges[distance]

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [self.root] if self.root else []
        while stack:
            node, edges = stack.pop()
            distance = hamming(node, value)
            if distance <= radius:
                found.append(node)
            for key in range(max(1, distance - radius), distance + radius + 1):
                if key in edges:
                    stack.append(edges[key])
        return found


def tree_links(visitors: list[int], tree_members: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join what the radius joins: at most one for each of both."""
    tree, parent = BKTree(), {x: x for x in (*visitors, *tree_members)}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x in tree_members:
        tree.add(x)
    links = []
    for x in visitors:
        for y in tree.within(x, radius):
            a, b = top(x), top(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((x, y))
    return links


def blocks(radius: int) -> list[tuple[int, int]]:
    """First bit and width of each of ``radius + 2`` blocks of 64 bits."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def cells(fps: DataFrame, radius: int, tree_size: int = TREE_SIZE) -> DataFrame:
    """key, tree, block, fp, in_tree, visits: who stands in which tree and who
    visits it, with about ``tree_size`` of either to a cell.

    A shard of several trees has a cell for each tree and each block of its
    fingerprints that comes no later than the tree: each pair of fingerprints
    meets in one of them.
    """
    cut = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in blocks(radius)]
    pairs = combinations(range(radius + 2), 2)
    keys = F.array(*[F.xxhash64(F.lit(n), cut[i], cut[j]) for n, (i, j) in enumerate(pairs)])
    dealt = fps.select(F.col("fp").alias("doc_id"), F.explode(keys).alias("key"))
    sizes = dealt.groupBy(F.col("key").alias("group_key")).agg(F.count("*").alias("rows")).where("rows > 1")
    sizes = written(sizes, "shards")
    dealt = join_groups(dealt, "key", sizes, "group_key", "rows").where("rows IS NOT NULL")
    trees = F.ceil(F.col("rows") / tree_size).cast("int")
    dealt = dealt.select("key", F.col("doc_id").alias("fp"), trees.alias("trees"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), "trees").cast("int"))
    cell = lambda t, b, i, v: F.struct(t.alias("tree"), b.alias("block"), F.lit(i).alias("in_tree"), F.lit(v).alias("visits"))
    own, last = F.col("own"), F.col("trees") - 1
    others = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    stands = F.transform(others(F.lit(0), own - 1), lambda b: cell(own, b, True, False))
    visits = F.transform(others(own + 1, last), lambda t: cell(t, own, False, True))
    rows = dealt.select("key", "fp", F.explode(F.concat(F.array(cell(own, own, True, True)), stands, visits)).alias("c"))
    return rows.select("key", "c.tree", "c.block", "fp", "c.in_tree", "c.visits")


def links(fps: DataFrame, radius: int, tree_size: int = TREE_SIZE) -> DataFrame:
    """src, dst: links between the distinct fingerprints ``fps.fp`` that hold
    together whatever a Hamming distance of ``radius`` or less connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            found = tree_links([x for x, _, v in rows if v], [x for x, t, _ in rows if t], radius)
            src, dst = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

        at, rows = None, []
        for batch in batches:
            names = ("key", "tree", "block", "fp", "in_tree", "visits")
            for *cell, fp, in_tree, visits in zip(*(batch.column(c).to_pylist() for c in names)):
                if cell != at:
                    if len(rows) > 1:
                        yield out()
                    at, rows = cell, []
                rows.append((fp, in_tree, visits))
        if len(rows) > 1:
            yield out()

    order = ["key", "tree", "block"]
    shards = cells(fps, radius, tree_size).repartition(*order).sortWithinPartitions(*order)
    return shards.mapInArrow(run, "src long, dst long").distinct()


def near_components(marked: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp, component_id of ``marked`` (doc_id, fp).

    Copies meet in their fingerprint before any linking; component_id is the
    least doc_id that links reach.
    """
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")), "fps")
    roots = components(links(fps, radius))
    linked = roots.join(fps, roots["node"] == fps["fp"]).select("node", "root", "first_doc")
    ids = linked.groupBy("root").agg(F.min("first_doc").alias("component"))
    linked = linked.join(ids, "root").select(F.col("node").alias("linked_fp"), "component")
    named = fps.join(linked, F.col("fp") == F.col("linked_fp"), "left")
    named = named.select(F.col("fp").alias("named_fp"), F.coalesce("component", "first_doc").alias("component_id"), "copies")
    return join_groups(marked, "fp", named, "named_fp", "copies").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = written(fingerprints(table(spark, sf_dir, "documents"), 3), "simhash")
    found = near_components(marked, 2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
