"""Near-duplicate removal over word shingles (operator 5 as a corpus stage).

Documents are near copies when their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Candidates come from SimHash fingerprints linked by
BK-trees; since copies of that similarity differ in up to about 14 of 64 bits,
more than any radius that can be searched at scale, bands of min-hashes add
the candidates that the radius misses. Inside a bucket each document is paired
first with the bucket's least and greatest document, never with all others, and
every pair is verified on the whole texts. Where a bucket's documents are then
not all connected, strangers that share a template with many others stand
between copies: such buckets are sorted by further min-hashes, which brings
copies close together, and each document is paired with the most alike of its
neighbours that it is not yet connected with, round after round until a round
finds no link.

The rounds only connect most copies early. What they leave is searched exactly:
in each bucket that is not connected every pair of documents that are not is
compared, and left out only if bitmaps of their shingle sets prove that too
many differ; all others are verified. So all near copies that share a bucket
are connected. Of each connected group the least doc_id stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetquery.llm.common import bitmap_of, in_bitmap, join_groups, partitions, written
from fleetquery.llm.graph import components
from fleetquery.llm.simhash import fingerprint, links, shingle_hashes, words_of

BANDS, BAND_ROWS = 20, 5
#: Members that are compared with one representative in one task's group.
GROUP_SIZE = 128
#: Neighbours in a sorted bucket whose min-hashes are compared; of those that
#: agree in ALIKE of the min-hashes at least, the BEST are verified in a round.
NEIGHBOURS, ALIKE, BEST = 64, 0.68, 4
#: Documents of a bucket whose bitmaps are compared with as many others in a task.
BLOCK = 512
_ODD = np.random.default_rng(20).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(21).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """Sorted hashes of the different shingles of a text."""
    found = list(shingle_hashes(words, size))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """Least mixed hash for each row of each band; without words all the same."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * _ODD + _ADD
        mixed ^= mixed >> np.uint64(29)
        np.minimum(least, (mixed * _ODD[::-1]).min(0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; texts without words share theirs."""
    rows = least.reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for n in range(BAND_ROWS):
        key = (key ^ rows[:, n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def parity(hashes: np.ndarray) -> bytes:
    """A bitmap of a set, two bits or more for each member: each bit tells if
    an odd number of members fall on it. Two sets differ in at least as many
    members as their bitmaps in bits."""
    bits = max(2 * len(hashes) - 1, 63).bit_length()
    counts = np.bincount((hashes & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, fp, bands, sig (the lowest byte of each min-hash), n (shingles)
    and bits (``parity``) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, sigs, sizes, bits = [], [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                fps.append(fingerprint(words, size))
                own = shingles(words, size)
                least = min_hashes(own)
                keys.append(band_keys(least).view(np.int64))
                sigs.append(least.astype(np.uint8).tobytes())
                sizes.append(len(own))
                bits.append(parity(own))
            ends = pa.array(np.arange(0, BANDS * len(fps) + 1, BANDS), pa.int32())
            values = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            columns = [batch.column("doc_id"), pa.array(fps, pa.int64()), pa.ListArray.from_arrays(ends, values)]
            columns += [pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "bands", "sig", "n", "bits"])

    fields = "doc_id long, fp long, bands array<long>, sig binary, n long, bits binary"
    return docs.select("doc_id", "text").mapInArrow(run, fields)


def candidates(signed: DataFrame, radius: int) -> DataFrame:
    """rep, member (rep < member): pairs to verify; a bucket gives each of its
    members two at most."""
    cells = signed.select("doc_id", F.posexplode("bands").alias("band", "key"))
    ends = cells.groupBy("band", "key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    ends = ends.where("low < high")
    met = cells.join(ends, ["band", "key"]).select("doc_id", F.explode(F.array("low", "high")).alias("other"))
    fps = written(signed.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "near-fps")
    same = signed.join(fps, "fp").select("doc_id", F.col("first_doc").alias("other"))
    linked = written(links(fps, radius), "near-linked")
    first, second = fps.toDF("src", "doc_id"), fps.toDF("dst", "other")
    linked = linked.join(first, "src").join(second, "dst").select("doc_id", "other")
    pairs = met.unionByName(same).unionByName(linked).where("doc_id != other")
    return pairs.select(F.least("doc_id", "other").alias("rep"), F.greatest("doc_id", "other").alias("member")).distinct()


def alike_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, member of sorted rows (band, key, doc_id, root, sig): each with the
    BEST of the NEIGHBOURS before it in its bucket that have another root."""
    names = ("band", "key", "doc_id", "root")
    held = {n: np.zeros(0, np.int64) for n in names}
    sigs = np.zeros((0, BANDS * BAND_ROWS), np.uint8)
    for batch in batches:
        own = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, BANDS * BAND_ROWS)
        new, sigs = len(own), np.concatenate([sigs, own])
        held = {n: np.concatenate([held[n], batch.column(n).to_numpy().astype(np.int64)]) for n in names}
        first = len(sigs) - new
        rows = np.arange(first, len(sigs))
        agree = np.zeros((new, NEIGHBOURS), np.int32)
        for back in range(1, NEIGHBOURS + 1):
            at = rows[rows >= back]
            same = (held["band"][at] == held["band"][at - back]) & (held["key"][at] == held["key"][at - back])
            at = at[same & (held["root"][at] != held["root"][at - back])]
            agree[at - first, back - 1] = (sigs[at] == sigs[at - back]).sum(1)
        best = np.argsort(-agree, axis=1, kind="stable")[:, :BEST]
        row, place = np.nonzero(np.take_along_axis(agree, best, 1) >= ALIKE * BANDS * BAND_ROWS)
        a, b = held["doc_id"][row + first], held["doc_id"][row + first - best[row, place] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["rep", "member"])
        sigs, held = sigs[-NEIGHBOURS:], {n: x[-NEIGHBOURS:] for n, x in held.items()}


def rooted(signed: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with a doc_id, and the root of what they are connected with so far."""
    rows = signed.where("doc_id IS NOT NULL").join(roots.toDF("node", "own_root"), F.col("doc_id") == F.col("node"), "left")
    return rows.select(*signed.columns, F.coalesce("own_root", "doc_id").alias("root"))


def further_candidates(signed: DataFrame, roots: DataFrame, tested: DataFrame, turn: int) -> DataFrame:
    """rep, member: likely pairs, not yet tested, in buckets that are not
    connected; ``remaining_candidates`` has those that no turn gives.

    Buckets are sorted by min-hashes of other bands, others in each turn, and
    cut by range: a bucket of any size is dealt to many tasks.
    """
    rows = rooted(signed.select("doc_id", "sig", "bands"), roots)
    cells = rows.select("doc_id", "root", F.posexplode("bands").alias("band", "key"))
    mixed = cells.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    mixed = written(mixed.select("band", "key"), "near-mixed")
    cells = rows.select("doc_id", "root", "sig", F.posexplode("bands").alias("band", "key"))
    cells = in_bitmap(cells, bitmap_of(mixed, ["band", "key"]), ["band", "key"], "near_mixed").where("near_mixed")
    at = F.pmod((F.col("band") + 1 + 2 * turn) * BAND_ROWS, F.lit(BANDS * BAND_ROWS)) + 1
    order = F.substring(F.concat("sig", "sig"), at, F.lit(2 * BAND_ROWS))
    keys = ["band", "key", "order", "doc_id"]
    cells = cells.select("band", "key", order.alias("order"), "doc_id", "root", "sig")
    cells = cells.repartitionByRange(partitions(signed.sparkSession), *keys).sortWithinPartitions(*keys)
    pairs = cells.select("band", "key", "doc_id", "root", "sig").mapInArrow(alike_neighbours, "rep long, member long")
    return pairs.distinct().join(tested, ["rep", "member"], "left_anti")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits each of some bitmaps differs from each of others."""
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)


def alike_sets(
    left: np.ndarray, right: np.ndarray, root: np.ndarray, sizes: np.ndarray, bits: np.ndarray, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Places of each pair of ``left`` and ``right`` with different roots that
    may be so similar: sets of n members in all then differ in
    n * (1 - similarity) / (1 + similarity) at most. ``bits`` as ``parity``
    gives them; the wider of two bitmaps is folded to the narrower."""
    widths = np.array([len(x) for x in bits])
    share, found = (1 - similarity) / (1 + similarity), []

    def maps(at: np.ndarray, width: int) -> np.ndarray:
        whole = np.frombuffer(b"".join(bits[at]), np.uint64).reshape(len(at), -1, width // 8)
        return np.bitwise_xor.reduce(whole, axis=1)

    for a_width in np.unique(widths[left]):
        for b_width in np.unique(widths[right]):
            width = int(min(a_width, b_width))
            a, b = left[widths[left] == a_width], right[widths[right] == b_width]
            b_maps, step = maps(b, width), max((1 << 17) // (len(b) * width // 8), 1)
            for at in range(0, len(a), step):
                some = a[at : at + step]
                most = (sizes[some][:, None] + sizes[b][None, :]) * share + 1e-6
                ok = (root[some][:, None] != root[b][None, :]) & (abs(sizes[some][:, None] - sizes[b][None, :]) <= most)
                if ok.any():
                    x, y = np.nonzero(ok & (differing(maps(some, width), b_maps) <= most))
                    found.append((some[x], b[y]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)])


def remaining_candidates(signed: DataFrame, roots: DataFrame, tested: DataFrame, similarity: float) -> DataFrame:
    """rep, member: all pairs of a bucket, not connected nor tested, that may
    be similar.

    Buckets that are not connected are cut into blocks of bounded size; a task
    compares the bitmaps of two blocks at a time. The band is part of its key.
    """
    rows = rooted(signed.select("doc_id", "n", "bands", "bits"), roots)
    cells = rows.select("root", F.explode("bands").alias("key"))
    mixed = cells.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows"))
    mixed = mixed.where("low < high").select(F.col("key").alias("mixed_key"), "rows", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    mixed = written(mixed, "near-mixed")
    cells = rows.select("doc_id", "root", "n", "bits", F.explode("bands").alias("key"))
    cells = in_bitmap(cells, bitmap_of(mixed.withColumnRenamed("mixed_key", "key"), ["key"]), ["key"], "near_mixed")
    cells = join_groups(cells.where("near_mixed").drop("near_mixed"), "key", mixed, "mixed_key", "rows").where("mixed_key IS NOT NULL")
    own = F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    cells = cells.select("key", low, high, "own", "doc_id", "root", "n", "bits")
    cells = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    names = ("key", "low", "high", "own", "doc_id", "root", "n")

    def pairs_of(rows: dict[str, np.ndarray], at: int, end: int) -> np.ndarray:
        own, doc = rows["own"][at:end], rows["doc_id"][at:end]
        low, high = rows["low"][at], rows["high"][at]
        left, right = (np.arange(end - at),) * 2 if low == high else (np.flatnonzero(own == low), np.flatnonzero(own == high))
        a, b = alike_sets(left, right, rows["root"][at:end], rows["n"][at:end], rows["bits"][at:end], similarity)
        return np.stack([np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in chain(batches, [None]):  # None: the last key ends
            if batch is not None:
                new = {n: batch.column(n).to_numpy() for n in names}
                new["bits"] = np.array([*batch.column("bits").to_pylist(), None], object)[:-1]
                held = {n: np.concatenate([held[n], x]) if held else x for n, x in new.items()}
            if not held or not len(held["key"]):
                continue
            ends = np.flatnonzero(np.any([held[n][1:] != held[n][:-1] for n in names[:3]], axis=0)) + 1
            starts, ends = np.concatenate([[0], ends]), np.concatenate([ends, [len(held["key"])]])
            mixed = np.minimum.reduceat(held["root"], starts) < np.maximum.reduceat(held["root"], starts)
            whole = slice(None, -1 if batch is not None else None)
            found = [pairs_of(held, at, end) for at, end in zip(starts[whole][mixed[whole]], ends[whole][mixed[whole]])]
            held = {n: x[starts[-1] :] for n, x in held.items()}
            if found:
                pairs = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["rep", "member"])

    pairs = cells.mapInArrow(run, "rep long, member long")
    return pairs.distinct().join(tested, ["rep", "member"], "left_anti")


def verified(docs: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """src, dst: the pairs whose shingle sets are similar enough.

    Members come to their representative, in groups of bounded size, each
    with its own copy of the representative's text; a task holds the shingles
    of one representative and one member at a time.
    """
    groups = pairs.groupBy("rep").agg(F.count("*").alias("rows"))
    groups = written(groups.select(F.col("rep").alias("group_rep"), "rows", F.ceil(F.col("rows") / GROUP_SIZE).cast("int").alias("groups")), "near-reps")
    members = join_groups(pairs.withColumnRenamed("member", "doc_id"), "rep", groups, "group_rep", "rows").select(
        "rep", F.pmod(F.xxhash64("doc_id"), "groups").cast("int").alias("part"), F.col("doc_id").alias("doc")
    )
    rep = F.col("group_rep")
    reps = groups.select(rep.alias("rep"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), rep.alias("doc"))
    wanted = written(members.unionByName(reps), "near-wanted")
    involved = wanted.select(F.col("doc").alias("doc_id")).distinct()
    texts = in_bitmap(docs.select("doc_id", "text"), bitmap_of(involved, ["doc_id"]), ["doc_id"], "near_involved")
    texts = texts.where("near_involved").select(F.col("doc_id").alias("doc"), "text")
    rows = wanted.join(texts, "doc").select("rep", "part", (F.col("doc") != F.col("rep")).alias("second"), "doc", "text")
    rows = rows.repartition("rep", "part").sortWithinPartitions("rep", "part", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for rep, part, second, doc, text in zip(
                *(batch.column(c).to_pylist() for c in ("rep", "part", "second", "doc", "text"))
            ):
                hashes = shingles(words_of(text), size)
                if not second:
                    at, own = (rep, part), hashes
                elif at == (rep, part) and jaccard(own, hashes) >= similarity:
                    found.append((rep, doc))
            src, dst = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def near_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """node, root for every doc_id with a near copy; root is the least of its group."""
    signed = written(signatures(docs, size), "near-signatures")
    pairs = tested = written(candidates(signed, radius), "near-pairs")
    found = written(verified(docs, pairs, size, similarity), "near-links")
    turn = 0
    while True:
        roots = written(components(found), "near-roots")
        pairs = written(further_candidates(signed, roots, tested, turn), "near-pairs")
        if pairs.isEmpty():
            break
        more = written(verified(docs, pairs, size, similarity), "near-links")
        tested, turn = tested.unionByName(pairs), turn + 1
        if more.isEmpty():
            break
        found = found.unionByName(more)
    pairs = written(remaining_candidates(signed, roots, tested, similarity), "near-pairs")
    if pairs.isEmpty():
        return roots
    more = written(verified(docs, pairs, size, similarity), "near-links")
    return roots if more.isEmpty() else written(components(found.unionByName(more)), "near-roots")


def drop_near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """``docs`` with one document of each group of near copies.

    Null and empty texts are copies of each other. Rows that repeat a doc_id
    stay or go together; a null doc_id stays. An empty table stays empty.
    """
    gone = near_groups(docs, size, similarity, radius).where("node != root").select(F.col("node").alias("near_gone"))
    bitmap = bitmap_of(gone.select(F.col("near_gone").alias("doc_id")), ["doc_id"])
    marked = in_bitmap(docs, bitmap, ["doc_id"], "near_maybe")
    clear = marked.where(~F.col("near_maybe")).select(*docs.columns)
    rest = marked.where("near_maybe").join(gone, F.col("doc_id") == F.col("near_gone"), "left_anti")
    return clear.unionByName(rest.select(*docs.columns))
