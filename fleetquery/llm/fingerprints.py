"""Document fingerprints as invertible Bloom lookup sketches (operator 10, native).

A paragraph's digest falls into one cell of each of three tables; a cell keeps
how many digests it took, their XOR, and the XOR of their checks. Two versions'
sketches are subtracted cell by cell, which cancels what they share. A cell
left with one digest that its check confirms is peeled: the digest is a
difference, and leaves its other cells too, which may free the next. Where
cells stay filled, the sketch was too small for the differences: both sides
are sketched again, larger, until peeling empties all cells.
At the largest size the three cells are the digest's own bits, so two digests
never share all three. All of it is columns and higher-order functions of one row.

A table's cell is the leading bits of the digest as the table turns it (by a
third of its bits a table). The turned digests are sorted once, so a cell is a
run of them and a sketch of any size takes a sort and a pass, not a filter a cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetquery.llm.common import below, let, partitions, table

#: Tables of a sketch; cells of a fingerprint's table, as a power of two.
TABLES = 3
CELL_BITS = 3
#: Each further retry has two more bits, four times the cells, up to a third of
#: a digest's bits, which the last of so many has reached.
RETRIES = 10
_DIGEST_BITS = 60  # a bit is left for the side
_TURN = _DIGEST_BITS // TABLES
_ROUNDS = 64
#: Bytes of text meant for one range of documents, and most ranges.
RANGE_BYTES, MOST_RANGES = 64 << 20, 20_000


def paragraph_digests(text: Column) -> Column:
    """The different digests (60 bits) of a text's paragraphs: its lines,
    cut after each sentence, whatever their length."""
    pieces = F.filter(F.split(text, "\n| (?<=[.!?] )"), lambda p: p != "")
    return F.array_distinct(F.transform(pieces, lambda p: F.shiftrightunsigned(F.xxhash64(p), 64 - _DIGEST_BITS)))


def _left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def _right(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def _turned(digest: Column, by: Column) -> Column:
    """The bits of ``digest`` turned left by ``by``."""
    high = _left(digest, by).bitwiseAND(F.lit((1 << _DIGEST_BITS) - 1))
    return high.bitwiseOR(_right(digest, F.lit(_DIGEST_BITS) - by))


def _turns() -> Column:
    return F.array(*[F.lit(t * _TURN) for t in range(TABLES)])


def turned(digests: Column) -> Column:
    """For each table the digests as it turns them, sorted."""
    return F.transform(_turns(), lambda by: F.sort_array(F.transform(digests, lambda d: _turned(d, by))))


def _starts(cells_of: Column, cells: Column) -> Column:
    """Where each cell's run starts, and the last one's ends, in the sorted
    ``cells_of`` digests: marks are sorted in between, without a search."""
    marks = F.transform(F.sequence(F.lit(0), cells), lambda c: c * 2)
    merged = F.sort_array(F.concat(F.transform(cells_of, lambda c: c * 2 + 1), marks))
    places = F.transform(merged, lambda z, i: F.when(z % 2 == 0, i - F.shiftright(z, 1)).otherwise(-1))
    return F.filter(places, lambda i: i >= 0)


def added(sketches: Column, tables: Column, bits: Column) -> Column:
    """``sketches`` of 2**bits cells a table with ``turned`` digests added: a
    cell's count goes up by one for each, its key and check by XOR."""
    return _merged(sketches, tables, bits, _DIGEST_BITS, lambda d: (F.lit(1), d))


def removed(sketches: Column, found: Column, bits: Column) -> Column:
    """``sketches`` without ``found``: digests doubled, plus one for those of
    the right side, whose cells count them as -1."""

    def signed(by: Column) -> Column:
        return F.sort_array(F.transform(found, lambda v: _turned(F.shiftright(v, 1), by) * 2 + v.bitwiseAND(F.lit(1))))

    take = lambda v: ((v.bitwiseAND(F.lit(1)) * 2 - 1).cast("int"), F.shiftright(v, 1))
    return _merged(sketches, F.transform(_turns(), signed), bits, _DIGEST_BITS + 1, take)


def _merged(sketches: Column, tables: Column, bits: Column, width: int, entry: Callable[[Column], tuple[Column, Column]]) -> Column:
    """Each table's sorted values of ``width`` bits put into its cells; ``entry``
    gives a value's step of the count and its digest."""

    def filled(cells: Column, values: Column) -> Column:
        def cell(c: Column, start: Column, n: Column) -> Column:
            def take(a: Column, i: Column) -> Column:
                by, d = entry(F.get(values, i))
                key, check = a["key"].bitwiseXOR(d), a["check"].bitwiseXOR(F.xxhash64(d))
                return F.struct((a["count"] + by).alias("count"), key.alias("key"), check.alias("check"))

            # places, not a slice: that would copy the whole array for each cell
            return F.when(n == 0, c).otherwise(F.aggregate(F.sequence(start, start + n - 1), c, take))

        own = F.transform(values, lambda v: _right(v, F.lit(width) - bits).cast("int"))
        places = _starts(own, F.size(cells))
        return let(places, lambda s: F.transform(cells, lambda c, i: cell(c, F.get(s, i), F.get(s, i + 1) - F.get(s, i))))

    return F.zip_with(sketches, tables, filled)


def sketch(tables: Column, bits: Column) -> Column:
    """For each table an array of 2**bits cells: count, key (XOR of turned
    digests), check (XOR of their checks), from ``turned`` digests."""
    zero = F.lit(0).cast("long")
    empty = F.struct(F.lit(0).alias("count"), zero.alias("key"), zero.alias("check"))
    cells = F.array_repeat(empty, _left(F.lit(1), bits))
    return added(F.transform(tables, lambda _: cells), tables, bits)


def subtract(left: Column, right: Column) -> Column:
    def cell(a: Column, b: Column) -> Column:
        count, key, check = a["count"] - b["count"], a["key"].bitwiseXOR(b["key"]), a["check"].bitwiseXOR(b["check"])
        return F.struct(count.alias("count"), key.alias("key"), check.alias("check"))

    return F.zip_with(left, right, lambda a, b: F.zip_with(a, b, cell))


def peel(tables: Column, bits: Column) -> Column:
    """left, right: the digests that only one side has; ok: whether nothing is
    left in the cells."""

    def pure(held: Column) -> Column:
        of = lambda c: (F.abs(c["count"]) == 1) & (c["check"] == F.xxhash64(c["key"]))

        # turned on by the rest of the digest, a key is the digest again
        def digests(cells: Column, t: Column) -> Column:
            back = F.lit(_DIGEST_BITS) - t * _TURN
            signed = lambda c: _turned(c["key"], back) * 2 + F.when(c["count"] < 0, 1).otherwise(0)
            return F.transform(F.filter(cells, of), signed)

        return F.array_distinct(F.flatten(F.transform(held, digests)))

    def state(cells: Column, found: Column, going: Column) -> Column:
        return F.struct(cells.alias("cells"), found.alias("found"), going.alias("going"))

    def step(held: Column, _: Column) -> Column:
        ended = state(held["cells"], held["found"], F.lit(False))
        more = lambda new: state(removed(held["cells"], new, bits), F.concat(held["found"], new), F.lit(True))
        peeled = let(pure(held["cells"]), lambda new: F.when(F.size(new) > 0, more(new)).otherwise(ended))
        return F.when(held["going"], peeled).otherwise(held)

    def end(held: Column) -> Column:
        clear = lambda c: (c["count"] == 0) & (c["key"] == 0) & (c["check"] == 0)
        ok = F.forall(held["cells"], lambda cells: F.forall(cells, clear))
        of = lambda side: F.transform(F.filter(held["found"], lambda v: v % 2 == side), lambda v: F.shiftright(v, 1))
        return F.struct(ok.alias("ok"), of(0).alias("left"), of(1).alias("right"))

    none = F.array().cast("array<bigint>")
    start = state(tables, none, F.lit(True))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, step, end)


def differences(left: Column, right: Column, left_sketch: Column, right_sketch: Column, alike: bool = False) -> Column:
    """left, right: the digests that only one of two sides holds, from their
    ``turned`` digests and fingerprints; tries: sketches that it took.

    First the two fingerprints are subtracted and peeled. If that fails, both
    sides are sketched in half as many cells a table as they have digests
    together, or in a quarter if they should be ``alike``, as half of a text and
    its edited one is; while that fails, in four times the cells. Equal sides take none.
    """
    digests = F.size(F.get(left, F.lit(0))) + F.size(F.get(right, F.lit(0)))
    fitting = F.ceil(F.log2(digests + F.lit(1.0))).cast("int") - (2 if alike else 1)
    none = F.array().cast("array<bigint>")

    def attempt(held: Column, n: Column) -> Column:
        grown = F.greatest(fitting, F.lit(CELL_BITS + 1)) + (n - 1) * 2
        bits = F.when(n == 0, CELL_BITS).otherwise(F.least(grown, F.lit(_TURN)))
        fingerprints = F.struct(left_sketch.alias("a"), right_sketch.alias("b"))
        larger = F.struct(sketch(left, bits).alias("a"), sketch(right, bits).alias("b"))
        pair = F.when(n == 0, fingerprints).otherwise(larger)
        tried = let(pair, lambda p: peel(subtract(p["a"], p["b"]), bits))
        out = lambda t: F.struct(t["ok"].alias("ok"), t["left"].alias("left"), t["right"].alias("right"), (n + 1).alias("tries"))
        return F.when(held["ok"], held).otherwise(let(tried, out))

    same = (F.get(left, F.lit(0)) == F.get(right, F.lit(0))).alias("ok")
    start = F.struct(same, none.alias("left"), none.alias("right"), F.lit(0).alias("tries"))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(RETRIES)), start, attempt)
    unsolved = F.raise_error(F.lit("a sketch of the largest size did not peel")).cast("struct<ok:boolean,left:array<bigint>,right:array<bigint>,tries:int>")
    return let(found, lambda f: F.when(f["ok"], f).otherwise(unsolved))


def likeness(left: Column, found: Column) -> Column:
    """Shared digests over all digests; 1 if neither side has any."""
    every = F.size(left) + F.size(found["right"])
    return F.when(every == 0, F.lit(1.0)).otherwise((F.size(left) - F.size(found["left"])) / every)


def shown(tables: Column) -> Column:
    """A sketch as text: each cell's count and key in hexadecimal."""
    return F.concat_ws(".", F.transform(F.flatten(tables), lambda c: F.concat_ws(":", F.hex(c["count"]), F.hex(c["key"]))))


def with_next(rows: DataFrame, carried: list[str], size: Column) -> DataFrame:
    """``rows`` with next_<c> for ``carried``: values of the next row in the
    order of doc_id and tie; after the last comes the first.

    Rows are dealt to ranges of doc_id with bounds from approximate
    quantiles, one for RANGE_BYTES of ``size`` but no fewer than four for each
    of the session's partitions, so that tasks even out; the first row of each range also goes to the range before
    it, and no other row is sent twice.
    """
    spark = rows.sparkSession
    volume = rows.agg(F.sum(size)).first()[0] or 0
    ranges = max(4 * partitions(spark), min(MOST_RANGES, volume // RANGE_BYTES))
    marks = [n / ranges for n in range(1, ranges)]
    bounds = rows.agg(F.percentile_approx("doc_id", marks, 10 * ranges)).first()[0] or []
    bounds = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))] or [F.lit(None).cast("long")])
    number = F.coalesce(below(bounds, F.col("doc_id")), F.lit(0))
    rows = rows.withColumn("range_no", number)
    firsts = rows.groupBy("range_no").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first_id")).collect()
    firsts = sorted((r["range_no"], r["first_id"]) for r in firsts)
    before = [(first_id, firsts[n - 1][0]) for n, (_, first_id) in enumerate(firsts)]
    before = spark.createDataFrame(before, "first_id long, before_no int")
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = rows.join(F.broadcast(before), key == F.col("first_id"), "left")
    own = F.struct(F.col("range_no").alias("at"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("before_no").alias("at"), F.lit(True).alias("ghost"))
    both = F.when(F.col("before_no").isNull(), F.array(own)).otherwise(F.array(own, ghost))
    rows = rows.withColumn("place", F.explode(both)).drop("range_no", "first_id", "before_no")
    rows = rows.select("*", "place.at", "place.ghost").drop("place").repartition(ranges, "at")
    order = Window.partitionBy("at").orderBy("ghost", "doc_id", "tie")
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return rows.where(~F.col("ghost")).drop("at", "ghost")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_removed and n_added paragraphs of each row, and
    tries: the sketches it took to tell them (0 where nothing differs).

    Null texts count as empty, whose fingerprint has empty cells only. Rows
    that share a doc_id go by a hash of their text; a lone row is its own
    next. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("body"), F.xxhash64(text).alias("tie"))
    rows = with_next(rows, ["body"], F.octet_length("body"))
    size = F.length("body")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), size - half), F.substring(F.col("next_body"), F.lit(1), half))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), "body", "next_body", edited.alias("edited"))
    sides = {"own": "body", "new": "edited", "next": "next_body"}
    rows = rows.select("doc_id", "n_chars", "edited", *[turned(paragraph_digests(F.col(c))).alias(n) for n, c in sides.items()])
    rows = rows.select("*", *[sketch(F.col(n), F.lit(CELL_BITS)).alias(f"{n}_cells") for n in sides])
    found = [differences(F.col("own"), F.col(n), F.col("own_cells"), F.col(f"{n}_cells"), n == "new").alias(f"{n}_found") for n in ("new", "next")]
    rows = rows.select("*", *found)
    own = F.get("own", F.lit(0))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("own_cells")).alias("fingerprint"),
        shown(F.col("new_cells")).alias("edited_fingerprint"),
        likeness(own, F.col("new_found")).alias("near_edited"),
        likeness(own, F.col("next_found")).alias("near_next"),
        F.size("new_found.left").cast("long").alias("n_removed"),
        F.size("new_found.right").cast("long").alias("n_added"),
        F.col("new_found.tries").cast("long").alias("tries"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
