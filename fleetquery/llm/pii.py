"""Information-theoretic sanitisation of personal data (operator 2, native).

Patterns find what is protected: addresses, cards and phone numbers. The
corpus then says which other terms, words and numbers, give them away. Of an
entity c and a term t, N different texts tell p(c) and p(c | t); t reveals
log2(p(c | t) / p(c)) of the log2(1 / p(c)) bits that c holds. Counts are of
different texts, since copies say nothing new, and p(c | t) is estimated with
absolute discounting: a part of each pair's meetings is put down to chance, so
that pairs which met once are judged by the same measure.

A term that reveals more than a share of the bits of any entity goes wherever
it stands in a text with personal data. In other texts it goes if, by the same
estimate, a text with the term holds the entity more likely than not; a rare
word that one text with and one without personal data share stays in the
latter. A term with digits is generalised to its shape ("A-4711": "A-####"
per word), if the shape itself does not disclose; all others are removed.
All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetquery.llm.common import below, bitmap_of, bits_for, in_bitmap, join_groups, let, scan, table, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Share of an entity's information from which a term discloses it.
DISCLOSURE = 0.8
#: p(c | t) from which a term goes in texts without personal data too.
LIKELY = 0.5
#: Meetings of each entity and term that are put down to chance (the usual
#: discount of Kneser and Ney).
DISCOUNT = 0.75

# Each matches what the plain pattern of its kind does, with possessive
# repeats and a fixed place to begin, so that long runs take linear time.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"[\p{L}\p{N}]{3,}"
_BETWEEN = r"[^\p{L}\p{N}]+"
_SPAN = "struct<start:int,end:int,match:string>"


def placed(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Matches in ``text``: start and end in code points, and the match; those
    that ``wanted`` holds for.

    The gaps between matches, from ``split``, and the matches themselves
    alternate; their lengths add up to the places.
    """

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))
        return end, span if wanted is None else F.when(wanted(x["match"]), span)

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return scan(pairs, F.lit(0), _SPAN, step)["out"]

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _of(kind: str, f: Callable[[str, Column], Column]) -> Callable[[Column], Column]:
    return lambda x: f(kind, x)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), value)
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


#: A text that lacks this cannot hold the kind.
_NEEDS = {"email": lambda t: t.contains("@"), "phone": lambda t: t.contains("+"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]")}


def _entity(kind: str, match: Column) -> Column:
    """A hash of what a base span names."""
    return F.xxhash64(F.lit(kind), F.lower(match) if kind in ("email", "ip") else _digits(match))


def base_spans(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with fq_base, a struct of one array of start and end for each
    kind, and fq_entities, the different entities that they name."""
    empty = F.from_json(F.lit("[]"), f"array<{_SPAN}>")
    found = {}
    for kind in KINDS:
        spans = F.filter(placed(F.col(text), _PATTERNS[kind]), _of(kind, lambda k, x: _holds(k, x["match"])))
        found[f"fq_{kind}"] = F.when(_NEEDS[kind](F.col(text)), spans).otherwise(empty) if kind in _NEEDS else spans
    rows = rows.withColumns(found)
    bare = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    named = [F.transform(f"fq_{k}", _of(k, lambda k, x: _entity(k, x["match"]))) for k in KINDS]
    rows = rows.withColumns(
        {
            "fq_entities": F.array_distinct(F.concat(*named)),
            "fq_base": F.struct(*[F.transform(f"fq_{k}", bare).alias(k) for k in KINDS]),
        }
    )
    return rows.drop(*found)


def words(text: Column) -> Column:
    """The different words and numbers of a text in lower case, and the shapes
    of those with digits: each digit a #, which no word holds."""
    cut = F.array_distinct(F.transform(F.array_distinct(F.split(text, _BETWEEN)), F.lower))
    kept = F.filter(cut, lambda w: F.length(w) >= 3)
    shapes = lambda own: F.array_distinct(F.transform(F.filter(own, lambda w: w.rlike(r"\p{N}")), shape))
    return F.when(text.rlike(r"\p{N}"), let(kept, lambda own: F.concat(own, shapes(own)))).otherwise(kept)


def shape(word: Column) -> Column:
    return F.regexp_replace(word, r"\p{N}", "#")


def listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by kind, then start, with commas between."""
    parts = [F.transform(spans[k], _of(k, lambda k, x: F.concat_ws(":", F.lit(k), x["start"], x["end"]))) for k in kinds]
    return F.concat_ws(",", F.concat(*parts))


KEY = ["fq_id", "fq_hash"]


def _read(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("fq_text", text).withColumn("fq_id", F.col("doc_id")).withColumn("fq_hash", F.xxhash64(text))


def scanned(docs: DataFrame) -> DataFrame:
    """``KEY``, fq_base, entities and terms of each row (KEY, fq_text),
    written: texts are searched once, whatever comes after."""
    rows = base_spans(docs.select(*KEY, "fq_text"), "fq_text")
    rows = rows.select(*KEY, "fq_base", F.col("fq_entities").alias("entities"), words(F.col("fq_text")).alias("terms"))
    return written(rows, "pii-scanned")


def _different(rows: DataFrame) -> DataFrame:
    """One row of each text; only rows whose text may repeat are shuffled."""
    repeated = rows.groupBy("fq_hash").count().where("count > 1")
    marked = in_bitmap(rows, bitmap_of(repeated, ["fq_hash"]), ["fq_hash"], "fq_maybe")
    once = marked.where(~F.col("fq_maybe")).select(*rows.columns)
    return once.unionByName(marked.where("fq_maybe").select(*rows.columns).dropDuplicates(["fq_hash"]))


def _only(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with a column term, but for those surely not of ``terms``."""
    bits = bits_for(terms.count())
    marked = in_bitmap(rows, bitmap_of(terms.select("term"), ["term"], bits), ["term"], "fq_maybe", bits)
    return marked.where("fq_maybe").select(*rows.columns)


def disclosing_terms(rows: DataFrame) -> DataFrame:
    """term, anywhere: those at or above the disclosure threshold for any
    entity, and whether they go in texts without personal data too.

    ``rows``: as ``scanned``. Entities that stand in the same texts have the
    same pairs and are counted as one, so a text with many addresses gives its
    terms once. A pair that cannot reach the threshold, since even a meeting
    in each of the entity's texts is too little, is never made.
    """
    n = rows.select("fq_hash").distinct().count()
    held = rows.where(F.size("entities") > 0).dropDuplicates(["fq_hash"])
    held = written(held.select(F.col("fq_hash").alias("doc_id"), "entities", "terms"), "pii-holding")
    own = held.select("doc_id", F.explode("terms").alias("term"))
    every = _different(rows.select("fq_hash", "terms")).select(F.explode("terms").alias("term"))
    counts = _only(every, own.select("term").distinct()).withColumnRenamed("term", "group_term")
    counts = written(counts.groupBy("group_term").agg(F.count("*").alias("n_term")), "pii-counts")
    named = held.select("doc_id", F.explode("entities").alias("entity"))
    sets = named.groupBy(F.col("entity").alias("group_entity")).agg(
        F.count("*").alias("n_entity"),
        *[F.bit_xor(F.xxhash64(F.lit(i), "doc_id")).alias(f"set_{i}") for i in range(2)],
    )
    members = join_groups(named, "entity", written(sets, "pii-sets"), "group_entity", "n_entity")
    members = members.select("doc_id", "n_entity", "set_0", "set_1").where(F.col("n_entity") < n).distinct()
    own = join_groups(own, "term", counts, "group_term", "n_term").select("doc_id", "term", "n_term")
    least = F.pow(F.col("n_entity") / F.lit(float(n)), F.lit(1 - DISCLOSURE))
    able = F.col("n_entity") >= F.col("n_term") * least * (1 - 1e-9)
    pairs = own.join(members, "doc_id").where(able)
    pairs = pairs.groupBy("n_entity", "set_0", "set_1", "term", "n_term").agg(F.count("*").alias("n_both"))
    chance = F.col("n_entity") / F.lit(float(n))
    given = (F.col("n_both") - DISCOUNT + DISCOUNT * chance) / F.col("n_term")
    reveals = F.log2(given / chance) / F.log2(1 / chance)
    return pairs.where(reveals >= DISCLOSURE).groupBy("term").agg(F.max(given >= LIKELY).alias("anywhere"))


def told_terms(rows: DataFrame) -> DataFrame:
    """fq_id_of, fq_hash_of, fq_told (sorted hashes of terms) of the documents
    among ``rows`` (as ``scanned``) that hold terms which go there."""
    terms = written(disclosing_terms(rows), "pii-disclosing")
    holds = F.size("entities") > 0
    own = _only(rows.where(holds).select(*KEY, F.explode("terms").alias("term")), terms)
    others = _only(rows.where(~holds).select(*KEY, F.explode("terms").alias("term")), terms.where("anywhere"))
    all_words = own.withColumn("holds", F.lit(True)).unionByName(others.withColumn("holds", F.lit(False)))
    all_words = written(all_words, "pii-words")
    sizes = all_words.groupBy("term").agg(F.count("*").alias("rows")).join(terms, "term")
    sizes = sizes.select(F.col("term").alias("group_term"), "anywhere", "rows")
    found = join_groups(all_words.withColumn("doc_id", F.xxhash64(*KEY)), "term", sizes, "group_term", "rows")
    found = found.where(F.col("group_term").isNotNull() & (F.col("holds") | F.col("anywhere")))
    found = found.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.xxhash64("term"))).alias("fq_told"))
    return found.withColumnsRenamed({k: f"{k}_of" for k in KEY})


def _among(hashes: Column, word: Column) -> Column:
    """Whether the hash of ``word`` is one of the sorted ``hashes``."""
    return let(F.xxhash64(word), lambda h: F.coalesce(F.get(hashes, below(hashes, h) - 1) == h, F.lit(False)))


def _clear_of(base: Column, spans: Column) -> Column:
    """``spans`` that overlap none of ``base``: as many of those begin before
    the end as have ended by the start."""
    edges = [F.array_sort(F.transform(base, lambda x: x[edge])) for edge in ("start", "end")]

    def clear(edge: Column) -> Column:
        starts, ends = edge["starts"], edge["ends"]
        return F.filter(spans, lambda x: below(starts, x["end"] - 1) == below(ends, x["start"]))

    return let(F.struct(edges[0].alias("starts"), edges[1].alias("ends")), clear)


def with_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``scanned`` rows of ``docs`` with fq_terms: the spans of terms that go,
    with ``label``, what stands in their place; and the rows without any."""
    rows = scanned(docs)
    found = written(told_terms(rows), "pii-told")
    marked = in_bitmap(docs, bitmap_of(found.select(*[F.col(f"{k}_of").alias(k) for k in KEY]), KEY), KEY, "fq_maybe")
    texts = marked.where("fq_maybe").select(*KEY, "fq_text").dropDuplicates(KEY)
    same = texts["fq_id"].eqNullSafe(found["fq_id_of"]) & (texts["fq_hash"] == found["fq_hash_of"])
    texts = texts.join(found, same).select(*KEY, "fq_text", "fq_told")
    bases = in_bitmap(rows, bitmap_of(found.select(*[F.col(f"{k}_of").alias(k) for k in KEY]), KEY), KEY, "fq_maybe")
    bases = bases.where("fq_maybe").select(*[F.col(k).alias(f"{k}_of") for k in KEY], "fq_base").dropDuplicates(
        [f"{k}_of" for k in KEY]
    )
    same = texts["fq_id"].eqNullSafe(bases["fq_id_of"]) & (texts["fq_hash"] == bases["fq_hash_of"])
    texts = texts.join(bases, same).select(*KEY, "fq_text", "fq_told", "fq_base")
    goes = lambda w: _among(F.col("fq_told"), F.lower(w))
    base = F.concat(*[F.col(f"fq_base.{k}") for k in KINDS])
    spans = let(placed(F.col("fq_text"), _WORD, goes), lambda s: _clear_of(base, s))
    general = lambda w: w.rlike(r"\p{N}") & ~_among(F.col("fq_told"), shape(F.lower(w)))
    label = lambda w: F.when(general(w), shape(w)).otherwise(f"[{TERM.upper()}]")
    spans = F.transform(spans, lambda x: F.struct(x["start"], x["end"], label(x["match"]).alias("label")))
    terms = texts.select(*[F.col(k).alias(f"{k}_of") for k in KEY], spans.alias("fq_terms"))
    return rows, written(terms, "pii-places")


def _spanned(docs: DataFrame) -> DataFrame:
    """KEY, fq_base, fq_terms of each row of ``docs``."""
    rows, terms = with_spans(docs)
    same = rows["fq_id"].eqNullSafe(terms["fq_id_of"]) & (rows["fq_hash"] == terms["fq_hash_of"])
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,label:string>>")
    return rows.join(terms, same, "left").select(*KEY, "fq_base", F.coalesce("fq_terms", empty).alias("fq_terms"))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Null and empty texts have no spans. Rows that repeat a doc_id are told
    apart by their texts. An empty table gives no rows. Spans are by kind in
    the order of KINDS, then terms; places are code points, ends exclusive.
    """
    rows = _spanned(_read(docs.select("doc_id", "text")))
    terms = F.transform("fq_terms", lambda x: F.concat_ws(":", F.lit(TERM), x["start"], x["end"]))
    base = listed(F.col("fq_base"), KINDS)
    return rows.select(
        F.col("fq_id").alias("doc_id"),
        *[F.size(f"fq_base.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(F.concat_ws(",", terms), F.lit(""))).alias("spans"),
        F.size("fq_terms").cast("long").alias("n_term"),
    )


#: Pieces of a text that are cut out of one part of it.
_PIECES = 256


def _rewritten(text: Column, base: Column, terms: Column) -> Column:
    """``text`` with each span replaced by its label; spans that overlap fall
    into the first of them. A part of the text is cut out for every _PIECES
    pieces and those from it, so long texts take no quadratic time."""
    every = F.concat(
        *[F.transform(base[k], _of(k, lambda k, x: F.struct(x["start"], x["end"], F.lit(f"[{k.upper()}]").alias("label")))) for k in KINDS],
        F.transform(terms, lambda x: F.struct(x["start"], x["end"], x["label"])),
    ).cast("array<struct<start:int,end:int,label:string>>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        piece = F.array(F.struct(at.alias("start"), x["start"].alias("end"), x["label"].alias("label")))
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, piece)

    def put(done: Column) -> Column:
        last = F.array(F.struct(done["state"].alias("start"), F.length(text).alias("end"), F.lit("").alias("label")))
        return let(F.concat(done["out"], last), joined)

    def joined(pieces: Column) -> Column:
        def part(i: Column) -> Column:
            return let(F.slice(pieces, i * _PIECES + 1, _PIECES), cut)

        def cut(own: Column) -> Column:
            first, last = F.element_at(own, 1)["start"], F.element_at(own, -1)["end"]
            held = F.struct(first.alias("first"), F.substring(text, first + 1, last - first).alias("text"))
            inner = lambda h, p: F.substring(h["text"], p["start"] - h["first"] + 1, p["end"] - p["start"])
            return let(held, lambda h: F.array_join(F.transform(own, lambda p: F.concat(inner(h, p), p["label"])), ""))

        parts = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / _PIECES).cast("int"))
        return F.array_join(F.transform(parts, part), "")

    return let(scan(F.array_sort(every), F.lit(0), "struct<start:int,end:int,label:string>", step), put)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in ``text``.

    Rows without personal data and disclosing terms pass as they are and
    take no part in the join; all columns but text stay the same.
    """
    rows = _read(docs)
    spans = _spanned(rows)
    some = F.size("fq_terms") > 0
    for kind in KINDS:
        some = some | (F.size(f"fq_base.{kind}") > 0)
    spans = spans.where(some).withColumnsRenamed({k: f"{k}_of" for k in KEY}).dropDuplicates([f"{k}_of" for k in KEY])
    spans = written(spans, "pii-spans")
    marked = in_bitmap(rows, bitmap_of(spans.select(*[F.col(f"{k}_of").alias(k) for k in KEY]), KEY), KEY, "fq_maybe")
    clear = marked.where(~F.col("fq_maybe")).select(*docs.columns)
    rest = marked.where("fq_maybe").select(*rows.columns)
    same = rest["fq_id"].eqNullSafe(spans["fq_id_of"]) & (rest["fq_hash"] == spans["fq_hash_of"])
    rest = rest.join(spans, same, "left")
    new = F.when(F.col("fq_base").isNull(), F.col("text"))
    new = new.otherwise(_rewritten(F.col("fq_text"), F.col("fq_base"), F.col("fq_terms")))
    return clear.unionByName(rest.select(*[new.alias("text") if c == "text" else F.col(c) for c in docs.columns]))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents"))
