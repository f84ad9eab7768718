"""Personal data and the terms that give it away, with DataFrame functions only.

Base spans are matches of fixed patterns (e-mail, IP, card and phone numbers), leftmost and
without overlap; a match that fails its test is dropped. Positions come from the pieces of
the text between matches.

The method adds terms: runs of letters, lower-cased, outside of base spans. Every base span
names a protected entity (its kind and value). Counts of documents over the whole corpus and
whole texts, n(e) with the entity, n(t) with the term, n(e,t) with both, N of all, give

    P(e|t) = n(e,t) / (n(t) + 1)            smoothed by one unseen document with the term
    PMI(e,t) = log2(P(e|t) * N / n(e))      IC(e) = log2(N / n(e))

and IC - PMI is what the term leaves open of the entity. A pair discloses if it leaves open at
most ``OPEN_BITS`` (1) bit and at most half of the entity's information; the comparisons are made in
whole numbers, 2 n(e,t) >= n(t) + 1 and n(e,t)^2 N >= n(e) (n(t) + 1)^2. There is no window, and no smallest
count: a term that stands in one document only discloses that document's entities. Every
occurrence of a disclosing term, in every document, becomes a span of kind ``term``.
``sanitise`` replaces base spans by their kind, disclosing terms that also stand in documents
without the entity by ``[TERM]`` (generalised), and others by nothing (removed).

Pairs are not listed where they cannot matter. A term of one document needs no partner: any
entity of that document will do. Other terms need an entity of two documents or more, and
entities that stand in the same documents count as one class. Documents are searched for
disclosing terms of several documents behind a filter of 2^``SLOT_BITS`` bits; when it fills up
it costs time, not spans.

Whole texts are read. A null text is empty. Rows count as documents, copies and repeated rows
too, and rows with the same text get the same spans. A null doc_id is an id. Other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martweave.functions.scale import stage

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. Runs cannot be left early, so possessive
# quantifiers find the same matches without trying shorter ones, and a match can only begin
# where a run of its first class begins or where the match before has ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OPEN_BITS = 1  # what a disclosing term may leave open; the whole-number comparisons are written for one bit
SLOT_BITS = 24  # of the filters for terms and texts: 2^24 bits, at most 2^18 rows to broadcast
LETTERS = r"[\p{L}\p{M}]+"
OTHERS = r"[^\p{L}\p{M}]+"
RUN = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where lambdas in ``use`` refer to it again and again."""
    return F.transform(F.array(value), use)[0]


def running(values: Column) -> Column:
    """Sums of the elements before each element of a long array; blocks keep long arrays cheap."""
    return let(values, _running)


def _running(values: Column) -> Column:
    zero = F.lit(0).cast("long")
    add = lambda a, x: a + x
    run = F.least(F.lit(RUN), F.greatest(F.lit(8), F.sqrt(F.size(values)).cast("int")))
    block = lambda b: F.slice(values, (b * run + 1).cast("int"), run)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / run)), block)
    inside = lambda b, start: F.transform(b, lambda _, j: start + F.aggregate(F.slice(b, F.lit(1), j), zero, add))
    sums = let(blocks, lambda bs: let(F.transform(bs, lambda b: F.aggregate(b, zero, add)), lambda totals: F.flatten(
        F.transform(bs, lambda b, i: let(F.aggregate(F.slice(totals, F.lit(1), i), zero, add), lambda start: inside(b, start))))))
    return F.when(F.size(values) > 0, sums).otherwise(F.array().cast("array<bigint>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    marks = F.reverse(F.split(digits, ""))
    total = F.aggregate(
        F.transform(marks, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int"))),
        F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    size = F.length(_digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when((size >= 13) & (size <= 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return (size >= 9) & (size <= 15)
    return F.lit(True)


SPAN = "array<struct<start:bigint,end:bigint,match:string>>"
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def spans(kind: str, text: Column) -> Column:
    """Valid matches of one kind: start and end in code points, and the match."""
    pattern = F.lit(PATTERNS[kind])
    length = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("long")
    cut = F.struct(F.split(text, PATTERNS[kind], -1).alias("pieces"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"))
    steps = lambda c: F.zip_with(c["pieces"], c["matches"], lambda p, m: length(p) + length(m))

    def row(c: Column, before: Column, m: Column, i: Column) -> Column:
        start = before[i] + length(c["pieces"][i])
        return F.struct(start.alias("start"), (start + length(m)).alias("end"), m.alias("match"))

    found = let(cut, lambda c: let(running(steps(c)), lambda before: F.filter(
        F.transform(c["matches"], lambda m, i: row(c, before, m, i)), lambda r: valid(kind, r["match"]))))
    likely = F.regexp_like(text, pattern)
    if HINTS[kind]:
        likely = F.contains(text, F.lit(HINTS[kind])) & likely
    return F.when(likely, found).otherwise(F.array().cast(SPAN))


def masked(text: Column) -> Column:
    """The text with blanks in place of all matches, places kept."""
    def blanked(kind: str) -> Callable[[Column], Column]:
        return lambda t: step(kind, t)

    def step(kind: str, t: Column) -> Column:
        cut = F.struct(F.split(t, PATTERNS[kind], -1).alias("pieces"), F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0)).alias("matches"))
        blanks = lambda p, m: F.concat(p, F.repeat(F.lit(" "), F.coalesce(F.length(m), F.lit(0))))
        return let(cut, lambda c: F.array_join(F.zip_with(c["pieces"], c["matches"], blanks), ""))

    # Every step reads the text twice, so it is bound: unbound, the last step would make it sixteen times.
    for kind in KINDS:
        text = let(text, blanked(kind))
    return text


def places(text: Column) -> Column:
    """(term, start, end) for every term of the text; ends are exclusive."""
    length = lambda c: F.length(c).cast("long")

    def row(c: Column, before: Column, w: Column, i: Column) -> Column:
        start = before[i] + length(c["gaps"][i])
        return F.struct(F.lower(w).alias("term"), start.alias("start"), (start + length(w)).alias("end"))

    steps = lambda c: F.transform(c["words"], lambda w, i: length(c["gaps"][i]) + length(w))
    found = lambda c: let(running(steps(c)), lambda before: F.transform(c["words"], lambda w, i: row(c, before, w, i)))
    return let(text, lambda t: let(F.struct(F.regexp_extract_all(t, F.lit(LETTERS), F.lit(0)).alias("words"), F.split(t, LETTERS, -1).alias("gaps")), found))


def terms_of(text: Column) -> Column:
    """Distinct terms of a text, and an empty one where it begins or ends with something else."""
    return F.array_distinct(F.split(F.lower(text), OTHERS))


def find(docs: DataFrame) -> DataFrame:
    """row, doc_id, tag, one array of spans per kind, and the text of documents that have a span."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("_text"), F.xxhash64(text).alias("tag"), *[spans(k, text).alias(k) for k in KINDS])
    some = reduce(or_, [F.size(k) > 0 for k in KINDS])
    return base.select("row", "doc_id", "tag", *KINDS, F.when(some, F.col("_text")).alias("_text"))


def words_of(found: DataFrame) -> DataFrame:
    """row, tag and ``words``, the terms outside of base spans, of documents that have a span."""
    # From the written table: in one plan with the patterns above, parts in common would be worked out for every document.
    return found.filter("_text IS NOT NULL").select("row", "tag", places(masked(F.col("_text"))).alias("words"))


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n_term): number of documents with the term."""
    return docs.select(F.explode(terms_of(F.col("text"))).alias("term")).filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def entity_classes(found: DataFrame) -> DataFrame:
    """(row, n_entity, a, b): the classes of entities of every document; a class stands in the same n_entity documents."""
    every = F.array_distinct(F.concat(*[F.transform(k, lambda s: F.struct(
        F.lit(k).alias("kind"), F.lower(_digits(s["match"]) if k in ("card", "phone") else s["match"]).alias("value"))) for k in KINDS]))
    there = stage(found.filter("_text IS NOT NULL").select("row", F.explode(every).alias("e")).select("row", "e.*"), "privacy-entities")
    digest = lambda salt: F.sum(F.xxhash64("row", F.lit(salt)).cast("decimal(38,0)"))
    held = there.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_entity"), digest(1).alias("a"), digest(2).alias("b"))
    return there.join(held, ["kind", "value"]).select("row", "n_entity", "a", "b").distinct()


def disclosing(docs: DataFrame, found: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Disclosing terms: (row, term) of those in one document only, and (term, generalise) of the others."""
    total = docs.agg(F.count(F.lit(1))).first()[0]
    classes = stage(entity_classes(found), "privacy-classes")
    span = classes.groupBy("row").agg(F.max("n_entity").alias("most"), F.min("n_entity").alias("least"))
    own = words.select("row", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term"))
    # A term of n documents needs an entity of more than n / 2.
    likely = stage(own.join(span, "row").join(term_counts(docs), "term").filter("n_term + 1 <= 2 * most"), "privacy-likely")
    single = likely.filter((F.col("n_term") == 1) & (F.col("least") * 4 <= total)).select("row", "term")
    met = likely.filter("n_term > 1").select("row", "term", "n_term").join(classes.filter("n_entity > 1"), "row").filter("n_term + 1 <= 2 * n_entity")
    pairs = met.groupBy("n_entity", "a", "b", "term", "n_term").agg(F.count(F.lit(1)).alias("both"))
    d = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c.cast("decimal(38,0)")
    rule = (2 * F.col("both") >= F.col("n_term") + 1) & (
        d("both") * F.col("both") * F.lit(total) >= d("n_entity") * (F.col("n_term") + 1) * (F.col("n_term") + 1))
    several = pairs.filter(rule).groupBy("term").agg(F.max((F.col("n_term") > F.col("both")).cast("int")).alias("generalise"))
    return single, several


def filter_table(hashes: DataFrame) -> DataFrame:
    """(at, bits): a hash filter as at most 2^``SLOT_BITS`` / 64 rows, whatever the number of hashes in column ``h``."""
    slot = F.col("h").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return hashes.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(one).alias("bits"))


def pass_filter(rows: DataFrame, hashed: Column, table: DataFrame) -> DataFrame:
    """Rows whose hash may be among those of the table; the table has a fixed size and is broadcast."""
    slot = hashed.bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    placed = rows.withColumns({"at": F.shiftright(slot, 6), "_bit": slot.bitwiseAND(F.lit(63)).cast("int")})
    held = F.call_function("shiftrightunsigned", F.col("bits"), F.col("_bit")).bitwiseAND(F.lit(1)) == 1
    return placed.join(F.broadcast(table), "at").filter(held).drop("at", "bits", "_bit")


def marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(tag, start, end, generalise): all places of disclosing terms, once per text."""
    words = stage(words_of(found), "privacy-words")
    single, several = disclosing(docs, found, words)
    own = words.select("row", "tag", F.explode("words").alias("w")).select("row", "tag", "w.*")
    alone = own.join(single, ["row", "term"]).select("tag", "start", "end", F.lit(0).alias("generalise"))
    several = stage(several, "privacy-several")
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("tag"), text.alias("_text"))
    terms = filter_table(several.select(F.xxhash64("term").alias("h")))
    likely = pass_filter(texts.select("tag", F.explode(terms_of(F.col("_text"))).alias("term")), F.xxhash64("term"), terms)
    hits = stage(likely.distinct().join(several, "term"), "privacy-hits")
    # Only texts with a hit are moved, each once, to find the places in them.
    held = pass_filter(texts, F.col("tag"), filter_table(hits.select(F.col("tag").alias("h"))))
    every = held.groupBy("tag").agg(F.first("_text").alias("_text")).select("tag", F.explode(places(F.col("_text"))).alias("w")).select("tag", "w.*")
    every = pass_filter(every, F.xxhash64("term"), terms)
    return alone.unionByName(every.join(hits, ["tag", "term"]).select("tag", "start", "end", "generalise"))


def protect(docs: DataFrame) -> DataFrame:
    """doc_id, tag, one array of spans per kind, and ``terms``: (start, end, generalise) of disclosing terms."""
    found = stage(find(docs), "privacy-found")
    own = F.array_sort(F.collect_list(F.struct("start", "end", "generalise"))).alias("terms")
    terms = stage(marks(docs, found).groupBy("tag", "start", "end").agg(F.max("generalise").alias("generalise")).groupBy(F.col("tag").alias("_tag")).agg(own), "privacy-terms")
    joined = found.drop("row", "_text").join(terms, F.col("tag") == F.col("_tag"), "left").drop("_tag")
    return joined.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,generalise:int>>")))


def listed(kind: str, column: str) -> Column:
    return F.transform(column, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def report(protected: DataFrame) -> DataFrame:
    """doc_id, the number of spans per kind, the digest of base spans, and all spans."""
    base = F.concat(*[listed(k, k) for k in KINDS])
    return protected.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed("term", "terms")), ",").alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and the text with base spans and disclosing terms replaced; of overlapping spans the first, longest one counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_tag"), text.alias("text"))
    marks = F.concat(
        *[F.transform(k, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(f"[{k.upper()}]").alias("by"))) for k in KINDS],
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.when(s["generalise"] > 0, "[TERM]").otherwise("").alias("by"))))
    plan = protect(docs).select("doc_id", "tag", F.array_sort(F.array_distinct(marks)).alias("marks")).distinct()
    joined = own.join(plan, own["_id"].eqNullSafe(F.col("doc_id")) & (own["_tag"] == F.col("tag")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate("marks", start, lambda a, m: F.when(m["start"] >= a["at"], F.struct(
        (-m["back"]).alias("at"),
        F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (m["start"] - a["at"]).cast("int")), m["by"]).alias("out"))).otherwise(a))
    return joined.withColumn("_d", done).select("doc_id", F.concat("_d.out", F.substring(F.col("text"), (F.col("_d.at") + 1).cast("int"), F.length("text"))).alias("text"))
