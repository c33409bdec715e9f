"""I-Match fingerprints: digests of the distinct mid-frequency terms of a text, under several randomised lexicons.

Terms are runs of letters and digits of the lower-cased text. The lexicon keeps the terms whose inverse document frequency
lies in a band, ln(1 / MOST) to ln(1 / LEAST): in at least LEAST and at most MOST of all documents. It has at most
(distinct terms of a document on average) / LEAST entries, however many documents there are, so its hashes fit a bounded
table that goes into every task as a constant of the plan. A fingerprint has a 32-bit digest of the sorted distinct lexicon
terms for the full lexicon and for random parts of it: SUBSETS for each of WIDTHS, which keep one in 2^width terms, so
that texts of any length have parts that survive an edit. A text without any lexicon term is digested by all its terms.

likeness() is the share of equal digests among the lexicon parts in which either text has a term.

Edited texts need the next document in descending doc_id order. Only ids are put in order, in partitions by range; the
neighbour of the last id of each partition comes from a table with a row per partition. Of the next text only the part
that is needed goes to the document that needs it.

Defined results: null and empty texts are empty and their fingerprint is all zeros, as is that of a text without letters and
digits; two fingerprints of zeros are alike (1.0). A null doc_id sorts after all others. Rows that repeat a doc_id each
have a row and share their next document, which is that of the next lower id; where several rows have that id, it is the
one with the least digest. After the lowest id comes the highest, also for a single document. An empty table gives an
empty table. Columns other than doc_id and text are not looked at; n_chars is counted anew.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelode.llm.common import settled, whole_text

MOST, LEAST = 0.5, 0.002
SUBSETS, WIDTHS = 6, (2, 3, 4, 6, 8, 10)
SLOTS = 1 << 14
NO_ID = -(1 << 63)


def terms_of(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, most: float = MOST, least: float = LEAST) -> DataFrame:
    """(term) hashes of the terms in the band, from the whole texts of all documents."""
    counted = docs.select(F.explode(terms_of(whole_text())).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("total")).scalar()
    return counted.where((F.col("n") >= total * least) & (F.col("n") <= total * most)).select("term")


def slot_of(term: Column) -> Column:
    return F.pmod(term, F.lit(SLOTS)).cast("int")


def lexicon_table(terms: DataFrame) -> Column:
    """A constant of SLOTS arrays of term hashes, each term in the array of its slot. Runs a job; the result is bounded."""
    filled = terms.groupBy(slot_of(F.col("term")).alias("slot")).agg(F.collect_list("term").alias("terms"))
    slots: list[list[int]] = [[] for _ in range(SLOTS)]
    for row in filled.toLocalIterator():
        slots[row.slot] = row.terms
    return F.from_json(F.lit(json.dumps(slots)), "array<array<bigint>>")


def subset_masks(subsets: int = SUBSETS) -> list[int]:
    """Bits of a term's hash that are all zero in the terms of each lexicon part; 0 keeps the full lexicon."""
    masks = [0]
    for width in WIDTHS:
        masks += [((1 << width) - 1) << (start * (64 - max(WIDTHS)) // subsets + width % 3) for start in range(subsets)]
    return masks


def digests_of(text: Column, slots: Column) -> Column:
    """A digest for each lexicon part, 0 where the text has no term of it."""
    terms = terms_of(text)
    known = F.filter(terms, lambda t: F.array_contains(F.get(slots, slot_of(t)), t))
    masks = F.array(*[F.lit(mask).cast("bigint") for mask in subset_masks()])
    # A second transform over a one-element array names a value, so that it is computed once.
    both = F.transform(F.array(F.struct(terms.alias("all"), known.alias("known"))),
                       lambda b: F.sort_array(F.when(F.size(b["known"]) > 0, b["known"]).otherwise(b["all"])))

    def digest(kept: Column) -> Column:
        return F.when(F.size(kept) == 0, F.lit(0)).otherwise(F.hash(kept))

    per_text = F.transform(both, lambda sorted_terms: F.transform(
        masks, lambda mask: digest(F.filter(sorted_terms, lambda t: t.bitwiseAND(mask) == 0))))
    return per_text[0]


def as_text(digests: Column) -> Column:
    return F.array_join(F.transform(digests, lambda d: F.lpad(F.lower(F.right(F.hex(d), F.lit(8))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), None).otherwise(F.when(x == y, 1.0).otherwise(0.0)))
    total = F.aggregate(pairs, F.struct(F.lit(0.0).alias("same"), F.lit(0).alias("n")), lambda held, x: F.struct(
        (held["same"] + F.coalesce(x, F.lit(0.0))).alias("same"), (held["n"] + F.when(x.isNull(), 0).otherwise(1)).alias("n")))
    return F.transform(F.array(total), lambda t: F.when(t["n"] == 0, 1.0).otherwise(t["same"] / t["n"]))[0]


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id) of distinct ids: the next lower one, and the highest for the lowest."""
    shift = 33  # monotonically_increasing_id: the partition above, the row within it below
    placed = settled(ids.orderBy(F.desc("id")).select("id", F.monotonically_increasing_id().alias("m")))
    placed = placed.select("id", "m", F.shiftright("m", shift).alias("part"))
    ends = placed.groupBy("part").agg(F.max("id").alias("top"))  # a row per partition
    after = ends.select("part", F.coalesce(F.lead("top").over(Window.orderBy("part")), F.max("top").over(Window.partitionBy())).alias("follow"))
    inside = placed.withColumn("below", F.lead("id").over(Window.partitionBy("part").orderBy("m")))
    return inside.join(after, "part").select("id", F.coalesce("below", "follow").alias("next_id"))


def edited_fingerprints(docs: DataFrame, most: float = MOST, least: float = LEAST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has the last third of the text's code points replaced by as many first ones of the next document.
    """
    slots = lexicon_table(lexicon(docs, most, least))
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), whole_text().alias("text"))
    facts = rows.select("id", F.xxhash64("text").alias("digest"), F.floor(F.length("text") / 3).cast("int").alias("third"))
    facts = facts.groupBy("id").agg(F.min("digest").alias("digest"), F.max("third").alias("third"))
    order = settled(next_ids(facts.select("id")).join(facts, "id"))
    wanted = order.select(F.col("next_id").alias("id"), F.col("id").alias("for_id"), "third")
    wanted = wanted.join(order.select("id", "digest"), "id")
    # Both joins below read the same columns by the same key, so the texts are shuffled once.
    rows = rows.select("id", "text", digests_of(F.col("text"), slots).alias("print"))
    heads = rows.join(wanted, "id").select(F.col("for_id").alias("id"), F.when(
        F.xxhash64("text") == F.col("digest"),
        F.struct(F.substring("text", F.lit(1), F.col("third")).alias("head"), F.col("print").alias("next_print"))).alias("next"))
    heads = heads.groupBy("id").agg(F.first("next", ignorenulls=True).alias("next"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next.head", F.lit(1), third))
    joined = rows.join(heads, "id").select(
        F.when(F.col("id") != NO_ID, F.col("id")).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "print", "next.next_print",
        F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"))
    printed = joined.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "print", "next_print",
                            digests_of(F.col("edited"), slots).alias("edited_print"))
    return printed.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))
