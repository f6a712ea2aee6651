"""I-Match fingerprints with randomised lexicon subsets.

The lexicon keeps the terms whose document frequency lies in a band: a term in more than ``MOST`` of all texts
says little, one in fewer than ``LEAST`` of them may be a typing error. Terms are told apart by 64-bit hashes.
With D distinct terms in an average text the lexicon has at most D / LEAST entries, however many texts there
are, so it can travel with the plan, as a hash set that each term is looked up in.

A text's distinct lexicon terms are sorted and hashed once for each of ``SUBSETS`` random subsets of the
lexicon. Two densities are used: in the first half of the subsets each term belongs to one of SUBSETS / 2
subsets, in the other half to one of a space ``SPARSE`` times as large, so that long texts, too, have subsets
of a few terms that an edit can miss. Texts without lexicon terms use all of their terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.plans.lineage import durable

LEAST, MOST = 0.005, 0.1
SUBSETS = 32
SPARSE = 8
LEAST_USED = 4
_NONE = "0000"
#: Ids of one bucket lie within this distance, which bounds the texts that a task sorts at a time.
BUCKET_IDS = 1024
#: First rows of buckets, 24 bytes each, are broadcast up to this number and joined by a shuffle beyond.
MOST_BROADCAST = 500_000


def terms(text: F.Column) -> F.Column:
    """Distinct 64-bit hashes of a text's words in lower case, words being parted by ASCII blanks and punctuation."""
    words = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST, most: float = MOST) -> list[int]:
    """Sorted hashes of the terms whose share of all texts lies between ``least`` and ``most``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = docs.count()
    counts = docs.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    band = counts.where(F.col("n").between(max(2, least * n), max(2, most * n)))
    return sorted(r.term for r in band.select("term").collect())


def lexicon_terms(found: str, lexicon_hashes: list[int]) -> F.Column:
    """The lexicon's terms in the array column ``found``, sorted."""
    if not lexicon_hashes:
        return F.array().cast("array<bigint>")
    return F.expr(f"array_sort(filter(`{found}`, t -> t in ({', '.join(f'{h}L' for h in lexicon_hashes)})))")


def _printed(used: F.Column) -> F.Column:
    half = SUBSETS // 2

    def one(k: F.Column, space: int) -> F.Column:
        # A term's subset comes from bits of its hash, other bits for either density.
        mine = F.filter(used, lambda t: F.pmod(F.shiftrightunsigned(t, 7 if space == half else 29), F.lit(space)) == k)
        return F.when(F.size(mine) == 0, _NONE).otherwise(F.lpad(F.hex(F.pmod(F.xxhash64(mine), F.lit(0xFFFF)) + 1), 4, "0"))

    numbers = F.sequence(F.lit(0).cast("long"), F.lit(half - 1).cast("long"))
    prints = F.concat(F.transform(numbers, lambda k: one(k, half)), F.transform(numbers, lambda k: one(k, half * SPARSE)))
    return F.lower(F.array_join(prints, ""))


def with_fingerprint(rows: DataFrame, text: F.Column, lexicon_hashes: list[int], name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of a text: a hex string of four digits for each subset, 0000 where it has no term.

    A text without terms has only zeros. Steps are columns of their own, so none is computed twice.
    """
    rows = rows.withColumn("__terms", terms(text)).withColumn("__own", lexicon_terms("__terms", lexicon_hashes))
    rows = rows.withColumn("__used", F.when(F.size("__own") > 0, F.col("__own")).otherwise(F.array_sort("__terms")))
    return rows.withColumn(name, _printed(F.col("__used"))).drop("__terms", "__own", "__used")


def likeness(a: F.Column, b: F.Column) -> F.Column:
    """Likeness of two fingerprints, 0 to 1; equal fingerprints give 1.

    Within each density: the share of equal subsets among those that hold a term of either text. The larger
    of the two shares counts; a density with fewer than ``LEAST_USED`` such subsets says nothing.
    """
    half = SUBSETS // 2

    def share(first: int) -> F.Column:
        spots = F.sequence(F.lit(first), F.lit(first + half - 1))
        part = lambda s, i: F.substring(s, i * 4 + 1, 4)
        score = F.transform(spots, lambda i: F.when((part(a, i) == _NONE) & (part(b, i) == _NONE), 0).when(part(a, i) == part(b, i), 1001).otherwise(1))
        total = F.aggregate(score, F.lit(0), lambda x, y: x + y)
        used = total % 1000
        return F.when(used >= LEAST_USED, F.floor(total / 1000) / used).otherwise(0.0)

    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(share(0), share(half)))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of the next one and of the text with its last third replaced by the next one's start.

    ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row. Next is by
    descending id, null ids last, rows of one id by text hash; after the last row comes the first. A null text is
    empty. Rows are sorted within buckets of neighbouring ids, and a copy of each bucket's first row closes
    the bucket above, so texts move once and nothing is sorted as a whole.
    """
    spark, words = docs.sparkSession, lexicon(docs, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    bucket = F.coalesce(F.floor(F.col("id") / BUCKET_IDS), F.lit(-(1 << 62))).cast("long")
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"), bucket.alias("bucket"), F.lit(0).alias("closing"))

    # First row of each bucket in the order of the task: largest id, then smallest hash.
    rank = F.struct(F.col("id"), -F.col("h").cast("decimal(20,0)"))
    firsts = durable(rows.groupBy("bucket").agg(F.max_by(F.struct("id", "h"), rank).alias("first")))
    # The bucket above each: within stretches of the order of buckets, and from one stretch to the next.
    firsts = durable(firsts.repartitionByRange("bucket").withColumn("stretch", F.spark_partition_id()))
    lows = sorted((r.low, r.stretch) for r in firsts.groupBy("stretch").agg(F.min("bucket").alias("low")).collect())
    after = spark.createDataFrame([(p, lows[(i + 1) % len(lows)][0]) for i, (_, p) in enumerate(lows)], "stretch int, after long")
    above = F.coalesce(F.lead("bucket").over(Window.partitionBy("stretch").orderBy("bucket")), F.col("after"))
    firsts = firsts.join(F.broadcast(after), "stretch").select("first.id", "first.h", above.alias("above")).alias("f")
    small = firsts if firsts.count() > MOST_BROADCAST else F.broadcast(firsts)
    closing = rows.alias("r").join(small, F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.h") == F.col("f.h")))
    closing = closing.select("r.id", "r.text", "r.h", F.col("f.above").alias("bucket"), F.lit(1).alias("closing"))

    both = with_fingerprint(rows.unionByName(closing), F.col("text"), words)
    order = Window.partitionBy("bucket").orderBy("closing", F.col("id").desc_nulls_last(), "h")
    met = both.select("*", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint")).where("closing = 0")
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    met = met.select("id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail)).alias("edited"))
    met = with_fingerprint(met, F.col("edited"), words, "edited_fingerprint")
    return met.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
