"""Importance resampling towards a target distribution: array-scored weights and a distributed radix sort.

Word n-grams of the corpus and of the target texts are counted in hashed buckets. A bucket's gain, the logarithm
of how much more often the target holds it, stands in an array as long as the number of buckets, and a document's
weight is the mean of its features' gains, looked up in that array. With Gumbel noise from a hash of the id added,
the highest scores are a draw without replacement.

The highest scores are ranked by a radix sort from the least significant digit. Each pass is a stable counting
sort by one digit: rows are counted by (block of the present order, digit), prefix sums over digits, then blocks,
give where each (block, digit) begins, and a row's place is that plus its number within (block, digit). Places are
dense, so blocks of the next pass are equally full whatever digits repeat, no task ever sees more than a block of
rows, and the places after the last pass are the ranks. Only ``(score, id, n_features)`` of documents that can be
drawn take part; a histogram of scores tells which.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.plans.lineage import dropped, written

#: Words: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bits of a digit, and rows of a block of the present order.
DIGIT_BITS, BLOCK_ROWS = 16, 1 << 17


def words(text: F.Column) -> F.Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def features(own: F.Column, longest: int = LONGEST) -> F.Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one blank."""
    if longest == 1:
        return own
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size(own) - n + 1), lambda i: F.array_join(F.slice(own, i, F.lit(n)), " "))
    return F.concat(own, *[F.when(F.size(own) >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(2, longest + 1)])


def _bucket(feature: F.Column, buckets: int) -> F.Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(rows: DataFrame, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """Features in each bucket: one number a bucket reaches the driver."""
    own = rows.select(words(F.col(text_col).cast("string")).alias("w"))
    each = own.select(F.explode(features(F.col("w"), longest)).alias("f")).groupBy(_bucket(F.col("f"), buckets).alias("b")).agg(F.count("*").alias("n"))
    out = [0] * buckets
    for r in each.collect():
        out[r["b"]] = r["n"]
    return out


def gains(own: list[int], target: list[int]) -> list[int]:
    """Floored thousandfold logarithms of the ratio of smoothed shares, one a bucket."""
    n, s, t = len(own), float(sum(own)), float(sum(target))
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(own, target, strict=True)]


def scored(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """``(id, n_words, n_features, weight, score)``; the gains travel as one constant array in the plan.

    A null id is hashed as an empty one.
    """
    array = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), words(F.col(text_col).cast("string")).alias("w"))
    rows = rows.select("id", F.size("w").cast("long").alias("n_words"), features(F.col("w"), longest).alias("f"))
    total = F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + F.get(array, _bucket(x, len(gain))))
    rows = rows.select("id", "n_words", F.size("f").cast("long").alias("n_features"), total.alias("total"))
    # The floored mean in whole numbers.
    n = F.col("n_features")
    weight = F.when(n > 0, ((F.col("total") - F.pmod("total", n)) / n).cast("long")).otherwise(F.lit(0).cast("long"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return rows.select("id", "n_words", "n_features", weight.alias("weight"), (weight + noise).alias("score"))


def radix_ranked(rows: DataFrame, keys: list[F.Column], bits: int = DIGIT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``place`` from 0, ascending by ``keys`` (whole numbers, the most significant first; null last).

    A key of w bits over its range takes w / ``bits`` passes; digits that are the same for all rows take none. Rows equal in
    all keys keep some order between them. Each pass is written to the shared folder, so a lost executor repeats at most
    its part of one pass.
    """
    names = [f"k{i}" for i in range(len(keys))]
    # The row is one column, so none of its names can meet one used here.
    now = written(rows.select(F.struct("*").alias("row"), *[k.cast("long").alias(c) for c, k in zip(names, keys, strict=True)], F.monotonically_increasing_id().alias("place")))
    ends = now.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)], *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in names]).first()
    digits = []
    for c in reversed(names):
        lo, hi = ends[f"min_{c}"], ends[f"max_{c}"]
        if lo is not None and lo < hi:
            own = F.coalesce(c, F.lit(lo))
            # A range too wide for a difference is taken by its bits, the sign turned.
            value, width = (own - lo, (hi - lo).bit_length()) if hi - lo < 2**63 else (own.bitwiseXOR(F.lit(-(2**63))), 64)
            digits += [F.shiftrightunsigned(value, k).bitwiseAND((1 << bits) - 1) for k in range(0, width, bits)]
        if ends[f"null_{c}"]:
            digits.append(F.col(c).isNull().cast("long"))
    # The first order is by (partition, row); its blocks are the partitions, those of later passes stretches of places.
    block = F.shiftright("place", 33)
    for digit in digits or [F.lit(0).cast("long")]:
        cut = now.select("*", block.cast("long").alias("block"), digit.alias("digit"))
        met = written(cut.groupBy("digit", "block").agg(F.count("*").alias("m")))
        # Where each digit begins: one row a digit. Within a digit one block comes after the other.
        by_digit = met.groupBy("digit").agg(F.sum("m").alias("m")).select("digit", (F.sum("m").over(Window.orderBy("digit")) - F.col("m")).alias("begin"))
        before = F.sum("m").over(Window.partitionBy("digit").orderBy("block")) - F.col("m")
        begins = met.select("digit", "block", before.alias("before")).join(by_digit, "digit").select("digit", "block", (F.col("begin") + F.col("before")).alias("begin"))
        nth = F.row_number().over(Window.partitionBy("digit", "block").orderBy("place")) - 1
        moved = cut.join(begins, ["digit", "block"]).select("row", *names, (F.col("begin") + nth).alias("place"))
        after = written(moved)
        dropped(met)
        dropped(now)
        now, block = after, F.floor(F.col("place") / block_rows)
    return now.select("row.*", "place")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``(id, n_features, weight, score, rank)``, one row per row of ``docs``.

    Of the N rows with ``least_words`` words or more, floor(percent * N / 100) are drawn: those of the highest scores, of
    equal scores those with the smaller id (null last), of equal ids those with fewer features. Ranks count from 1; rows that
    aren't drawn have none. Null and empty texts have no features and weigh 0; without any row the result is empty. Other
    columns of ``docs``, whatever their names, are not looked at.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    rows = written(scored(docs, gain, id_col, text_col, longest, seed))
    able = F.col("n_words") >= least_words
    # Scores are whole numbers within a range that the logarithms bound, whatever the number of rows.
    above, least = 0, None
    counts = sorted(rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["score"])
    most = sum(r["n"] for r in counts) * percent // 100
    for r in counts:
        if above >= most:
            break
        above, least = above + r["n"], r["score"]
    out = ["id", "n_features", "weight", "score"]
    if least is None:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = able & (F.col("score") >= least)
    ranked = radix_ranked(rows.where(drawn).select(*out), [-F.col("score"), F.col("id"), F.col("n_features")])
    rank = F.when(F.col("place") < most, F.col("place") + 1).cast("long")
    return ranked.select(*out, rank.alias("rank")).unionByName(rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
