"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Documents of a source are dealt by hash into blocks, whose number grows with the rows. A source's target in words gives its
exact quota of block draws: every block as often as the target holds the whole source, and once more the
first blocks of a permuted order until the target is met, the last of them cut at a document. The vector of
all sources' quotas is split over the output shards by a binary tree: each node draws, by the multivariate
hypergeometric law, how many of each source's draws go to its left shards. A shard takes its own stretch of
each source's permuted draws, so stretches are disjoint and exhaust the quotas, and orders its rows by a hash.

Only totals per source reach the driver. Rows meet their block's totals and their shard in joins on
(source, block). Blocks of a source are ordered in two levels, so that a window sees about the root of their
number at a time; the one block that a source's target cuts holds at most about ``BLOCK_ROWS`` rows.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.plans.lineage import durable

#: Weights of the sources in code point order, repeating, and the most that a source repeats.
WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Rows of a block: as many as make this number of blocks, within these bounds.
BLOCKS = 1024
LEAST_ROWS, BLOCK_ROWS = 16, 4096
#: Totals of up to this many sources are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 20_000
SHARDS = 32
#: A shard is written in up to this many stretches of its order, so that no task has to sort a whole shard.
STRETCHES = 4096
SEED = 11
_NULL_LAST = "\U0010ffff"


def word_count(text: F.Column) -> F.Column:
    """Number of runs of characters other than the ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Words to take of each source: shares of the total by weight, none above ``repeats`` times its size."""
    share, caps = [float(weights[i % len(weights)]) for i in range(len(sizes))], [float(repeats * s) for s in sizes]
    left, weight, out = float(sum(sizes)), sum(share), [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (caps[i] / share[i], i)):
        out[i] = min(caps[i], left * share[i] / weight) if weight > 0 else 0.0
        left, weight = left - out[i], weight - share[i]
    return out


def split_quotas(quotas: list[int], shards: int = SHARDS, seed: int = SEED) -> list[list[int]]:
    """Draws of each source for each shard. Row and column sums are exact; shards differ by one draw at most."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(quotas)
    room = [total // shards + (i < total % shards) for i in range(shards)]

    def split(colors: list[int], lo: int, hi: int) -> list[list[int]]:
        if hi - lo == 1:
            return [colors]
        mid = (lo + hi) // 2
        need, rest, left = sum(room[lo:mid]), sum(colors), []
        for c in colors:
            rest -= c
            got = int(rng.hypergeometric(c, rest, need)) if need and c + rest else 0
            left.append(got)
            need -= got
        return split(left, lo, mid) + split([c - g for c, g in zip(colors, left, strict=True)], mid, hi)

    return split(list(quotas), 0, shards)


def _per_source(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows made on the driver, one a source, with the hint to broadcast them only where they are few."""
    parts = [spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows[i : i + 1000])), f"array<struct<{schema}>>"))) for i in range(0, max(1, len(rows)), 1000)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return F.broadcast(out) if len(rows) <= MOST_BROADCAST else durable(out)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``(id, text_hash, nth, size, source, source_size, target, draws)``.

    ``draws`` lists ``(shard, position)`` for each time that the mix takes the row, at most three; within a
    shard, rows in order of position are shuffled. Same rows, same result, whatever the partitions. Sources
    sort by code point, a null source is one source and comes last. Rows without words are never taken.
    Rows that repeat id, source and text are told apart by ``nth`` and taken on their own.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), word_count(text).alias("size"))
    kinds = rows.groupBy("id", "source", "text_hash", "size").agg(F.count("*").alias("copies"))
    kinds = durable(kinds.select("*", F.xxhash64(F.lit(seed), "id", "text_hash").alias("h")))
    per_source = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("rows")).collect()
    plan = [r.asDict() for r in sorted(per_source, key=lambda r: (r["source"] is None, r["source"] or ""))]
    for r, t in zip(plan, targets([r["source_size"] for r in plan]), strict=True):
        r["target"], r["blocks"] = t, max(1, -(-r["rows"] // min(BLOCK_ROWS, max(LEAST_ROWS, r["rows"] // BLOCKS))))
        r["full"] = int(t // r["source_size"]) if r["source_size"] else 0
        r["rest"] = t - r["full"] * r["source_size"]
    sources = _per_source(spark, plan, "source string, source_size long, target double, blocks long, full int, rest double")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    placed = kinds.alias("k").join(sources.alias("s"), same("k", "s")).select("k.*", "s.source_size", "s.target", "s.full", "s.rest", "s.blocks", F.pmod("k.h", F.col("s.blocks")).alias("block"))

    # Blocks in permuted order, with the words before each: within stretches of the order, then over the stretches.
    blocks = placed.groupBy("source", "block", "blocks", "full", "rest").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    h = F.xxhash64(F.lit(seed + 1), "source", "block")
    blocks = durable(blocks.select("*", h.alias("order"), F.floor((h / 2.0**64 + 0.5) * F.ceil(F.sqrt("blocks"))).alias("stretch")))
    within = Window.partitionBy("source", "stretch").orderBy("order", "block")
    over = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("source", "stretch").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    sums = sums.select("source", "stretch", F.coalesce(F.sum("w").over(over), F.lit(0)).alias("words_above"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("blocks_above")).alias("t")
    before = F.coalesce(F.sum("words").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("*", before.alias("words_in"), F.row_number().over(within).alias("turn_in")).alias("b")
    blocks = blocks.join(sums, same("b", "t") & (F.col("b.stretch") == F.col("t.stretch"))).select("b.source", "b.block", "b.full", "b.rest", "b.words", (F.col("words_in") + F.col("words_above")).alias("before"), (F.col("turn_in") + F.col("blocks_above") - 1).alias("turn"))
    blocks = durable(blocks.withColumn("extra", F.when(F.col("rest") >= F.col("before") + F.col("words"), 2).when(F.col("rest") > F.col("before"), 1).otherwise(0)))
    some = {r["source"]: (r["n"], r["extra"]) for r in blocks.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("extra") > 0).alias("extra")).collect()}
    quotas = [r["full"] * some[r["source"]][0] + some[r["source"]][1] for r in plan]
    ends = np.cumsum(np.array(split_quotas(quotas, shards, seed), dtype=np.int64).reshape(shards, len(plan)), axis=0)
    bounds = [{"source": r["source"], "n": some[r["source"]][0], "ends": [int(x) for x in ends[:, i]]} for i, r in enumerate(plan)]
    shard_of = _per_source(spark, bounds, "source string, n long, ends array<long>")

    # A draw is (epoch, place of the block); its number within the source tells the shard.
    drawn = blocks.alias("k").join(shard_of.alias("s"), same("k", "s")).select(
        "k.source", "k.block", "k.before", "k.extra", "k.rest",
        F.expr("transform(filter(sequence(0, full), e -> e < full or extra > 0), e -> size(filter(ends, x -> x <= e * n + turn)))").alias("shards"),
    )
    # Only the block where the rest of a target ends needs the words before each of its rows.
    cut = drawn.where("extra = 1").select(F.col("source").alias("cs"), F.col("block").alias("cb"), F.col("before").alias("words_before"), F.col("rest").alias("cut_rest"))
    inside = placed.join(cut, F.col("source").eqNullSafe(F.col("cs")) & (F.col("block") == F.col("cb")))
    within = Window.partitionBy("source", "block").orderBy(F.desc("size"), "h", "id", "text_hash")
    so_far = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("words_before")
    # Longest first, so that the target ends in a shorter row. A row is taken once more if more than half of it lies within the rest; of repeated rows the first few are.
    fit = F.when(F.col("size") > 0, F.floor((F.col("cut_rest") - so_far) / F.col("size") + 0.5)).otherwise(0)
    partial = inside.select("id", "source", "text_hash", "size", F.greatest(F.lit(0), F.least("copies", fit)).cast("long").alias("more"))

    joined = placed.alias("p").join(drawn.alias("d"), same("p", "d") & (F.col("p.block") == F.col("d.block")), "left")
    keys = ["id", "source", "text_hash", "size"]
    joined = joined.select("p.*", "d.extra", "d.shards").alias("p").join(partial.alias("c"), [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], "left").select("p.*", "c.more")
    each = joined.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
    times = F.when(F.col("size") == 0, 0).otherwise(F.col("full") + F.when(F.col("extra") == 2, 1).when((F.col("extra") == 1) & (F.col("nth") <= F.col("more")), 1).otherwise(0))
    # Within a shard rows are ordered by a hash of the draw, which mixes the blocks.
    position = lambda e: F.xxhash64(F.lit(seed + 2), "id", "text_hash", "nth", e)
    draws = F.transform(F.slice("shards", 1, times), lambda shard, e: F.struct(shard.alias("shard"), position(e).alias("position")))
    return each.select("id", "text_hash", "nth", "size", "source", "source_size", "target", F.coalesce(draws, F.array().cast("array<struct<shard:int,position:bigint>>")).alias("draws"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED, draw_col: str | None = None) -> DataFrame:
    """Rows of ``docs`` as the mix takes them, repeated as often as drawn, dealt by shard and shuffled within each.

    With ``draw_col`` a column of this name tells each row's ``(shard, position)``. Rows without words are left out. Tasks take stretches of a shard's order rather than whole shards, as the number of shards is fixed.
    """
    found = mix(docs, id_col, text_col, source_col, shards, seed).where(F.size("draws") > 0)
    once = found.groupBy("id", "text_hash", "source").agg(F.flatten(F.collect_list("draws")).alias("draws")).alias("m")
    # The row is one column, so that no name of its columns can meet a name used here.
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(source_col).cast("string").alias("s"), F.struct("*").alias("row")).alias("d")
    met = own.join(once, F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.h") == F.col("m.text_hash")) & F.col("d.s").eqNullSafe(F.col("m.source"))).select("d.*", "m.draws")
    # Of rows that repeat id, text and source the first stands for all their draws.
    nth = F.row_number().over(Window.partitionBy("id", "h", "s").orderBy("id"))
    drawn = met.withColumn("nth", nth).where("nth = 1").select("row", F.explode("draws").alias("draw"))
    drawn = drawn.withColumn("stretch", F.floor(F.col("draw.position") / (2**64 // STRETCHES)))
    dealt = drawn.repartition("draw.shard", "stretch").sortWithinPartitions("draw.shard", "draw.position")
    return dealt.select("row.*", F.struct("draw.shard", "draw.position").alias(draw_col)) if draw_col else dealt.select("row.*")
