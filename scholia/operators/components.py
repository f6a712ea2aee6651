"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.plans.lineage import durable, freeing


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; component = smallest node reachable.

    Edges with a null end are ignored; self-loops and repeated edges are harmless. A node that has only
    a self-loop is its own component. Each round hangs nodes closer to the smallest neighbour, so a chain
    of n nodes needs about log n rounds. Every round's edges are checkpointed.
    """
    u, v = F.col(src), F.col(dst)
    # Kept at once, so that what gives the edges runs a single time.
    own = durable(edges.where(u.isNotNull() & v.isNotNull()).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    loops, e = own.where("u = v").select(F.col("u").alias("node")), own.where("u <> v")
    before = _signature(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        e = durable(_small_star(_large_star(e)))
        now = _signature(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = found.unionByName(roots)
    alone = loops.join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))


def _signature(e: DataFrame) -> tuple:
    with freeing(e.sparkSession):
        return tuple(e.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    hung = e.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
    return hung.select("e.u", F.col("e.m").alias("v")).where(F.col("u") != F.col("v")).distinct()
