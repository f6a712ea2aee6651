"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Distinct vectors are turned into binary codes: after a projection on principal axes, a rotation is learned by
alternating between the nearest signs and the best rotation to them (so that bits are balanced and lose
little). Several such rotations, from different starts, give enough bits for many tables; a table's key is a
substring of a code. Two vectors are candidates where a substring agrees and whose whole codes lie within a
Hamming radius, which follows from the threshold's angle; only those that have a candidate in a bucket get their
original vectors there, and are reranked by the exact cosine. So what every table deals are ids and packed codes,
and vectors travel only to where near ones meet. Substrings get longer, and tables more, as the number of vectors grows,
so buckets stay small; the number of tables follows from the threshold so that a pair right at it is met with
the wished recall.

A bucket never meets in one task beyond ``BLOCK`` vectors: larger ones are cut into blocks and pairs of blocks.
A link is counted in the first table where its vectors meet, which both codes tell, so no pair is written out;
what leaves a bucket is a number per vector and a spanning star of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import group_starts, one_blas_thread, whole_groups
from scholia.llm.simhash import spanning_roots
from scholia.operators.components import connected_components
from scholia.plans.lineage import durable

THRESHOLD = 0.9
RECALL = 0.97
#: Vectors fetched at most, about, to learn the rotations; every vector is indexed.
SAMPLE = 4000
BLOCK = 1024
#: The Hamming radius is the mean distance at the threshold and so many standard deviations of independent bits.
DEVIATIONS = 6


def learn_rotations(sample: np.ndarray, n_bits: int, seed: int = 13, rounds: int = 30) -> list[np.ndarray]:
    """Projections (dims x bits) with a learned rotation each, enough for ``n_bits`` bits; signs of x @ p are the code."""
    one_blas_thread()
    dims = sample.shape[1]
    rng = np.random.default_rng(seed)
    if len(sample):
        axes = np.linalg.svd(sample.T @ sample)[0]
        projected = sample @ axes
    else:
        axes, projected = np.eye(dims), np.zeros((0, dims))
    out = []
    while sum(p.shape[1] for p in out) < n_bits:
        rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(rounds if len(sample) else 0):
            signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(signs.T @ projected)
            rotation = (u @ vt).T
        out.append(axes @ rotation)
    return out


def table_plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a substring and number of tables for n distinct vectors.

    A bit of two vectors at the threshold's angle agrees with probability 1 - angle / pi.
    """
    width = min(28, max(4, round(math.log2(max(n, 2))) - 2))
    agree = (1 - math.acos(threshold) / math.pi) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def radius(n_bits: int, threshold: float = THRESHOLD) -> int:
    """Most bits in which the codes of vectors right at the threshold differ, but for rare exceptions."""
    p = math.acos(min(1.0, threshold)) / math.pi
    return math.ceil(n_bits * p + DEVIATIONS * math.sqrt(n_bits * p * (1 - p)))


def code_bits(unit: np.ndarray, rotations: list[np.ndarray], n_bits: int) -> np.ndarray:
    return np.concatenate([unit @ p >= 0 for p in rotations], axis=1)[:, :n_bits]


def substrings(bits: np.ndarray, width: int, tables: int) -> np.ndarray:
    """Keys of every code in every table."""
    return bits.reshape(len(bits), tables, width) @ (1 << np.arange(width)).astype(np.int64)


def usable(vectors: list) -> tuple[np.ndarray, list[int]]:
    """Unit vectors in double precision of those that are not null, not zero and wholly finite, and their places."""
    rows, places = [], []
    for i, v in enumerate(vectors):
        if v is not None and len(v) and None not in v:
            x = np.array(v, float)
            size = np.linalg.norm(x / (top := np.abs(x).max() or 1.0)) * top if np.isfinite(x).all() else 0.0
            if size > 0 and np.isfinite(size):
                rows.append(x / size)
                places.append(i)
    return rows, places


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors link at a cosine of ``threshold`` or more, and only with vectors of the same length. Equal vectors are
    one in the index and count one by one in ``n_links``. Null, empty, zero and partly null or non-finite vectors
    link with nothing. ``component_id`` is the smallest id reachable; ``kept`` tells whether it is the row's own.
    Null ids take part, and name a component only if it has no other (then kept).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 equals 0.0; one spelling makes equal vectors equal keys.
    rows = rows.withColumn("v", F.when(finite, F.transform("v", lambda x: x + F.lit(0.0))))
    distinct = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    # A vector's own number, as ids may be null or repeat: a hash that no two vectors share.
    distinct, number = _numbered(durable(distinct.withColumn("dims", F.size("v"))))
    counts = {r.dims: r["count"] for r in distinct.groupBy("dims").count().collect()}
    links, stars = None, None
    for dims, n in sorted(counts.items()):
        own = distinct.where(F.col("dims") == dims)
        part = durable(_bucket_links(own, dims, n, threshold, recall, block))
        links = part if links is None else links.unionByName(part)
    if links is None:
        found = rows.select("id", "v", F.lit(None).cast("long").alias("rep"))
        return found.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    stars = links.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v"))
    numbers = links.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = connected_components(stars).withColumnRenamed("node", "rep")
    placed = distinct.select("rep", "low", "copies").join(numbers, "rep", "left").join(roots, "rep", "left")
    placed = durable(placed.select("rep", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_rep = placed.join(lowest, "root").select("rep", "n_links", "component_id")
    met = rows.select("id", number.alias("rep"), F.col("v").isNotNull().alias("good")).join(by_rep, "rep", "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("id"))
    return met.select("id", F.when(F.col("good"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _numbered(distinct: DataFrame, tries: int = 16) -> tuple[DataFrame, F.Column]:
    """``distinct`` vectors with a number ``rep`` of their own, and the expression that gives it."""
    for seed in range(tries):
        number = F.xxhash64(F.lit(seed), "v")
        found = durable(distinct.withColumn("rep", number))
        if found.groupBy("rep").count().where("count > 1").isEmpty():
            return found, number
    raise ValueError("too many vectors for numbers of 64 bits")


def _bucket_links(own: DataFrame, dims: int, n: int, threshold: float, recall: float, block: int) -> DataFrame:
    """``(rep, n, other)``: links of a vector counted in a bucket, or (with n = 0) one edge of a bucket's spanning star."""
    width, tables = table_plan(n, threshold, recall)
    chosen = own.where(F.pmod(F.col("rep"), F.lit(1 << 20)) < max(1.0, SAMPLE / n * (1 << 20))).select("v").collect()
    sample = np.array(usable([r.v for r in chosen])[0]).reshape(-1, dims)
    n_bits = width * tables
    rotations = learn_rotations(sample, n_bits)
    near = radius(n_bits, threshold)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, places = usable(batch.column("v").to_pylist())
            if not places:
                continue
            unit = np.array(unit)
            bits = code_bits(unit, rotations, n_bits)
            packed = pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())
            picked = batch.take(pa.array(places))
            yield pa.RecordBatch.from_arrays([picked.column("rep"), picked.column("copies"), _lists(unit), packed, _lists(substrings(bits, width, tables))], ["rep", "copies", "unit", "bits", "codes"])

    coded = durable(own.select("rep", "copies", "v").mapInArrow(encode, "rep long, copies long, unit array<double>, bits binary, codes array<long>"))
    keyed = coded.select("rep", "bits", F.posexplode("codes").alias("tbl", "code"))
    sizes = durable(keyed.groupBy("tbl", "code").agg(F.count("*").alias("size")).where("size > 1"))
    held = keyed.join(sizes, ["tbl", "code"]).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    held = held.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    held = held.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("their"))
    keys = ["tbl", "code", "a", "b"]
    held = held.select("rep", "bits", "tbl", "code", F.least("mine", "their").alias("a"), F.greatest("mine", "their").alias("b"), "mine")
    together = lambda df: df.repartition(*keys).sortWithinPartitions(*keys, "rep")
    meeting = together(held).mapInArrow(lambda batches: _meet(batches, n_bits, width, near), "tbl int, code long, a int, b int, mine int, rep long")
    full = together(meeting.join(coded.drop("codes"), "rep"))
    return full.select(*keys, "mine", "rep", "copies", "unit", "bits").mapInArrow(lambda batches: _rerank(batches, threshold, n_bits, width), "rep long, n long, other long")


def _unpacked(packed: pa.Array, n_bits: int) -> np.ndarray:
    flat = np.frombuffer(b"".join(packed.to_pylist()), np.uint8)
    return np.unpackbits(flat.reshape(len(packed), -1), axis=1)[:, :n_bits]


def _counted(i: np.ndarray, j: np.ndarray, codes: np.ndarray, mine: np.ndarray, table: int, crossing: bool) -> np.ndarray:
    """Pairs that count here: from different blocks where two meet, and in no earlier table together."""
    keep = ~(codes[i, :table] == codes[j, :table]).any(axis=1)
    return keep & (mine[i] != mine[j]) if crossing else keep


def _meet(batches: Iterator[pa.RecordBatch], n_bits: int, width: int, near: int) -> Iterator[pa.RecordBatch]:
    """Those rows of a bucket that have a candidate in it, by their codes alone."""
    one_blas_thread()
    keys = ["tbl", "code", "a", "b"]
    for batch in whole_groups(batches, keys):
        starts = group_starts(batch, keys)
        bits = _unpacked(batch.column("bits"), n_bits)
        codes = substrings(bits, width, n_bits // width)
        a, b, tables, mine = (batch.column(c).to_numpy() for c in ("a", "b", "tbl", "mine"))
        keep = np.zeros(batch.num_rows, bool)
        for lo, hi in zip(starts, starts[1:], strict=False):
            if hi - lo < 2:
                continue
            signs = bits[lo:hi].astype(np.float32) * 2 - 1
            i, j = np.nonzero(np.triu(signs @ signs.T >= n_bits - 2 * near, 1))
            counts = _counted(i, j, codes[lo:hi], mine[lo:hi], tables[lo], a[lo] != b[lo])
            keep[lo + i[counts]] = keep[lo + j[counts]] = True
        if keep.any():
            yield batch.select(["tbl", "code", "a", "b", "mine", "rep"]).filter(pa.array(keep))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64() if x.dtype == float else pa.int64()))


def _rerank(batches: Iterator[pa.RecordBatch], threshold: float, n_bits: int, width: int) -> Iterator[pa.RecordBatch]:
    one_blas_thread()
    keys = ["tbl", "code", "a", "b"]
    for batch in whole_groups(batches, keys):
        starts = group_starts(batch, keys)
        n = batch.num_rows
        unit = batch.column("unit").flatten().to_numpy().reshape(n, -1)
        codes = substrings(_unpacked(batch.column("bits"), n_bits), width, n_bits // width)
        rep, copies, mine = (batch.column(c).to_numpy() for c in ("rep", "copies", "mine"))
        a, b, tables = (batch.column(c).to_numpy() for c in ("a", "b", "tbl"))
        reps, ns, others = [], [], []
        for lo, hi in zip(starts, starts[1:], strict=False):
            if hi - lo < 2:
                continue
            x, own, t = unit[lo:hi], codes[lo:hi], tables[lo]
            i, j = np.nonzero(np.triu(x @ x.T >= threshold - 1e-9, 1))
            # The product above only finds candidates; the cosine itself is summed the same way for any pair.
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[exact], j[exact]
            counts = _counted(i, j, own, mine[lo:hi], t, a[lo] != b[lo])
            i, j = i[counts], j[counts]
            if not len(i):
                continue
            number = np.bincount(i, weights=copies[lo:hi][j], minlength=hi - lo) + np.bincount(j, weights=copies[lo:hi][i], minlength=hi - lo)
            root = spanning_roots(hi - lo, i, j)
            for at, count, other in ((np.flatnonzero(number), number, None), (np.flatnonzero(root != np.arange(hi - lo)), None, root)):
                reps.append(rep[lo:hi][at])
                ns.append(np.zeros(len(at), np.int64) if count is None else count[at].astype(np.int64))
                others.append(np.full(len(at), None, object) if other is None else rep[lo:hi][other[at]].astype(object))
        if reps:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps)), pa.array(np.concatenate(ns)), pa.array(np.concatenate(others), pa.int64())], ["rep", "n", "other"])
