"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are sorted by Gray rank over the whole table. A node of the index is a stretch of that order whose
fingerprints share a mask of leading bits: the first ``1 + log2(n / LEAF)`` bits at the top level, ``STEP`` more
at every level below, and a node is split only while it holds more than ``LEAF`` fingerprints. So every leaf is
bounded, however alike the fingerprints are: with all 64 bits fixed it holds a single one.

The search descends from pairs of top nodes whose masked patterns differ in at most two bits to pairs of
leaves, adding up differences: a pair of nodes that already differs in more is dropped with all that is below
it. Pairs of leaves are dropped by all the bits that the fingerprints of each have in common, and within a
pair of leaves runs of neighbours in Gray order, which share still more bits, are dropped in the same way. No
step compares all fingerprints of a group with each other, and none loses a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm import jaccard
from scholia.llm.common import text_slices
from scholia.operators.components import connected_components
from scholia.plans.lineage import durable

RADIUS = 2
SHINGLE = 3
#: Nodes above this many fingerprints are split, by so many further bits.
LEAF, STEP = 256, 6
#: Neighbours of a leaf that are dropped together, and pairs of leaves that are compared at a time.
RUN, _PAIRS = 8, 128


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text: words between ASCII blanks, A-Z lower-cased, repeats included.

    A bit is set if more than half of the shingle hashes set it. Texts without words (null, empty or
    blank) give 0; a text shorter than a shingle is one shingle.
    """
    return jaccard.majority(jaccard.hashes(text, shingle))


def text_key(text: F.Column) -> F.Column:
    """64-bit hash that tells rows of one id apart; a null text differs from an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("\x00null")))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, text_hash, fp)`` per row: fp is the fingerprint as a signed long, text_hash tells repeated ids apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", text_key(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                fps = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), pa.array(fps)], ["id", "text_hash", "fp"])

    return rows.mapInArrow(run, "id long, text_hash long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def leading(bits: int) -> int:
    """The mask of so many leading bits, as a signed long."""
    return _signed((1 << 64) - (1 << (64 - bits)))


def _rank(fp: F.Column) -> F.Column:
    """Position in Gray order as a long that sorts like the unsigned rank."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _apart(a: str, b: str, mask: F.Column | None = None) -> F.Column:
    differ = F.col(a).bitwiseXOR(F.col(b))
    return F.bit_count(differ if mask is None else differ.bitwiseAND(mask))


def node_levels(fps: DataFrame, leaf: int = LEAF) -> list[tuple[int, DataFrame, DataFrame | None]]:
    """``(bits, nodes, members)`` of each level of the index over distinct longs ``fp``, from the top.

    ``nodes`` has (mask, pattern, parent, n), ``members`` the (mask, pattern, fp) of its leaves. Bits grow until no
    node is too large.
    """
    n = fps.count()
    bits = min(64, 1 + max(0, math.ceil(math.log2(max(1, n) / leaf))))
    # By range of the rank, so that a node's rows come from one task's stretch of the order or a few neighbours'.
    rows = durable(fps.select("fp", _rank(F.col("fp")).alias("rank")).repartitionByRange("rank"))
    above, levels = None, []
    while True:
        keyed = rows.select("fp", F.lit(leading(bits)).alias("mask"), F.col("fp").bitwiseAND(F.lit(leading(bits))).alias("pattern"))
        parent = F.lit(0).cast("long") if above is None else F.col("pattern").bitwiseAND(F.lit(leading(above)))
        nodes = durable(keyed.groupBy("mask", "pattern").agg(F.count("*").alias("n")).withColumn("parent", parent))
        large = nodes.where((F.col("n") > leaf) & F.lit(bits < 64)).select("pattern")
        hot = large.count()
        levels.append((bits, nodes, keyed if not hot else keyed.join(large, "pattern", "left_anti")))
        if not hot:
            return levels
        rows = durable(rows.withColumn("pattern", F.col("fp").bitwiseAND(F.lit(leading(bits)))).join(large, "pattern", "left_semi").select("fp", "rank"))
        above, bits = bits, min(64, bits + STEP)


def _variants(bits: int) -> list[int]:
    """All masks of at most ``RADIUS`` of the leading bits."""
    one = [_signed(1 << (63 - i)) for i in range(bits)]
    return [0, *one, *(x ^ y for i, x in enumerate(one) for y in one[:i])]


def leaf_pairs(levels: list[tuple[int, DataFrame, DataFrame | None]], leaf: int = LEAF) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``(a_mask, a, b_mask, b)`` of all pairs of leaves that the descent can't tell apart, and what it did.

    The list has for each level its bits, its number of nodes and the pairs of nodes that were kept for the next.
    """
    (bits, top, _), found, did = levels[0], None, []
    near = top.select(F.col("mask").alias("a_mask"), F.col("pattern").alias("a"), F.col("n").alias("a_n"), F.explode(F.array(*[F.lit(v) for v in _variants(bits)])).alias("v"))
    near = near.select("a_mask", "a", "a_n", F.col("a").bitwiseXOR(F.col("v")).alias("b"))
    near = near.where(F.col("a") <= F.col("b")).join(top.select(F.col("mask").alias("b_mask"), F.col("pattern").alias("b"), F.col("n").alias("b_n")), "b")
    for level, (bits, nodes, _) in enumerate(levels):
        last = level == len(levels) - 1
        split = lambda side: (F.col(f"{side}_mask") == F.lit(leading(bits))) & (F.col(f"{side}_n") > leaf)
        done = near if last else near.where(~(split("a") | split("b")))
        done = done.select("a_mask", "a", "b_mask", "b")
        found = done if found is None else found.unionByName(done)
        if last:
            return found, did
        # Pairs with a node that is split go on, with its children in its place.
        going = durable(near.where(split("a") | split("b")))
        did.append((bits, nodes.count(), going.count()))
        below, mask = levels[level + 1][1], F.lit(leading(bits))
        for side in "ab":
            child = below.select(F.col("parent").alias(side), F.col("mask").alias("c_mask"), F.col("pattern").alias("c"), F.col("n").alias("c_n"))
            stays = going.where(~split(side))
            moved = going.where(split(side)).join(child, side).select(*[c for c in going.columns if c[0] != side], F.col("c_mask").alias(f"{side}_mask"), F.col("c").alias(side), F.col("c_n").alias(f"{side}_n"))
            going = stays.unionByName(moved)
        both = F.col("a_mask").bitwiseAND(F.col("b_mask"))
        # A node paired with itself gives each pair of its children twice.
        near = going.where((_apart("a", "b", both) <= RADIUS) & ((F.col("a_mask") != F.col("b_mask")) | (F.col("a") <= F.col("b")) | (F.col("a").bitwiseAND(mask) != F.col("b").bitwiseAND(mask))))


def near_links(fps: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``(u, v)`` edges that connect all distinct fingerprints within two bits of each other.

    ``fps`` has one column fp of distinct longs. Each pair of leaves gives a spanning star of every set of
    fingerprints that it connects, never all its pairs; no connection is lost.
    """
    levels = node_levels(fps, leaf)
    members = levels[0][2]
    for _, _, more in levels[1:]:
        members = members.unionByName(more)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(_rank(F.col("fp")).alias("rank"), "fp"))), lambda x: x["fp"])
    same = F.expr("~(bit_or(fp) ^ bit_and(fp))")
    leaves = durable(members.groupBy("mask", "pattern").agg(F.bit_and("fp").alias("ones"), same.alias("fixed"), ordered.alias("fps")))
    pairs = leaf_pairs(levels, leaf)[0]
    for side in "ab":
        pairs = pairs.join(leaves.select(*[F.col(c).alias(f"{side}{n}") for c, n in (("mask", "_mask"), ("pattern", ""), ("ones", "_ones"), ("fixed", "_fixed"), ("fps", "_fps"))]), [f"{side}_mask", side])
    close = pairs.where(_apart("a_ones", "b_ones", F.col("a_fixed").bitwiseAND(F.col("b_fixed"))) <= RADIUS)
    return close.select("a_fps", "b_fps").mapInArrow(_compare, "u long, v long")


def _padded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length with the values of each list, and which of them are values; whole runs."""
    sizes = np.diff(lists.offsets.to_numpy())
    width = -(-int(sizes.max()) // RUN) * RUN
    there = np.arange(width) < sizes[:, None]
    out = np.zeros(there.shape, np.uint64)
    out[there] = lists.flatten().to_numpy().view(np.uint64)
    return out, there


def _runs(fp: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits that all fingerprints of a run have set, and bits in which they agree; an empty run has neither."""
    shape = (len(fp), -1, RUN)
    ones = np.bitwise_and.reduce(np.where(there, fp, ~np.uint64(0)).reshape(shape), axis=2)
    some = np.bitwise_or.reduce(fp.reshape(shape), axis=2)
    return ones, ~(ones ^ some)


def pairs_within(a: np.ndarray, in_a: np.ndarray, b: np.ndarray, in_b: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in a and place in b of all values at most ``radius`` bits apart, of padded rows in Gray order."""
    (ones_a, fixed_a), (ones_b, fixed_b) = _runs(a, in_a), _runs(b, in_b)
    differ = (ones_a[:, :, None] ^ ones_b[:, None, :]) & fixed_a[:, :, None] & fixed_b[:, None, :]
    row, i, j = np.nonzero(np.bitwise_count(differ) <= radius)
    x, y = a.reshape(len(a), -1, RUN)[row, i], b.reshape(len(b), -1, RUN)[row, j]
    good = np.bitwise_count(x[:, :, None] ^ y[:, None, :]) <= radius
    good &= in_a.reshape(len(a), -1, RUN)[row, i][:, :, None] & in_b.reshape(len(b), -1, RUN)[row, j][:, None, :]
    at, k, m = np.nonzero(good)
    return row[at], i[at] * RUN + k, j[at] * RUN + m


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _PAIRS):
            part = batch.slice(at, _PAIRS)
            (a, in_a), (b, in_b) = _padded(part.column("a_fps")), _padded(part.column("b_fps"))
            row, i, j = pairs_within(a, in_a, b, in_b)
            u, v = a[row, i], b[row, j]
            linked = u != v
            if not linked.any():
                continue
            values, ends = np.unique(np.stack([u[linked], v[linked]]), return_inverse=True)
            root = spanning_roots(len(values), *ends.reshape(2, -1))
            moved = np.flatnonzero(root != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[moved].view(np.int64)), pa.array(values[root[moved]].view(np.int64))], ["u", "v"])


def spanning_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n items over the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_hash, fp, fingerprint, component_id)`` for every row of ``docs``.

    component_id is the smallest id reachable over fingerprints at most two bits apart; rows with a null id
    take part but never name a component unless all its ids are null (then null). Repeated rows stay
    repeated. An empty table gives no rows.
    """
    rows = durable(with_fingerprints(docs, id_col, text_col))
    distinct = durable(rows.groupBy("fp").agg(F.min("id").alias("low")))
    links = near_links(distinct.select("fp"))
    roots = connected_components(links)
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    placed = durable(placed)
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = placed.join(lowest, "root").select("fp", "component_id", "root")
    named = rows.join(by_fp, "fp", "left")
    return named.select("id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float | None = None) -> DataFrame:
    """Keep one row of ``docs`` per group: the smallest id (nulls last), then the smallest text hash.

    Without a threshold groups are those of ``near_duplicates``, whose shingles have a fixed width. With one
    texts within two bits, found through the Gray-order index, are candidates, as are those that a search for the wider
    rest brings together (``jaccard``), since likeness at a threshold spreads over more bits; groups connect texts whose sets of ``shingle`` words have at least this Jaccard similarity; texts without words are alike.
    Columns of ``docs`` stay as they are, whatever their names. Rows that repeat both id and text are one.
    """
    if threshold is None:
        if shingle != SHINGLE:
            raise ValueError("another width of shingles needs a threshold")
        found = near_duplicates(docs, id_col, text_col)
    else:
        rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
        rows = rows.withColumn("text_hash", text_key(F.col("text")))
        found = jaccard.grouped(rows, shingle, threshold, near=near_links)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("text_hash").alias("h")))
    keep = found.groupBy("root").agg(first.alias("w")).select(F.col("w.id").alias("id"), F.col("w.h").alias("h")).alias("keep")
    # The row is one column, so that no name of its columns can meet a name used here.
    own = docs.select(docs[id_col].cast("long").alias("id"), text_key(docs[text_col].cast("string")).alias("h"), F.struct("*").alias("row")).alias("own")
    kept = own.join(keep, F.col("own.id").eqNullSafe(F.col("keep.id")) & (F.col("own.h") == F.col("keep.h")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("id", "h").orderBy("id"))
    return kept.withColumn("nth", nth).where("nth = 1").select("row.*")
