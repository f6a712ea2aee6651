"""Near-duplicates by the Jaccard similarity of word shingles.

Texts of at least the wished similarity meet through banded MinHash: ``BANDS`` keys of ``ROWS`` minima each. At a
similarity of 0.8 a pair misses every band with probability (1 - 0.8 ** 4) ** 32, less than 1 in 20 million.
Fingerprints of 64 bits don't serve here: at 0.8 they are 10 bits apart on average and up to 18 in the tails,
where masks that lose no pair can fix only 3 or 4 bits. Texts that meet are linked by stars, never by all pairs.
Of each connected set of them every text is first compared with the set's first text, which places a family of
near copies in one pass. What that leaves is compared with the whole set, in blocks of at most about ``GROUP``
texts, so no task holds more than two blocks however large a set is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import group_starts, text_slices, whole_groups
from scholia.operators.components import connected_components
from scholia.plans.lineage import durable, written

BANDS, ROWS = 32, 4
SEED = 42
#: Candidates that are compared at once, and shingles that are permuted at once.
CHUNK, _BLOCK = 256, 2048
#: Hashes whose bits are counted at once.
_BITS = 1 << 16
#: Texts of a block, and first texts that a task remembers.
GROUP, HEADS = 512, 32
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the word shingles of a text in their order: words between ASCII blanks, A-Z lower-cased, repeats included.

    A text shorter than a shingle is one shingle; one without words (null, empty or blank) has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    first, last = [0, *ends[: n - 1].tolist()], (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, n)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    return np.unique(hashes(text, width))


def majority(h: np.ndarray) -> int:
    """64-bit SimHash: a bit is set if more than half of the hashes set it; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _BITS):
        counts += np.unpackbits(h[at : at + _BITS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def bands(own: np.ndarray) -> list[int]:
    """One signed key a band; sets share each with probability similarity ** ROWS."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), _BLOCK):
        np.minimum(low, (own[None, at : at + _BLOCK] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=low)
    keys = [xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(low.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def roots(sets: list[np.ndarray], threshold: float, same: np.ndarray | None = None) -> np.ndarray:
    """For each of the sets the place of the first one that it is linked to over pairs of at least the similarity.

    A pair is compared if it shares one of the locally rarest shingles, which no such pair can avoid, and is not
    linked yet. Those marked in ``same`` are known to be linked and aren't compared with each other.
    """
    same = np.zeros(len(sets), bool) if same is None else same
    sizes = np.array([len(s) for s in sets])
    _, token, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    own = [t[np.lexsort((t, freq[t]))] for t in np.split(token, ends[:-1])]
    first = int(np.flatnonzero(same)[0]) if same.any() else 0
    root = [first if linked else i for i, linked in enumerate(same.tolist())]
    met: tuple[dict, dict] = ({}, {})
    mark = np.zeros(len(freq), bool)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.argsort(sizes, kind="stable").tolist():
        n = sizes[i]
        prefix = own[i][: n - math.ceil(threshold * n - 1e-9) + 1].tolist()
        near = [np.array(m[t]) for m in (met[:1] if same[i] else met) for t in prefix if t in m]
        if near:
            others = np.unique(np.concatenate(near))
            others = others[sizes[others] + 1e-9 >= threshold * n]
            mark[own[i]] = True
            for at in range(0, len(others), CHUNK):
                part = [j for j in others[at : at + CHUNK].tolist() if find(j) != find(i)]
                if not part:
                    continue
                starts = np.cumsum([0, *sizes[part[:-1]]])
                both = np.add.reduceat(mark[np.concatenate([own[j] for j in part])].astype(np.int64), starts)
                for j in np.array(part)[both + 1e-9 >= threshold * (n + sizes[part] - both)].tolist():
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
            mark[own[i]] = False
        for t in prefix:
            met[int(same[i])].setdefault(t, []).append(i)
    return np.array([find(i) for i in range(len(sets))])


def _sketched(rows: DataFrame, width: int) -> DataFrame:
    """``(id, text_hash, key, fp, bands)``: key is the same for texts of the same shingles, 0 without words; fp is the fingerprint of all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                # One text after the other, so that no more than its own hashes are held.
                key, fps, keys = [], [], []
                for t in part.column("text"):
                    every = hashes(t.as_py(), width)
                    own = np.unique(every)
                    key.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0)
                    fps.append(majority(every))
                    keys.append(bands(own) if len(own) else [])
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), signed(key), signed(fps), pa.array(keys, pa.list_(pa.int64()))], ["id", "text_hash", "key", "fp", "bands"])

    return rows.mapInArrow(run, "id long, text_hash long, key long, fp long, bands array<long>")


def _with_first(texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """``(component, key, linked)`` from ``(component, key, text, parts)``: whether a text is like the one whose key names its component.

    A large component is dealt over its ``parts``, and its first text goes to each of them.
    """
    heads = texts.where("key = component").select("component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("first"))
    dealt = texts.withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, np.ndarray] = {}
        for batch in batches:
            linked = []
            for component, key, text, head in zip(*(batch.column(c) for c in ("component", "key", "text", "first")), strict=True):
                name = component.as_py()
                if name not in heads:
                    if len(heads) >= HEADS:
                        heads.clear()
                    heads[name] = shingles(head.as_py(), width)
                linked.append(key.as_py() == name or similarity(shingles(text.as_py(), width), heads[name]) + 1e-9 >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("key"), pa.array(linked, pa.bool_())], ["component", "key", "linked"])

    return dealt.join(heads, ["component", "part"]).select("component", "key", "text", "first").mapInArrow(run, "component long, key long, linked boolean")


def _in_blocks(texts: DataFrame, checked: DataFrame, width: int, threshold: float, group: int) -> DataFrame:
    """``(u, v)`` edges between keys: texts not like the first one of their component against all of the component."""
    counts = checked.groupBy("component").agg(F.count_if(~F.col("linked")).alias("free"), F.count("*").alias("all")).where("free > 0")
    counts = counts.select("component", F.ceil(F.col("free") / group).cast("int").alias("rows"), F.ceil(F.col("all") / group).cast("int").alias("cols"))
    own = checked.join(counts, "component").withColumn("h", F.xxhash64("key"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    down = own.where("not linked").select("component", "key", F.pmod("h", "rows").cast("int").alias("a"), every("cols").alias("b"))
    across = own.select("component", "key", "linked", F.pmod("h", "cols").cast("int").alias("b"), every("rows").alias("a"))
    places = down.select("component", "a", "b", "key", F.lit(False).alias("linked")).unionByName(across).distinct()
    placed = places.join(texts.select("key", "text"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["component", "a", "b"]
        for batch in whole_groups(batches, keys):
            starts, key, text, linked = group_starts(batch, keys), batch.column("key").to_numpy(), batch.column("text"), batch.column("linked").to_numpy(zero_copy_only=False)
            found = [a + roots([shingles(t.as_py(), width) for t in text[a:b]], threshold, linked[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            root = key[np.concatenate(found)]
            moved = root != key
            yield pa.RecordBatch.from_arrays([pa.array(key[moved]), pa.array(root[moved])], ["u", "v"])

    return placed.select("component", "a", "b", "key", "linked", "text").repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "key").mapInArrow(run, "u long, v long")


def grouped(rows: DataFrame, width: int, threshold: float, group: int = GROUP, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(id, text_hash, root)`` for rows ``(id, text, text_hash)``: root is shared over pairs of at least the similarity.

    ``near`` may bring together further texts as candidates: from the distinct ``fp`` of texts with words it gives edges ``(u, v)`` between these.
    """
    sketch = durable(_sketched(rows, width))
    one = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("text_hash").alias("h"), F.col("bands").alias("bands")))
    distinct = durable(sketch.where("key <> 0").groupBy("key").agg(one.alias("one")))
    met = distinct.select("key", F.posexplode("one.bands").alias("band", "at"))
    shared = met.groupBy("band", "at").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("band", "at", "low")
    links = met.join(shared, ["band", "at"]).where("key <> low").select(F.col("key").alias("u"), F.col("low").alias("v"))
    if near is not None:
        # Texts of one key may differ in their fingerprints, so all of these take part. Edges between fingerprints
        # become edges between keys, so that both kinds of candidates meet in the same rounds.
        keyed = durable(sketch.where("key <> 0").select("key", "fp").distinct())
        lows = durable(keyed.groupBy("fp").agg(F.min("key").alias("low")))
        ends = [lows.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low")) for c in "uv"]
        linked = near(lows.select("fp")).join(ends[0], "u").join(ends[1], "v").where("u_low <> v_low").select(F.col("u_low").alias("u"), F.col("v_low").alias("v"))
        links = links.unionByName(keyed.join(lows, "fp").where("key <> low").select(F.col("key").alias("u"), F.col("low").alias("v"))).unionByName(linked)
    placed = connected_components(links).withColumnRenamed("node", "key")
    # A Parquet table has a known size, so that the texts are not shuffled while few of them have met another one.
    parts = placed.groupBy("component").agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    members = written(distinct.join(placed.join(parts, "component"), "key").select(F.col("one.id").alias("id"), F.col("one.h").alias("text_hash"), "key", "component", "parts")).alias("m")
    met_texts = rows.alias("r").join(members, F.col("r.id").eqNullSafe(F.col("m.id")) & (F.col("r.text_hash") == F.col("m.text_hash")))
    texts = written(met_texts.select("component", "key", "text", "parts").dropDuplicates(["key"]))
    checked = durable(_with_first(texts, width, threshold))
    like = checked.where("linked and key <> component").select(F.col("key").alias("u"), F.col("component").alias("v"))
    edges = durable(like.unionByName(_in_blocks(texts, checked, width, threshold, group)))
    linked = connected_components(edges).select(F.col("node").alias("key"), F.col("component").alias("root"))
    return sketch.join(linked, "key", "left").select("id", "text_hash", F.coalesce("root", "key").alias("root"))
