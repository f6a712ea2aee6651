"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands.

Texts become token ids with an end mark, cut into pieces of at most a sequence's length; a full piece is a sequence
of its own. The other pieces are dealt by hash into regions of about ``REGION`` pieces, a fair sample of all lengths
each. Every region is searched by several islands, rows of their own in the Spark job, each with a population of
packings. A crossover injects whole well-filled bins of one parent into the other, removes the bins that hold the
same pieces again, and places what those displace by best fit, longest first. Between rounds the best packing of an
island moves to the next island of its region; a region is left alone once it needs no more bins than its tokens fill.

A region's least filled bins, at most half of its pieces, are given up and their pieces packed again in fewer regions,
until one region is left. So waste doesn't grow with the number of regions, while no task ever holds more than a
few regions, and the driver sees only counts.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import text_slices
from scholia.plans.lineage import dropped, written

CAPACITY, END_ID = 4096, 1
REGION, ISLANDS, ROUNDS, POPULATION, CHILDREN = 2048, 3, 3, 4, 12
#: Bins filled less than this may be given up for another level.
WELL_FILLED = 0.995
TABLE_WORDS = 1_000_000
#: Letters of the Latin blocks (but one whose lower case is two characters), then signs of ASCII, without apostrophes as those may begin a word.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ȿ]+)([!-&(-/:-@\[-`{-~]*)")
#: How the byte-level model spells bytes that have no printable character.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b))}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    """Ids by distinct parts between blanks: the tokenizer drops white space and no token goes over it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.table: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, without the end mark; distinct parts of these texts are looked up once."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.table.get, parts))
        new = [i for i, raw in enumerate(found) if raw is None]
        if new:
            if len(self.table) > TABLE_WORDS:
                # What these texts hold stays: frequent parts are among it.
                self.table, self.words = {p: raw for p, raw in zip(parts, found, strict=True) if raw is not None}, {}
            self._learn([parts[i] for i in new])
            for i in new:
                found[i] = self.table[parts[i]]
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = coded.indices.to_numpy(zero_copy_only=False)
        n, starts = sizes[at], (np.cumsum(sizes) - sizes)[at]
        ends = np.cumsum(n)
        flat = ids[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _learn(self, parts: list[str]) -> None:
        # A run of letters is one word of the model, and so is a run of signs after it: nothing normalises these letters but lower case.
        rest, words, table = [], self.words, self.table
        for p in parts:
            if m := _SIMPLE.fullmatch(p):
                table[p] = b"".join([words[w] if w in words else self._word(w) for w in (m[1].lower(), m[2]) if w])
            else:
                rest.append(p)
        for p, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            table[p] = np.array(e.ids, "<u4").tobytes()

    def _word(self, w: str) -> bytes:
        shown = w if w.isascii() else w.encode().decode("latin-1").translate(_SHOWN)
        raw = self.words[w] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return raw


_PIECE = "row long, id long, piece int, start long, length int, crc long"


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(row, id, piece, start, length, crc)``: each text's ids and the end mark in pieces of at most ``capacity``."""
    names = [x.split()[0] for x in _PIECE.split(", ")]
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                out: list[tuple] = []
                encoded = own.encode(part.column("text"))
                for row, i, ids in zip(part.column("row").to_pylist(), part.column("id").to_pylist(), encoded, strict=True):
                    ids = np.concatenate([ids, end])
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        own_ids = ids[at : at + capacity]
                        out.append((row, i, k, at, len(own_ids), zlib.crc32(own_ids.tobytes())))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE)


class Packing:
    """Bins of pieces by number, with each bin's load."""

    __slots__ = ("bins", "loads")

    def __init__(self, bins: np.ndarray, lengths: np.ndarray):
        self.bins, self.loads = bins, np.bincount(bins, lengths).astype(np.int64)

    def worth(self, capacity: int) -> tuple[int, float]:
        """Fewer bins first; of equally many, those whose waste is gathered in few."""
        return -len(self.loads), float(((self.loads / capacity) ** 2).sum())


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, loads: list[int], capacity: int) -> np.ndarray:
    """Put the pieces of ``order``, one after the other, into the fullest bin that takes them, else a new one; ``bins`` is filled in place."""
    free = sorted((capacity - load) << 16 | i for i, load in enumerate(loads) if load < capacity)
    count = len(loads)
    for i, w in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(free, w << 16)
        if at < len(free):
            space = free.pop(at)
        else:
            space = capacity << 16 | count
            count += 1
        bins[i] = space & 0xFFFF
        if space - (w << 16) >= 1 << 16:
            insort(free, space - (w << 16))
    return bins


def crossover(a: Packing, b: Packing, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """``a`` with some of the best-filled bins of ``b``; pieces (longest first) that this displaces go where they fit best."""
    rank = np.argsort(-b.loads, kind="stable")[: max(1, len(b.loads) // 2)]
    taken = np.zeros(len(b.loads), bool)
    taken[rng.choice(rank, max(1, len(rank) // int(rng.integers(2, 9))), replace=False)] = True
    injected = taken[b.bins]
    hit = np.zeros(len(a.loads), bool)
    hit[a.bins[injected]] = True
    # The worst bins of the receiving packing are opened too, so that their pieces may fill gaps.
    hit[np.argsort(a.loads, kind="stable")[: int(rng.integers(0, 4))]] = True
    displaced = hit[a.bins] & ~injected
    kept = np.cumsum(~hit) - 1
    bins = kept[a.bins]
    bins[injected] = (kept[-1] + np.cumsum(taken))[b.bins[injected]]
    loads = [*a.loads[~hit].tolist(), *b.loads[taken].tolist()]
    return Packing(best_fit(lengths, np.flatnonzero(displaced), bins, loads, capacity), lengths)


def evolved(lengths: np.ndarray, population: list[np.ndarray], migrant: np.ndarray | None, seed: list[int], capacity: int = CAPACITY, size: int = POPULATION, children: int = CHILDREN) -> list[np.ndarray]:
    """One round of an island: the population after ``children`` crossovers, best first. ``lengths`` descend.

    Without a population the first packing is best fit by decreasing length, the others by lengths with noise.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    least = -(-int(lengths.sum()) // capacity)
    own = [Packing(p, lengths) for p in population] + ([Packing(migrant, lengths)] if migrant is not None else [])
    while not own or (len(own) < size and len(own[0].loads) > least):
        noise = rng.uniform(1 - 0.08 * len(own), 1, len(lengths))
        own.append(Packing(best_fit(lengths, np.argsort(-lengths * noise, kind="stable"), np.zeros(len(lengths), np.int64), [], capacity), lengths))
    own.sort(key=lambda p: p.worth(capacity), reverse=True)
    own = own[:size]
    for _ in range(children if len(own) > 1 else 0):
        if len(own[0].loads) <= least:
            break
        i, j = rng.choice(len(own), 2, replace=False)
        child = crossover(own[i], own[j], lengths, capacity, rng)
        if child.worth(capacity) > own[-1].worth(capacity):
            own[-1] = child
            own.sort(key=lambda p: p.worth(capacity), reverse=True)
    return [p.bins for p in own]


_STATE = "region long, island int, lengths array<int>, population array<binary>, n_bins int, fill double, done boolean"


def _evolve(rows: DataFrame, turn: int, capacity: int) -> DataFrame:
    """One round of all islands; rows ``(region, island, lengths, population, migrant)``."""
    names = [x.split()[0] for x in _STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda raw: np.frombuffer(raw, "<u2").astype(np.int64)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                found = evolved(lengths, [read(p) for p in row["population"] or []], read(row["migrant"]) if row["migrant"] is not None else None, [row["region"], row["island"], turn], capacity)
                best = Packing(found[0], lengths)
                worth = best.worth(capacity)
                done = -worth[0] <= -(-int(lengths.sum()) // capacity)
                out.append((row["region"], row["island"], row["lengths"], [p.astype("<u2").tobytes() for p in found], -worth[0], worth[1], done))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.int32(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    return rows.mapInArrow(run, _STATE)


_ITEM = "neg int, row long, piece int, id long, start long, crc long"


def _placed(regions: DataFrame, capacity: int, last: bool) -> DataFrame:
    """Each piece with its bin and its offset there, from rows ``(region, items, best)``; and whether its bin is given up."""
    names = ["row", "piece", "id", "start", "length", "crc", "region", "bin", "offset", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items = batch.column("items").slice(i, 1).flatten()
                part = {k: items.field(k).to_numpy(zero_copy_only=False) for k in ("neg", "row", "piece", "start", "crc")}
                bins, lengths = np.frombuffer(batch.column("best")[i].as_py(), "<u2").astype(np.int64), -part["neg"].astype(np.int64)
                loads, pieces_in = np.bincount(bins, lengths), np.bincount(bins)
                order = np.argsort(bins, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                offset = np.empty(len(bins), np.int64)
                offset[order] = before - (np.cumsum(loads) - loads)[bins[order]]
                again = np.zeros(len(loads), bool)
                if not last:
                    worst = np.argsort(loads, kind="stable")[: max(1, len(loads) // 4)]
                    again[worst] = (loads[worst] < WELL_FILLED * capacity) & (np.cumsum(pieces_in[worst]) <= len(bins) // 2)
                region = np.full(len(bins), batch.column("region")[i].as_py(), np.int64)
                cols = [part["row"], part["piece"], items.field("id"), part["start"], lengths.astype(np.int32), part["crc"], region, bins, offset, again[bins]]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], names)

    return regions.mapInArrow(run, "row long, piece int, id long, start long, length int, crc long, region long, bin long, offset long, again boolean")


def _level(rows: DataFrame, n: int, level: int, capacity: int) -> tuple[DataFrame, bool]:
    """Pack ``n`` pieces in regions; gives _placed and whether this was the last level."""
    regions = max(1, -(-n // REGION))
    item = F.struct((-F.col("length")).alias("neg"), "row", "piece", "id", "start", "crc")
    # A region holds about REGION pieces whatever the lengths: pieces are dealt by a hash of what tells them apart.
    dealt = rows.groupBy(F.pmod(F.xxhash64(F.lit(level), "row", "piece"), F.lit(regions)).alias("region")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    items = written(dealt)
    lengths = items.select("region", F.transform("items", lambda x: -x["neg"]).alias("lengths"))
    start = lengths.select("region", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", F.lit(None).cast("array<binary>").alias("population"), F.lit(None).cast("binary").alias("migrant"))
    state = written(_evolve(start.repartition("region", "island"), 0, capacity))
    ready = [state]
    for turn in range(1, ROUNDS + 1):
        open_ = state.where(~F.col("done"))
        if open_.isEmpty():
            break
        elite = state.select("region", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("population")[0].alias("migrant"))
        # A region stays open until one of its islands is done.
        still = state.groupBy("region").agg(F.max("done").alias("over")).where(~F.col("over")).select("region")
        state = written(_evolve(state.join(still, "region", "left_semi").join(elite, ["region", "island"]), turn, capacity))
        ready.append(state)
    best = ready[0]
    for x in ready[1:]:
        best = best.unionByName(x)
    best = best.groupBy("region").agg(F.min_by(F.col("population")[0], F.struct("n_bins", -F.col("fill"), "island")).alias("best"))
    placed = written(_placed(items.join(best, "region"), capacity, regions == 1))
    for x in [*ready, items]:
        dropped(x)
    return placed, regions == 1


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece of each row of ``docs``.

    A null or empty text is its end mark alone; repeated rows are packed each for itself; a null id stays null. An empty
    table gives no rows. Other columns of ``docs``, whatever their names, are not looked at. Only pieces, never texts,
    are shuffled.
    """
    whole = written(pieces(docs, path, id_col, text_col, capacity, end_id))
    columns = ["id", "piece", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32")]
    out = whole.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows, level = whole.where(F.col("length") < capacity), 0
    while n := rows.count():
        placed, last = _level(rows, n, level, capacity)
        kept = placed if last else placed.where(~F.col("again"))
        number = F.lit(level << 52) + F.shiftleft("region", 16) + F.col("bin")
        out = out.unionByName(kept.select(*columns, number.alias("sequence_id"), "offset"))
        if last:
            break
        rows, level = placed.where("again").select("row", "id", "piece", "start", "length", "crc"), level + 1
    return out
