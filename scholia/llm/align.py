"""Alignment of two tokenizers over a corpus: token groups, links and the corpus-wide counts of linked ids.

A byte-level tokenizer (A) and a sentence-piece tokenizer (B) cut the same bytes; where both end a token a group
ends. Most groups hold one token of each with the same bytes, and an array over A's vocabulary tells beforehand
which id of B that is. Such groups take the fast path: they are counted in vectors as long as A's vocabulary and
looked up in vectors again. Only the links of other groups become rows of (id of A, id of B) that are summed over
the corpus and joined back.

Texts are cut into units at places where both tokenizers end a token whatever stands around (a blank or line end
after a word, a full stop after a letter), so a unit's tokens depend on nothing else and distinct units are aligned
once by the worker that reads them. Its table keeps the units that are used again and drops the others at
``TABLE_UNITS``; this bounds memory and changes no result.

Rows that meet in a shuffle are one a document and distinct pair. The pairs that occur most, at most
``FREQUENT`` of them by an exact count, are broadcast, so that no pair of a third of all documents makes a
hot key; all others are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.bpe import pieces
from scholia.llm.common import text_slices
from scholia.plans.lineage import dropped, written

TABLE_UNITS = 200_000
#: New units are aligned so many at a time.
ADD_UNITS = 20_000
#: Pairs of ids that are broadcast with their counts; the rest is joined by a shuffle.
FREQUENT = 1 << 17
#: A pair is (id of A) * 2**15 + (id of B); with this flag it is a group of the fast path and holds A's id only.
_SHIFT, _FAST = 15, 1 << 31
#: White space that the quick split below does not handle: other than a blank or line end, two in a row, or at the end.
_ODD = re.compile(r"[^\S \n]|[ \n][ \n]|[ \n]\Z")
#: Latin letters before a sign of ASCII, else all up to a blank or line end.
_QUICK = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[!-/:-@\[-`{-~])| ?[^ \n]+|\n")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
_CUTS = regex.compile(r"(?V1)(?<=\P{White_Space})(?=[ \n])|(?<=\P{White_Space}\n)(?=\P{White_Space})")
_SIGNS = frozenset(string.punctuation)
#: How the byte-level model spells bytes that have no printable character.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b))}


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


class Aligner:
    """Aligned units by number: counts of tokens, groups and links, the groups' spelling, and the links' pairs."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(a_path, encoding="utf-8") as f:
            self.a_bytes = pieces(json.load(f))
        spelled = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        special = [self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i) for i in range(len(spelled))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(spelled)]
        if len(self.b_bytes) > 1 << _SHIFT or len(self.a_bytes) > 1 << 16:
            raise ValueError("a vocabulary is too large for pairs of 31 bits")
        known = {x: i for i, x in enumerate(self.b_bytes) if not special[i]}
        #: The identity map: for each id of A the id of B with the same bytes, else -1.
        self.same = np.array([known.get(x, -1) for x in self.a_bytes], np.int64)
        # The quick split holds as long as no piece of B goes over its cuts.
        crossing = any(p.lstrip("▁").find("▁") >= 0 or "\n" in p or any(x.isalpha() and y in _SIGNS for x, y in zip(p, p[1:], strict=False)) for i, p in enumerate(spelled) if not special[i])
        self.whole = crossing
        self.a_len, self.b_len = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])
        spell = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.a_spell, self.b_spell = (spell(len(self.a_bytes), ","), spell(len(self.a_bytes), "|")), (spell(len(self.b_bytes), ","), spell(len(self.b_bytes), ";"))
        self._reset()

    def _reset(self) -> None:
        self.table: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((5, 0), np.int64)  # tokens of A, of B, groups, links; whether the bytes agree
        self.codes, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def units(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        return _CUTS.split(text) if _ODD.search(text) else _QUICK.findall(text)

    def _a_ids(self, units: list[str]) -> list[list[int]]:
        # A blank and Latin letters are one word of the model; the library splits all else.
        tokens = self.a.model.tokenize
        found = [[t.id for t in tokens(u.encode().decode("latin-1").translate(_SHOWN))] if _WORD.fullmatch(u) else None for u in units]
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.a.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        return found

    def _b_ids(self, units: list[str]) -> list[list[int]]:
        # B puts a blank before what it encodes; where the unit has none, a line end takes it and both go.
        led = [u[0] == " " for u in units]
        found = self.b.encode([u[1:] if x else "\n" + u for u, x in zip(units, led, strict=True)], num_threads=1)
        return [ids if x else ids[2:] for ids, x in zip(found, led, strict=True)]

    def add(self, units: list[str]) -> None:
        """Align new units, all at once: their bytes follow each other, so ends of tokens are places in one sequence."""
        if not units:
            return
        a_ids, b_ids = self._a_ids(units), self._b_ids(units)
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        good = np.ones(len(units), bool)
        for i, (u, x, y) in enumerate(zip(units, a_ids, b_ids, strict=True)):
            raw = u.encode()
            if b"".join(map(b_bytes, y)) != raw or b"".join(map(a_bytes, x)) != raw:
                good[i], a_ids[i], b_ids[i] = False, [], []
        n_a, n_b = np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids])
        a, b = np.fromiter(chain.from_iterable(a_ids), np.int64, n_a.sum()), np.fromiter(chain.from_iterable(b_ids), np.int64, n_b.sum())
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        first, last = np.searchsorted(b_end, a_end - self.a_len[a], "right"), np.searchsorted(b_end, a_end - 1, "right")
        a_last, b_last = b_end[last] == a_end if len(a) else np.zeros(0, bool), a_end[np.searchsorted(a_end, b_end)] == b_end if len(b) else np.zeros(0, bool)
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        alone = (np.bincount(a_group) == 1) & (np.bincount(b_group) == 1) if len(a) else np.zeros(0, bool)
        n = last - first + 1
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        left, right = np.repeat(a, n), b[at]
        fast = alone[np.repeat(a_group, n)] & (self.same[left] == right)
        unit_of = np.repeat(np.arange(len(units)), n_a)
        per_unit = lambda w: np.bincount(unit_of, w, len(units)).astype(np.int64)
        self.counts = np.concatenate([self.counts, [n_a, n_b, per_unit(a_last), per_unit(n), good]], 1)
        self.codes = np.concatenate([self.codes, np.where(fast, left | _FAST, (left << _SHIFT) | right)])
        self.uses = np.concatenate([self.uses, np.zeros(len(units), np.int64)])
        # Spelling: A's tokens of a group, then B's, each with the sign that follows it.
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        spelled = np.concatenate([np.where(a_last, self.a_spell[1][a], self.a_spell[0][a]), np.where(b_last, self.b_spell[1][b], self.b_spell[0][b])])[order].tolist()
        ends = np.cumsum(n_a + n_b).tolist()
        start, size = 0, len(self.groups)
        for i, (u, end) in enumerate(zip(units, ends, strict=True)):
            self.groups.append("".join(spelled[start:end]))
            self.table[u] = size + i
            start = end

    def shrink(self) -> None:
        """Of a full table keep what was used more than once; all goes if that is most of it."""
        if len(self.groups) <= TABLE_UNITS:
            return
        keep = self.uses > 1
        if keep.sum() > TABLE_UNITS // 2:
            self._reset()
            return
        links = self.counts[3]
        self.codes = self.codes[np.repeat(keep, links)]
        self.counts, self.uses = self.counts[:, keep], self.uses[keep] // 2
        names = np.fromiter(self.table, object, len(self.table))[keep].tolist()  # in order of their numbers
        self.groups = np.array(self.groups, object)[keep].tolist()
        self.table = {u: i for i, u in enumerate(names)}

    def aligned(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text the four counts (a row each) and the groups' digest; keys (text * 2**32 + pair) and their numbers."""
        units = [self.units(" " + t) if t else [] for t in texts]
        self._learn(units)
        ids = [list(map(self.table.__getitem__, u)) for u in units]
        good = self.counts[4]
        for i, own in enumerate(ids):
            if own and not good[own].all():
                # The bytes of the whole text decide; if they agree, the text is one unit.
                units[i] = [" " + texts[i]]
                self._learn([units[i]])
                good = self.counts[4]
                ids[i] = [self.table[units[i][0]]]
                if not good[ids[i][0]]:
                    ids[i] = []
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, sizes.sum())
        self.uses += np.bincount(flat, minlength=len(self.groups))
        text_of = np.repeat(np.arange(len(texts)), sizes)
        counts = np.array([np.bincount(text_of, self.counts[k][flat], len(texts)) for k in range(4)]).astype(np.int64).reshape(4, len(texts))
        digests = [hashlib.sha256("".join([self.groups[i] for i in own])[:-1].encode()).hexdigest() if own else "" for own in ids]
        links = self.counts[3]
        starts, n = (np.cumsum(links) - links)[flat], links[flat]
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys, times = np.unique((np.repeat(text_of, n) << 32) | self.codes[at], return_counts=True)
        self.shrink()
        return counts, digests, keys, times

    def _learn(self, units: list[list[str]]) -> None:
        new = list(set().union(*units).difference(self.table))
        for i in range(0, len(new), ADD_UNITS):
            self.add(new[i : i + ADD_UNITS])


def _lists(owner: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """Values sorted by owner as one list an owner."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


_ROWS = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, fast array<int>, fast_n array<int>, pairs array<int>, pairs_n array<int>"


def _aligned_rows(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    names = [x.split()[0] for x in _ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                n = part.num_rows
                counts, digests, keys, times = own.aligned(part.column("text").to_pylist())
                text, code = keys >> 32, keys & 0xFFFFFFFF
                fast = code >= _FAST
                lists = [x for on, value in ((fast, code - _FAST), (~fast, code)) for x in (_lists(text[on], n, value[on]), _lists(text[on], n, times[on]))]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), *map(pa.array, counts), pa.array(digests, pa.string()), *lists], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _ROWS)


def _fast_counts(rows: DataFrame, same: np.ndarray) -> DataFrame:
    """``(a, b, n)`` of the fast path: each task counts in a vector over A's vocabulary and gives what isn't zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(same), np.int64)
        for batch in batches:
            ids, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("fast", "fast_n"))
            total += np.bincount(ids, n, len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(same[some].astype(np.int32)), pa.array(total[some])], ["a", "b", "n"])

    return rows.select("fast", "fast_n").mapInArrow(run, "a int, b int, n long")


def pair_counts(rows: DataFrame, same: np.ndarray) -> DataFrame:
    """``(a, b, n, best, fast)``: links of each pair of ids over all texts, whether it is its B id's most frequent pair, and whether the fast path met it."""
    each = rows.select(F.inline(F.arrays_zip("pairs", "pairs_n"))).groupBy("pairs").agg(F.sum("pairs_n").alias("n"))
    irregular = each.select(F.shiftright("pairs", _SHIFT).alias("a"), F.col("pairs").bitwiseAND((1 << _SHIFT) - 1).alias("b"), "n", F.lit(0).alias("fast"))
    fast = _fast_counts(rows, same).select("*", F.lit(1).alias("fast"))
    total = irregular.unionByName(fast).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("fast").alias("fast"))
    # A window over one id of B sees at most A's vocabulary.
    return total.select("a", "b", "n", (F.col("n") == F.max("n").over(Window.partitionBy("b"))).alias("best"), (F.col("fast") == 1).alias("fast"))


def _irregular_sums(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``(row, n_best, count_sum)`` over each text's links outside the fast path."""
    slow = counts.select(F.shiftleft("a", _SHIFT).bitwiseOR(F.col("b")).alias("pairs"), "n", "best")
    # The least power of two that at most FREQUENT pairs reach.
    sizes = sorted(slow.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r["k"])
    above = np.cumsum([r["m"] for r in sizes]) if sizes else np.zeros(0)
    least = 1 << max([int(r["k"]) for r, m in zip(sizes, above, strict=True) if m > FREQUENT], default=-1) + 1
    each = rows.select("row", F.inline(F.arrays_zip("pairs", "pairs_n")))
    frequent, rare = F.broadcast(slow.where(F.col("n") >= least)), slow.where(F.col("n") < least)
    sums = (F.sum(F.when(F.col("best"), F.col("pairs_n")).otherwise(0)).alias("n_best"), F.sum(F.col("pairs_n") * F.col("n")).alias("count_sum"))
    met = each.join(frequent, "pairs").groupBy("row").agg(*sums)
    if least > 1:
        others = each.join(frequent.select("pairs"), "pairs", "left_anti").join(rare, "pairs").groupBy("row").agg(*sums)
        met = met.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return met


def _with_fast_sums(rows: DataFrame, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    """Add to each text what its groups of the fast path sum to, from vectors over A's vocabulary."""
    shared = rows.sparkSession.sparkContext.broadcast((counts, best))
    kept = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            ids, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fast", "fast_n"))
            of = np.repeat(np.arange(batch.num_rows), batch.column("fast").value_lengths().to_numpy(zero_copy_only=False))
            total, tops = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, of, n * counts[ids])
            np.add.at(tops, of, n * best[ids])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(tops), pa.array(total)], [*kept, "fast_best", "fast_sum"])

    return rows.select(*kept, "fast", "fast_n").mapInArrow(run, "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, fast_best long, fast_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per row of ``docs``.

    A encodes a blank and the text, B the text; strings of special tokens are plain text. Null and empty texts,
    and texts that either tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty digest.
    Repeated rows count each for itself. Other columns of ``docs``, whatever their names, are not looked at.
    """
    same = aligner(a_path, b_path).same
    rows = written(_aligned_rows(docs, a_path, b_path, id_col, text_col))
    counts = written(pair_counts(rows, same))
    n, best = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    for r in counts.where("fast").select("a", "n", "best").collect():  # at most one row for each id of A
        n[r.a], best[r.a] = r.n, r.best
    whole = _with_fast_sums(rows, n, best).join(_irregular_sums(rows, counts), "row", "left")
    found = written(
        whole.select(
            "id", "n_a", "n_b", "n_groups", "n_links", (F.col("fast_best") + F.coalesce("n_best", F.lit(0))).alias("n_best"),
            (F.col("fast_sum") + F.coalesce("count_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
        )
    )
    dropped(rows)
    dropped(counts)
    return found
