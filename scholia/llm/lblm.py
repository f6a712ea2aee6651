"""Scoring texts with a log-bilinear language model.

Tokens are words of the lower-cased text and one end. A word's class is given by its last two characters. The
vocabulary grows with the corpus: every word that occurs ``LEAST_COUNT`` times or more has vectors of its own, up
to the ``OWN`` most frequent ones; the rarer words of a class share one place, and a word's part of that place
comes from its corpus count. A log-bilinear model predicts from the ``CONTEXT`` tokens before first the class,
then the word within it. It is trained with noise-contrastive estimation and scored with batched matrix products;
both softmaxes are normalised, so the probabilities of all words, with one place per class for unseen ones, add
up to one.

Word and class counts cover every training text. What a worker holds is bounded by ``HEAD``. Rarer words meet
their counts in a shuffle join, and their shares are summed per text. The model is fitted on positions drawn by
hash from all training texts, all of them up to about ``EXAMPLES``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import one_blas_thread, text_slices
from scholia.plans.lineage import durable

#: The end token; no word holds a line feed.
END = "\n"
CONTEXT = 3
#: Classes: the most frequent endings, and so many for all others, dealt by hash.
ENDINGS, HASHED = 128, 31
#: Words whose counts every worker holds, words with vectors of their own, and how often those occur at least.
HEAD, OWN, LEAST_COUNT = 1 << 16, 1 << 13, 8
#: Positions fetched for the starting values, about; texts are drawn first, so many times as often.
EXAMPLES, WIDER = 800_000, 16
#: Positions of a step in a task, classes that they share as noise, and so many words for each block of a class's positions.
STEP, CLASS_NOISE, WORD_NOISE, BLOCK = 1 << 13, 64, 16, 32
#: Positions of a step, and blocks of them, that are handled at a time, so that what they need stays in a core's cache; no result hangs on these.
NEAR, NEAR_BLOCKS = 1 << 10, 64
#: Slices of the parameters that are summed apart, and tasks whose changes are summed at a time.
SLICES, TASKS = 16, 32
#: Distinct words that a task counts before it passes its counts on, or remembers.
FLUSH = 500_000
#: Tokens that are scored at a time, and scores that are held at a time, so that they stay in a core's cache.
CHUNK, SCORES = 1 << 17, 1 << 17
#: Scores above the negative of this, and sums of exponentials below that, need no shift: all are normal single-precision numbers.
SAFE, MOST = 60.0, 1e26


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All ``tokens`` of some texts, one after the other, as places among their distinct words; these; how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    sizes, words = pc.list_value_length(parts).to_numpy().astype(np.int64), parts.flatten()
    # A blank at either end of a text splits off an empty word.
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty], minlength=len(sizes))
        words = words.filter(pa.array(~empty))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, sizes


def with_ends(at: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """``at`` with ``end`` after each text's ``sizes`` tokens."""
    out = np.full(len(at) + len(sizes), end, at.dtype)
    out[np.arange(len(at)) + np.repeat(np.arange(len(sizes)), sizes)] = at
    return out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all tokens of ``docs``; the end counts once per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ends = [], 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                at, words, _ = split_words(part.column("text"))
                held.append((words, np.bincount(at, minlength=len(words))))
                ends += part.num_rows
                if sum(len(n) for _, n in held) > 2 * FLUSH:
                    held = [_summed(held)]
                    if len(held[0][1]) > FLUSH:
                        yield _counted(*held.pop())
        if held:
            yield _counted(*_summed(held))
        if ends:
            yield _counted(pa.array([END]), np.array([ends]))

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _summed(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Counts of words, each word once."""
    if len(held) == 1:
        return held[0]
    coded = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
    return coded.dictionary, np.bincount(coded.indices.to_numpy(), np.concatenate([n for _, n in held]), len(coded.dictionary))


def _counted(words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64))], ["word", "n"])


def most_frequent(counts: DataFrame, most: int | None = None) -> list[tuple[str, int]]:
    """The ``most`` words with the highest counts, most frequent first; of words that tie at the end those with the lowest hash, as far as their shares of the hash's range fit.

    How many words have a count, to three digits, is a short table, and so is how many of a step have which
    hash; both tell what to fetch, so what reaches the driver is bounded by ``most`` however many words there are.
    """
    most = HEAD if most is None else most
    step = F.pow(F.lit(10.0), F.greatest(F.length(F.col("n").cast("string")) - 3, F.lit(0))).cast("long")
    part = F.pmod(F.xxhash64("word"), F.lit(4096))
    keyed = counts.withColumn("low", F.col("n") - F.col("n") % step)
    total, wanted = 0, F.lit(False)
    for r in sorted(keyed.groupBy("low").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.low):
        if total + r.words <= most:
            total, wanted = total + r.words, F.col("low") >= r.low
            continue
        tied, end = keyed.where(F.col("low") == r.low), 0
        for p in sorted(tied.groupBy(part.alias("part")).agg(F.count("*").alias("words")).collect(), key=lambda p: p.part):
            if total + p.words > most:
                break
            total, end = total + p.words, p.part + 1
        wanted |= (F.col("low") == r.low) & (part < end)
        break
    return sorted(((r.word, r.n) for r in keyed.where(wanted).select("word", "n").collect()), key=lambda x: (-x[1], x[0]))


class Vocabulary:
    """Rows of the model: class by class its words and, last, the place of its rarer words; the end stands alone."""

    def __init__(self, head: list[tuple[str, int]], endings: list[str], totals: dict[int, tuple[int, int]], n_end: int):
        """``totals``: tokens and distinct words of each class in the corpus."""
        self.endings = {e: i for i, e in enumerate(endings)}
        self.first_hashed = len(endings)
        self.n_classes = len(endings) + HASHED + 1
        self.end_class = self.n_classes - 1
        own: list[list[tuple[str, int]]] = [[] for _ in range(self.n_classes)]
        for w, n in head[: OWN + 1]:
            if n >= LEAST_COUNT and w != END:
                own[self.class_of(w)].append((w, n))
        self.row, counts, self.cls, starts = {}, [], [], []
        self.rest_share = np.zeros(self.n_classes)
        for c, words in enumerate(own):
            starts.append(len(counts))
            for w, n in words:
                self.row[w.encode()] = len(counts)
                counts.append(n)
            n, v = totals.get(c, (0, 0))
            rest = n - sum(k for _, k in words), v - len(words)
            self.rest_share[c] = math.log10(rest[0] + rest[1] + 1)
            counts.append(n_end if c == self.end_class else rest[0])
            self.cls += [c] * (len(words) + 1)
        self.start = np.array([*starts, len(counts)])
        self.cls = np.array(self.cls)
        self.counts = np.array(counts, float)
        self.end, self.begin = len(counts) - 1, len(counts)
        self.is_rest = np.zeros(len(counts) + 1, bool)
        self.is_rest[self.start[1:] - 1] = True
        self.is_rest[self.end] = False
        self.met = dict(self.row)
        self.own = pa.array([w.decode() for w in self.row], pa.string())
        self.own_rows = np.array(list(self.row.values()), np.int32)

    def class_of(self, word: str) -> int:
        e = word[-2:]
        found = self.endings.get(e)
        return self.first_hashed + zlib.crc32(e.encode()) % HASHED if found is None else found

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Row of every word; words met are remembered up to a bound."""
        met = self.met
        try:
            return np.array([met[w] for w in words], np.int32)
        except KeyError:
            if len(met) > FLUSH:
                met = self.met = dict(self.row)
            for w in words:
                if w not in met:
                    met[w] = int(self.start[self.class_of(w.decode()) + 1]) - 1
            return np.array([met[w] for w in words], np.int32)

    def windows(self, words: list[bytes]) -> np.ndarray:
        """(context, word) rows of every token of a text, the end included."""
        padded = np.concatenate([np.full(CONTEXT, self.begin, np.int32), self.rows(words), np.array([self.end], np.int32)])
        return np.lib.stride_tricks.sliding_window_view(padded, CONTEXT + 1)

    def classes(self, words: pa.Array) -> np.ndarray:
        """``class_of`` every word; only distinct endings are looked up one by one."""
        coded = pc.utf8_slice_codeunits(words, -2, None).dictionary_encode()
        return np.array([self.class_of(e) for e in coded.dictionary.to_pylist()], np.int32)[coded.indices.to_numpy()]

    def distinct_rows(self, words: pa.Array) -> np.ndarray:
        """Row of every word of some distinct ones."""
        return _looked_up(words, self.own, self.own_rows, lambda other: (self.start[self.classes(other) + 1] - 1).astype(np.int32))

    def text_windows(self, texts: pa.Array) -> np.ndarray:
        """(context, word) rows of every token of some texts, one after the other; each text has its own beginning."""
        at, words, sizes = split_words(texts)
        target, sizes = with_ends(self.distinct_rows(words)[at], sizes, self.end), sizes + 1
        return self.spread(target, np.arange(len(target)) - np.repeat(np.cumsum(sizes) - sizes, sizes))

    def spread(self, target: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Each row of ``target`` after the rows before it in its text; ``place`` counts a text's tokens."""
        found = np.full((len(target), CONTEXT + 1), self.begin, np.int32)
        found[:, -1] = target
        for back in range(1, CONTEXT + 1):
            found[back:, -1 - back] = np.where(place[back:] >= back, target[:-back], self.begin)
        return found

    def windows_at(self, words: list[bytes], drawn: np.ndarray) -> np.ndarray:
        """The rows of ``windows`` at some places of a text; only their words are looked up."""
        if len(drawn) * (CONTEXT + 1) > len(words):
            return self.windows(words)[drawn]
        near = [range(max(0, t - CONTEXT), min(t + 1, len(words))) for t in drawn.tolist()]
        found = self.rows([words[i] for places in near for i in places])
        out, at = np.full((len(drawn), CONTEXT + 1), self.begin, np.int32), 0
        for own, t, places in zip(out, drawn.tolist(), near, strict=True):
            end = CONTEXT + places.stop - t
            own[end - len(places) : end] = found[at : at + len(places)]
            at += len(places)
        out[drawn == len(words), -1] = self.end
        return out


def _looked_up(words: pa.Array, known: pa.Array, numbers: np.ndarray, other) -> np.ndarray:
    """The number of each word of ``words`` that is ``known``; ``other`` gives those of all further words."""
    at = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
    new, out = at < 0, np.empty(len(at), np.int32)
    out[~new] = numbers[at[~new]]
    if new.any():
        out[new] = other(words.filter(pa.array(new)))
    return out


def vocabulary(counts: DataFrame, most: int | None = None) -> tuple[Vocabulary, list[tuple[str, int]], int]:
    """The vocabulary of ``(word, n)``, the most frequent words with their counts, and how often the end occurs."""
    spark = counts.sparkSession
    words = counts.where(F.col("word") != END).withColumn("ending", F.right("word", F.lit(2)))
    top = [r.ending for r in words.groupBy("ending").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()]
    known = F.broadcast(spark.createDataFrame([(e, i) for i, e in enumerate(top)], "ending string, cls int"))
    cls = F.coalesce(F.col("cls"), (F.crc32(F.col("ending").cast("binary")) % HASHED + len(top)).cast("int"))
    totals = words.join(known, "ending", "left").groupBy(cls.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    head, ends = most_frequent(counts, most), counts.where(F.col("word") == END).select("n").first()
    n_end = ends[0] if ends else 0
    return Vocabulary(head, top, {r.c: (r.n, r.v) for r in totals}, n_end), head, n_end


def examples(docs: DataFrame, known, rate: float, text_col: str = "text", id_col: str = "id") -> np.ndarray:
    """(context, word) rows at a share ``rate`` of all positions, chosen by a hash of id, text and place.

    ``known`` is the broadcast vocabulary. Texts are drawn before their positions, so that few of them are read.
    """
    wide = min(1.0, rate * WIDER)
    rate /= max(wide, 1e-300)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    if wide < 1:
        rows = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(wide * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = known.value
        for batch in batches:
            for part in text_slices(batch, "text"):
                got = []
                for text, h in zip(part.column("text").to_pylist(), part.column("h").to_pylist(), strict=True):
                    words = tokens(text)
                    x = (np.arange(len(words) + 1, dtype=np.uint64) + np.uint64(h % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
                    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                    drawn = np.flatnonzero((x >> np.uint64(11)).astype(float) < rate * 2.0**53)
                    got.append(vocab.windows_at(words, drawn))
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(got).astype("<i4").tobytes()], pa.binary())], ["at"])

    parts = rows.mapInArrow(run, "at binary").collect()
    return np.concatenate([np.frombuffer(r.at, "<i4") for r in parts] or [np.zeros(0, np.int32)]).reshape(-1, CONTEXT + 1)


#: The parameters of a model, in the order of its fields.
PARAMETERS = ("r", "mix", "u", "u_bias", "q", "q_bias")


@dataclass
class LogBilinear:
    """Scores (sum over i of r[context i] @ mix[i]) . u[class] + class bias, and the same with q of a word in its class."""

    r: np.ndarray
    mix: np.ndarray
    u: np.ndarray
    u_bias: np.ndarray
    q: np.ndarray
    q_bias: np.ndarray
    #: What AdaGrad has summed up for each row of these.
    seen: dict[str, np.ndarray] = field(default_factory=dict)

    def tables(self) -> np.ndarray:
        """What each token adds to the prediction at each place of the context; a last column adds up to one, for the biases."""
        own = np.einsum("vd,cde->cve", self.r, self.mix)
        ones = np.zeros((*own.shape[:2], 1))
        ones[0] = 1
        return np.concatenate([own, ones], axis=2).astype(np.float32)

    def log10(self, found: np.ndarray, vocab: Vocabulary, tables: np.ndarray) -> np.ndarray:
        """log10 probability of the last token of each row after those before it: of its class times within its class."""
        out, width = np.empty(len(found)), tables.shape[2]
        room, added = np.empty((min(CHUNK, len(found)), width), np.float32), np.empty((min(NEAR, len(found)), width), np.float32)
        for at in range(0, len(found), CHUNK):
            part = found[at : at + CHUNK]
            h = room[: len(part)]
            for a in range(0, len(part), NEAR):
                near, rows = h[a : a + NEAR], part[a : a + NEAR]
                tables[0].take(rows[:, 0], axis=0, out=near, mode="clip")
                for i in range(1, CONTEXT):
                    near += tables[i].take(rows[:, i], axis=0, out=added[: len(near)], mode="clip")
            word = part[:, -1]
            cls = vocab.cls[word]
            got = _log_softmax_at(h, self.u, self.u_bias, cls)
            order = _order(cls, vocab.n_classes)
            cuts = np.flatnonzero(np.diff(cls[order])) + 1
            for own in np.split(order, cuts):
                a, b = vocab.start[cls[own[0]]], vocab.start[cls[own[0]] + 1]
                if b - a > 1:
                    got[own] += _log_softmax_at(h.take(own, axis=0), self.q[a:b], self.q_bias[a:b], word[own] - a)
            out[at : at + len(part)] = got
        return out / math.log(10)


def _log_softmax_at(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row of ``h``, which ends in a one, the log of the softmax over ``vectors`` at one place.

    Scores are shifted by their maximum unless the sums of their exponentials, and those asked for, stay well inside the range of single precision.
    """
    out, step = np.empty(len(h)), max(1, SCORES // len(vectors))
    turned, ones = np.concatenate([vectors.T, bias[None]]).astype(np.float32), np.ones(len(vectors), np.float32)
    room = np.empty((min(step, len(h)), len(vectors)), np.float32)
    for i in range(0, len(h), step):
        near = h[i : i + step]
        s = np.matmul(near, turned, out=room[: len(near)])
        places = np.arange(len(s)) * len(vectors) + at[i : i + step]
        chosen = s.ravel().take(places)
        with np.errstate(over="ignore"):
            sums = np.exp(s, out=s) @ ones
        if not (sums.max() < MOST and chosen.min() > -SAFE):
            np.matmul(near, turned, out=s)
            s -= s.max(axis=1, keepdims=True)
            chosen = s.ravel().take(places)
            sums = np.exp(s, out=s) @ ones
        out[i : i + step] = chosen - np.log(sums)
    return out


def _order(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Stable order of row numbers; short ones are sorted by radix."""
    return np.argsort(rows.astype(np.uint16) if n_rows <= 1 << 16 else rows, kind="stable")


def _step(param: np.ndarray, seen: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """One step of AdaGrad, a rate per row, on the rows that occur; gradients of repeated rows are summed."""
    order = _order(rows, len(param))
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    _moved(param, seen, rows[starts], np.add.reduceat(grads[order], starts, axis=0), rate)


def _step_by_column(param: np.ndarray, seen: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """As ``_step`` for many rows, whose gradients lie column by column: each column is summed by row without sorting."""
    u, (at,) = _numbered(len(param), rows)
    _moved(param, seen, u, _sums_by_column(at, grads.astype(float, order="C"), len(u)).T.astype(param.dtype, order="C"), rate)


def _numbered(n_rows: int, *rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows that occur, and each of ``rows`` as places among them: their sums then stay in a core's nearest cache."""
    there = np.zeros(n_rows, bool)
    for r in rows:
        there[r] = True
    u, place = np.flatnonzero(there), np.empty(n_rows, np.intp)
    place[u] = np.arange(len(u))
    return u, [place[r] for r in rows]


def _sums_by_column(at: np.ndarray, columns: np.ndarray, n: int, out: np.ndarray | None = None) -> np.ndarray:
    """Each of ``columns`` summed by place; both have the types that counting takes, so that no column is converted."""
    out = np.empty((len(columns), n), np.float32) if out is None else out
    for column, into in zip(columns, out, strict=True):
        into[:] = np.bincount(at, column, n)
    return out


def _moved(param: np.ndarray, seen: np.ndarray, u: np.ndarray, g: np.ndarray, rate: float) -> None:
    """``g`` is used up."""
    flat = g.reshape(len(u), -1)
    now = seen[u] + np.einsum("vd,vd->v", flat, flat) / np.float32(flat.shape[1])
    seen[u] = now
    flat *= (rate / np.sqrt(now)).astype(flat.dtype)[:, None]
    param[u] = np.subtract(param.take(u, axis=0), g, out=g)


def _away(s: np.ndarray) -> np.ndarray:
    """Gradient of the noise-contrastive loss by its scores; the first column is the data's, the others are noise."""
    g = 0.5 * (np.tanh(0.5 * s) + 1)
    g[:, 0] -= 1
    return g


def train(found: np.ndarray, vocab: Vocabulary, dims: int = 24, batch: int = 2048, noise: int = 8, epochs: int = 2, least_steps: int = 200, rate: float = 0.08, seed: int = 9) -> LogBilinear:
    """Noise-contrastive estimation on (context, word) rows; noise comes from the corpus counts of classes and of words in a class."""
    one_blas_thread()
    rng = np.random.default_rng(seed)
    n_rows, n_classes = len(vocab.counts), vocab.n_classes
    g = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    weight = vocab.counts + 0.5
    cls_weight = np.add.reduceat(weight, vocab.start[:-1])
    cls_share, share = cls_weight / cls_weight.sum(), weight / cls_weight[vocab.cls]
    mix = np.repeat((np.eye(dims, dtype=np.float32) * 0.5)[None], CONTEXT, axis=0)
    net = LogBilinear(g(n_rows + 1, dims), mix, g(n_classes, dims), np.log(cls_share).astype(np.float32), g(n_rows, dims) * 0.3, np.log(share).astype(np.float32))
    net.seen = seen = {k: np.full(len(getattr(net, k)), 1e-3, np.float32) for k in PARAMETERS}
    if not len(found):
        net.u[:], net.q[:] = 0, 0
        return net
    cls_noise, word_noise = np.log(noise * cls_share).astype(np.float32), np.log(noise * share).astype(np.float32)
    cls_ends, ends = np.cumsum(cls_share), np.cumsum(weight)
    below = np.append(0.0, ends)
    steps = max(least_steps, epochs * len(found) // batch)
    for step in range(steps):
        pace = rate * min(1.0, 2 * (1 - step / steps))
        part = found[rng.integers(0, len(found), batch)]
        ctx, word = part[:, :-1], part[:, -1]
        cls = vocab.cls[word]
        each = net.r[ctx].reshape(batch, -1)
        h = each @ net.mix.reshape(-1, dims)
        c = np.concatenate([cls[:, None], np.minimum(np.searchsorted(cls_ends, rng.random((batch, noise))), n_classes - 1)], axis=1)
        a, b = vocab.start[cls], vocab.start[cls + 1]
        drawn = below[a][:, None] + rng.random((batch, noise)) * (below[b] - below[a])[:, None]
        w = np.concatenate([word[:, None], np.clip(np.searchsorted(ends, drawn), a[:, None], b[:, None] - 1)], axis=1)
        uc, qw = net.u[c], net.q[w]
        g_c = _away(np.einsum("bd,bkd->bk", h, uc) + net.u_bias[c] - cls_noise[c])
        g_w = _away(np.einsum("bd,bkd->bk", h, qw) + net.q_bias[w] - word_noise[w])
        g_w[b - a == 1] = 0
        g_h = np.einsum("bk,bkd->bd", g_c, uc) + np.einsum("bk,bkd->bd", g_w, qw)
        _step(net.u, seen["u"], c.ravel(), (g_c[:, :, None] * h[:, None, :]).reshape(-1, dims), pace)
        _step(net.u_bias, seen["u_bias"], c.ravel(), g_c.ravel(), pace)
        _step(net.q, seen["q"], w.ravel(), (g_w[:, :, None] * h[:, None, :]).reshape(-1, dims), pace)
        _step(net.q_bias, seen["q_bias"], w.ravel(), g_w.ravel(), pace)
        g_mix = (each.T @ g_h).reshape(net.mix.shape)
        _step(net.r, seen["r"], ctx.ravel(), (g_h @ net.mix.transpose(2, 0, 1).reshape(dims, -1)).reshape(-1, dims), pace)
        _step(net.mix, seen["mix"], np.arange(CONTEXT), g_mix, pace)
    return net


class Learner:
    """Noise-contrastive steps over the positions of one task; a step's positions share their noise.

    Noise has the distribution of ``train``, and more of it for each position.
    """

    def __init__(self, start: LogBilinear, vocab: Vocabulary, seed: int, rate: float = 0.03):
        one_blas_thread()
        self.net = LogBilinear(*(getattr(start, k).copy() for k in PARAMETERS), seen={k: v.copy() for k, v in start.seen.items()})
        self.times = {k: np.zeros(len(v), np.int64) for k, v in start.seen.items()}
        self.vocab, self.rate, self.rng = vocab, rate, np.random.default_rng(seed)
        self.rooms: dict[str, np.ndarray] = {}
        weight = vocab.counts + 0.5
        cls_weight = np.add.reduceat(weight, vocab.start[:-1])
        self.ends = np.cumsum(weight)
        self.below = np.append(0.0, self.ends)
        self.cls_ends = np.cumsum(cls_weight)
        self.cls_noise = np.log(CLASS_NOISE * cls_weight / cls_weight.sum()).astype(np.float32)
        self.word_noise = np.log(WORD_NOISE * weight / cls_weight[vocab.cls]).astype(np.float32)

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that keeps its memory from step to step; new pages cost more than the arithmetic in them."""
        size = math.prod(shape)
        if len(self.rooms.get(name, ())) < size:
            self.rooms[name] = np.empty(size + size // 4, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def learn(self, found: np.ndarray) -> None:
        # Whole rows are moved at once.
        found = np.ascontiguousarray(found, np.int32).view(f"V{4 * found.shape[1]}")[self.rng.permutation(len(found))].view(np.int32).reshape(found.shape)
        for at in range(0, len(found), STEP):
            self.step(found[at : at + STEP])

    def step(self, part: np.ndarray) -> None:
        net, vocab, rate = self.net, self.vocab, self.rate
        # In the order of words, which is that of classes too: rows of one word or class lie together.
        part = part[_order(part[:, -1], len(vocab.counts))]
        word = part[:, -1]
        cls = vocab.cls[word]
        n, dims = len(part), net.r.shape[1]
        # What each row that occurs adds at each place of the context, and the sum of these over a position's context.
        turned = net.mix.transpose(1, 0, 2).reshape(dims, -1)
        met, places = _numbered(len(net.r), *part[:, :-1].T)
        own_r = net.r.take(met, axis=0)
        adds = np.matmul(own_r, turned, out=self.room("adds", len(met), CONTEXT * dims)).reshape(len(met), CONTEXT, dims)
        h, own_h = self.room("h", n, dims), self.room("own_h", n, dims)
        adds[:, 0].take(places[0], axis=0, out=h, mode="clip")
        for i in range(1, CONTEXT):
            h += adds[:, i].take(places[i], axis=0, out=own_h, mode="clip")

        drawn = np.minimum(np.searchsorted(self.cls_ends, self.rng.random(CLASS_NOISE) * self.cls_ends[-1]), vocab.n_classes - 1)
        own_u = net.u.take(cls, axis=0, out=self.room("own_u", n, dims), mode="clip")
        own_c = _sigmoid(-np.einsum("bd,bd->b", h, own_u) - (net.u_bias - self.cls_noise)[cls]) - 1
        g_h, ones = self.room("g_h", n, dims), np.ones(max(NEAR, BLOCK), np.float32)
        some_u, turned_u, bias = net.u[drawn], np.ascontiguousarray(-net.u[drawn].T), self.cls_noise[drawn] - net.u_bias[drawn]
        g_u, g_ub = np.zeros((CLASS_NOISE, dims), np.float32), np.zeros(CLASS_NOISE, np.float32)
        for i in range(0, n, NEAR):
            near = h[i : i + NEAR]
            away = np.matmul(near, turned_u, out=self.room("away", len(near), CLASS_NOISE))
            away += bias
            _sigmoid(away)
            np.matmul(away, some_u, out=g_h[i : i + NEAR])
            g_u += away.T @ near
            g_ub += ones[: len(near)] @ away
        g_h += np.multiply(own_c[:, None], own_u, out=own_h)
        starts = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))

        qw = net.q.take(word, axis=0, out=self.room("qw", n, dims), mode="clip")
        own = _sigmoid(-np.einsum("bd,bd->b", h, qw) - (net.q_bias - self.word_noise)[word]) - 1
        alone = (vocab.start[cls + 1] - vocab.start[cls]) == 1
        own[alone] = 0
        g_h += np.multiply(own[:, None], qw, out=own_h)
        at = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        g_q, g_qb, q_rows = [np.add.reduceat(np.multiply(own[:, None], h, out=own_h), at, axis=0)], [np.add.reduceat(own, at)], [word[at]]
        # Blocks of positions of one class share words drawn from it; places past the end of a class count nothing.
        sizes = np.diff(np.append(starts, n))
        blocks = -(-sizes // BLOCK)
        of_class = np.cumsum(blocks) - blocks
        place = np.arange(blocks.sum()) - np.repeat(of_class, blocks)
        first = np.repeat(starts, blocks) + place * BLOCK
        last, c = np.repeat(starts + sizes, blocks), np.repeat(cls[starts], blocks)
        spots = first[:, None] + np.arange(BLOCK)
        inside = spots < last[:, None]
        there = inside & (vocab.start[c + 1] - vocab.start[c] > 1)[:, None]
        spots = np.minimum(spots, n - 1)
        low, high = vocab.start[c], vocab.start[c + 1]
        w = self.below[low][:, None] + self.rng.random((len(c), WORD_NOISE)) * (self.below[high] - self.below[low])[:, None]
        w = np.clip(np.searchsorted(self.ends, w), low[:, None], high[:, None] - 1)
        word_bias = (self.word_noise - net.q_bias)[w]
        own_blocks, noise_g, noise_gb = np.empty((len(c), dims), np.float32), np.empty((*w.shape, dims), np.float32), np.empty(w.shape, np.float32)
        for i in range(0, len(c), NEAR_BLOCKS):
            some, spot = slice(i, i + NEAR_BLOCKS), spots[i : i + NEAR_BLOCKS]
            q = net.q.take(w[some], axis=0, out=self.room("q", len(spot), WORD_NOISE, dims), mode="clip")
            part_h = h.take(spot, axis=0, out=self.room("part_h", *spot.shape, dims), mode="clip")
            away = np.matmul(part_h, q.transpose(0, 2, 1), out=self.room("word_away", *spot.shape, WORD_NOISE))
            np.subtract(word_bias[some][:, None, :], away, out=away)
            _sigmoid(away)
            away *= there[some][:, :, None]
            # The places inside, block by block, are all positions in their order.
            word_g = np.matmul(away, q, out=self.room("word_g", *spot.shape, dims)).reshape(-1, dims)
            taken = np.flatnonzero(inside[some])
            g_h[first[i] : first[i] + len(taken)] += word_g.take(taken, axis=0)
            np.matmul(away.transpose(0, 2, 1), part_h, out=noise_g[some])
            np.matmul(ones[:BLOCK], away, out=noise_gb[some])
            # Those of the classes themselves, by block and then by class.
            np.matmul((own_c[spot] * inside[some])[:, None, :], part_h, out=own_blocks[some][:, None, :])
        g_q.append(noise_g.reshape(-1, dims))
        g_qb.append(noise_gb.ravel())
        q_rows.append(w.ravel())
        g_u = [np.add.reduceat(own_blocks, of_class, axis=0), g_u]
        g_ub, u_rows = [np.add.reduceat(own_c, starts), g_ub], np.concatenate([cls[starts], drawn])
        # Gradients are summed by row of the context first, at each place of it, and only these sums are multiplied.
        columns, sums = g_h.T.astype(float, order="C"), self.room("sums", CONTEXT, dims, len(met))
        for i in range(CONTEXT):
            _sums_by_column(places[i], columns, len(met), sums[i])
        g_mix = np.matmul(sums, own_r).transpose(0, 2, 1)
        g_r = sums.reshape(-1, len(met)).T @ net.mix.transpose(0, 2, 1).reshape(-1, dims)

        self.times["u"] += np.bincount(cls, minlength=len(self.times["u"]))
        self.times["q"] += np.bincount(word, minlength=len(self.times["q"]))
        for p in places:
            self.times["r"][met] += np.bincount(p, minlength=len(met))
        self.times["mix"] += n
        q_rows = np.concatenate(q_rows)
        _step(net.u, net.seen["u"], u_rows, np.concatenate(g_u), rate)
        _step(net.u_bias, net.seen["u_bias"], u_rows, np.concatenate(g_ub), rate)
        _step_by_column(net.q, net.seen["q"], q_rows, np.concatenate(g_q).T, rate)
        _step(net.q_bias, net.seen["q_bias"], q_rows, np.concatenate(g_qb), rate)
        _moved(net.r, net.seen["r"], met, g_r, rate)
        _step(net.mix, net.seen["mix"], np.arange(CONTEXT), np.ascontiguousarray(g_mix), rate)

    def changes(self, start: LogBilinear) -> np.ndarray:
        """Per row how often it occurred and so many times its change, all parameters one after the other."""
        out = []
        for k in PARAMETERS:
            now, was = getattr(self.net, k), getattr(start, k)
            # A bias occurs as its vector does. Rows met only as noise have moved too.
            n = np.maximum(self.times[k.removesuffix("_bias")], 1e-3).reshape(-1, *[1] * (now.ndim - 1))
            out += [n.ravel(), ((now - was).astype(float) * n).ravel()]
        return np.concatenate(out)


def _sigmoid(s: np.ndarray) -> np.ndarray:
    """Of the negated ``s``, in place; far above zero the exponential is infinite and the result zero."""
    with np.errstate(over="ignore"):
        np.exp(s, out=s)
    s += np.float32(1)
    return np.reciprocal(s, out=s)


def learn_all(docs: DataFrame, known, model: LogBilinear, text_col: str = "text") -> int:
    """Let ``model`` learn from every position of ``docs``, in place; the number of positions.

    ``known`` is the broadcast vocabulary. The tasks' changes are summed in slices and in two levels, so neither a
    group nor the driver gets more than a bounded share of them.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, task, learner = known.value, TaskContext.get().partitionId(), None
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                learner = learner or Learner(given.value, vocab, task)
                learner.learn(vocab.text_windows(part.column("text")))
        if learner:
            parts = np.array_split(learner.changes(given.value).astype("<f4"), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([task // TASKS] * SLICES, pa.int32()), pa.array([int(learner.times["mix"][0])] * SLICES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "tasks", "n", "sums"])

    def summed(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, "<f4").astype(float) for b in group.column("sums").to_pylist())
        return pa.table({"slice": group.column("slice")[:1], "tasks": group.column("tasks")[:1], "n": pa.array([pc.sum(group.column("n")).as_py()], pa.int64()), "sums": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    kind = "slice int, tasks int, n long, sums binary"
    sums = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)
    found = sums.groupBy("slice", "tasks").applyInArrow(summed, kind).groupBy("slice").applyInArrow(summed, kind).collect()
    given.unpersist()
    if not found:
        return 0
    every, at = np.concatenate([np.frombuffer(r.sums, "<f4") for r in sorted(found, key=lambda r: r.slice)]), 0
    for k in PARAMETERS:
        p = getattr(model, k)
        n, at = every[at : at + len(p)], at + len(p)
        change, at = every[at : at + p.size], at + p.size
        p += change.reshape(p.shape) / n.reshape(-1, *[1] * (p.ndim - 1))
    return found[0].n


def score(docs: DataFrame, training: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, training, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Rows where ``training`` is true are learned from. ``base_score`` is the sum over tokens of
    log10((c + 1) / (N + V + 1)) by counts among training tokens, ``score`` the model's log10 probability.
    A null text is empty: its only token is the end. Repeated rows are scored, and counted, one by one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), training.alias("training"))
    learned = rows.where("training")
    counts = durable(word_counts(learned))
    vocab, head, n_end = vocabulary(counts)
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = spark.sparkContext.broadcast(vocab)
    model = train(examples(learned, known, min(1.0, EXAMPLES / max(1, n_all))), vocab)
    learn_all(learned, known, model)
    held = pa.array([w for w, _ in head], pa.string()), np.array([n for _, n in head], np.int64)
    fitted = spark.sparkContext.broadcast((*held, n_end, n_all, v_all, model))

    rows = rows.withColumn("row", F.monotonically_increasing_id())
    schema = "row long, word string, times long, id long, training boolean, n_tokens long, n_known long, base_score double, score double"
    parts = rows.mapInArrow(lambda batches: _score(batches, known.value, *fitted.value), schema)
    seen = counts.withColumnRenamed("n", "c")
    share = F.when(F.col("c").isNotNull(), F.col("times") * F.log10(F.col("c") + 1.0)).otherwise(0.0)
    # A text's own row holds its results, its other rows nulls: the maximum is that row's.
    own = ("id", "training", "n_tokens", "n_known", "base_score", "score")
    total = parts.join(seen, "word", "left").groupBy("row").agg(
        *(F.max(c).alias(c) for c in own), F.sum(share).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known")
    )
    return total.select(
        "id", "training", "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("rare")).alias("base_score"), (F.col("score") + F.col("rare")).alias("score"),
    )


def _score(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, head: pa.Array, head_counts: np.ndarray, n_end: int, n_all: int, v_all: int, model: LogBilinear) -> Iterator[pa.RecordBatch]:
    """For each text what the head words and the model give, in a row of its own, and a row for each rarer word.

    One look-up of a slice's distinct words gives their codes: the place among the head words, or else the class beyond them; the end comes last.
    """
    one_blas_thread()
    tables = model.tables()
    rare, end = len(head), len(head) + vocab.n_classes
    places = np.arange(rare, dtype=np.int32)
    # The log count of a rarer word is added by the join.
    log_count = np.log10(np.concatenate([head_counts, np.zeros(vocab.n_classes), [n_end]]) + 1)
    row_of = np.concatenate([vocab.distinct_rows(head), vocab.start[1:] - 1, [vocab.end]]).astype(np.int32)
    whole = math.log10(n_all + v_all + 1)
    for batch in batches:
        for part in text_slices(batch, "text", 2 << 20):
            at, words, sizes = split_words(part.column("text"))
            at, sizes = with_ends(at, sizes, len(words)), sizes + 1
            code = np.append(_looked_up(words, head, places, lambda w: rare + vocab.classes(w)), np.int32(end))[at]
            starts = np.cumsum(sizes) - sizes
            # Each text has its own beginning before its first word.
            target, place = row_of[code], np.arange(len(code)) - np.repeat(starts, sizes)
            lm = model.log10(vocab.spread(target, place), vocab, tables)
            logs = log_count[code]
            # A rarer word's part of its class's common place.
            shared = vocab.is_rest[target]
            lm[shared] += logs[shared] - vocab.rest_share[vocab.cls[target[shared]]]
            far = (code >= rare) & (code < end)
            n_far = np.add.reduceat(far, starts, dtype=np.int64)
            base, score = np.add.reduceat(logs, starts) - sizes * whole, np.add.reduceat(lm, starts)
            n_known = sizes - n_far - (n_end <= 0)
            # A rarer word of a text is one row, however often the text has it.
            text = np.repeat(np.arange(len(sizes)), sizes)[far]
            tails, times = np.unique(text * len(words) + at[far], return_counts=True)
            numbers, whose = part.column("row"), pa.array(tails // max(1, len(words)))
            # No word holds a blank, so a text's own row meets no count; being its own key it is dealt evenly.
            rows = pa.concat_arrays([numbers, numbers.take(whose)])
            keys = pa.concat_arrays([pa.array([" %d" % row for row in numbers.to_pylist()], pa.string()), words.take(pa.array(tails % max(1, len(words))))])
            nulls = lambda a: pa.concat_arrays([a, pa.nulls(len(rows) - len(a), a.type)])
            own = [part.column("id"), part.column("training"), *map(pa.array, (sizes, n_known, base, score))]
            yield pa.RecordBatch.from_arrays(
                [rows, keys, pa.array(np.concatenate([np.zeros(len(sizes), np.int64), times])), *map(nulls, own)],
                ["row", "word", "times", "id", "training", "n_tokens", "n_known", "base_score", "score"],
            )
