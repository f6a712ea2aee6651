"""Language identification by a convolutional network over bytes, trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its largest
response in the window, and a softmax over the learned languages follows. A text's probabilities are the
means over all its windows, weighted by their bytes, so whole texts count whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import one_blas_thread, text_slices, text_slices_at

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
#: Windows overlap by what the widest filter needs, so that it sees every place of a text.
STRIDE = WINDOW - max(WIDTHS) + 1
#: A letter other than a digit or underscore.
_LETTER = re.compile(r"[^\W\d_]")
#: About this many distinct windows per language, from any place of any text, are fetched for fitting.
SAMPLE_WINDOWS = 1200
_CHUNK = 64


@dataclass
class ByteConvNet:
    labels: list[str]
    embed: np.ndarray  # 256 x d; byte 0 is padding
    filters: np.ndarray  # (widest * d) x all filters; narrow filters end in zero rows
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d, widest = self.embed.shape[1], max(WIDTHS)
        x = self.embed[windows].reshape(len(windows), -1)
        spans = np.lib.stride_tricks.sliding_window_view(x, widest * d, axis=1)[:, ::d]
        made = spans.reshape(-1, widest * d) @ self.filters
        made = made.reshape(len(windows), -1, self.filters.shape[1])
        return made, spans, made.max(axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        one_blas_thread()
        parts = []
        for at in range(0, len(windows), _CHUNK):
            top = np.maximum(self.pooled(windows[at : at + _CHUNK])[2] + self.bias, 0)
            parts.append(softmax(top @ self.out + self.out_bias))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.labels)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and score (mean probability of the label, 0 to 1) of each whole text."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        labels, scores = [UNKNOWN] * len(raw), np.zeros(len(raw))
        if not self.labels:
            return labels, scores
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not known:
            return labels, scores
        windows, owner, weight = cut([raw[i] for i in known])
        total = np.zeros((len(known), len(self.labels)))
        np.add.at(total, owner, self.probabilities(windows) * weight[:, None])
        total /= total.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        for i, k, row in zip(known, best, total, strict=True):
            labels[i], scores[i] = self.labels[k], min(1.0, row[k])
        return labels, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def cut(raw: list[bytes], window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts in rows, the text that each comes from, and the number of bytes that it adds to the ones before."""
    lengths = np.array([len(b) for b in raw], np.int64)
    counts = 1 + np.maximum(0, -(-(lengths - window) // stride))
    ends = np.cumsum((counts - 1) * stride + window)
    flat = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    starts = ends - ((counts - 1) * stride + window)
    for b, at in zip(raw, starts.tolist(), strict=True):
        flat[at : at + len(b)] = np.frombuffer(b, np.uint8)
    owner = np.repeat(np.arange(len(raw)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[owner] + nth * stride
    new = np.where(nth == 0, np.minimum(lengths[owner], window), np.minimum(lengths[owner] - nth * stride, window) - (window - stride))
    return np.lib.stride_tricks.sliding_window_view(flat, window)[first] if len(first) else flat.reshape(0, window), owner, np.maximum(new, 1).astype(np.float32)


def train(windows: list[bytes], langs: list[str], seed: int = 7, dims: int = 6, per_width: int = 12, epochs: int = 8, rate: float = 0.01) -> ByteConvNet:
    """Fit the network with Adam on labelled windows, each of at most ``WINDOW`` bytes."""
    one_blas_thread()
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    widest, n_filters = max(WIDTHS), per_width * len(WIDTHS)
    mask = np.zeros((widest * dims, n_filters), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * dims, i * per_width : (i + 1) * per_width] = 1
    net = ByteConvNet(
        labels,
        rng.normal(0, 0.5, (256, dims)).astype(np.float32),
        (rng.normal(0, 0.3, (widest * dims, n_filters)) * mask).astype(np.float32),
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.1, (n_filters, len(labels))).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    net.embed[0] = 0
    if len(labels) < 1:
        return net
    x, y = cut(windows)[0], np.array([labels.index(k) for k in langs])
    # Rare languages weigh as much as common ones.
    weight = (len(y) / (len(labels) * np.bincount(y, minlength=len(labels))))[y].astype(np.float32)
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            pick = order[at : at + 64]
            step += 1
            grads = _gradients(net, x[pick], y[pick], weight[pick], mask)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.embed[0] = 0
    return net


def _gradients(net: ByteConvNet, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    n, d = len(x), net.embed.shape[1]
    made, spans, top = net.pooled(x)
    at = made.argmax(axis=1)
    act = np.maximum(top + net.bias, 0)
    g = softmax(act @ net.out + net.out_bias)
    g[np.arange(n), y] -= 1
    g *= weight[:, None] / n
    g_act = (g @ net.out.T) * (act > 0)
    picked = spans[np.arange(n)[:, None], at]  # n x filters x (widest * d)
    g_filters = np.einsum("nfk,nf->kf", picked, g_act) * mask
    g_spans = g_act[:, :, None] * net.filters.T[None]  # n x filters x (widest * d)
    places = at[:, :, None] + np.arange(max(WIDTHS))
    g_embed = np.zeros_like(net.embed)
    np.add.at(g_embed, x[np.arange(n)[:, None, None], places].ravel(), g_spans.reshape(-1, d))
    return [g_embed, g_filters, g_act.sum(axis=0), act.T @ g, g.sum(axis=0)]


def fold(id_col: str = "doc_id", parts: int = 4) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def gibberish(windows: list[bytes], n: int, seed: int = 11) -> list[bytes]:
    """``n`` windows that are no language: drawn windows whose letters change places, or are drawn anew from all letters seen."""
    rng = np.random.default_rng(seed)
    seen = sorted({c for w in windows for c in _LETTER.findall(w.decode("utf-8", "ignore"))})
    made = []
    for i in range(n if seen else 0):
        text = windows[int(rng.integers(len(windows)))].decode("utf-8", "ignore")
        letters = _LETTER.findall(text)
        letters = [letters[k] for k in rng.permutation(len(letters))] if i % 2 else [seen[k] for k in rng.integers(0, len(seen), len(letters))]
        left = iter(letters)
        made.append(_LETTER.sub(lambda _, left=left: next(left), text).encode("utf-8")[:WINDOW])
    return made


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text", sample: int = SAMPLE_WINDOWS, reject: bool = False) -> ByteConvNet:
    """Fit on about ``sample`` distinct windows of each label, from anywhere in the texts; null labels and texts don't count.

    A window is chosen by a hash of its text's hash and its place, at a rate from the number of windows of the label in
    all rows; windows of copies are fetched once, so copies can't swell the sample. Each label has one window at least.
    With ``reject`` the network also learns ``und`` from ``sample`` windows of gibberish made of those fetched.
    """
    rows = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    n = F.greatest(F.lit(1), F.ceil((F.octet_length("text") - WINDOW) / STRIDE) + 1)
    rows = rows.where("label is not null and text is not null and text <> ''").select("label", F.col("text").cast("binary").alias("raw"), n.cast("int").alias("n"), F.xxhash64("text").alias("h"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return train([], [])
    rate = F.coalesce(*[F.when(F.col("label") == k, F.lit(min(1.0, sample / n))) for k, n in sorted(counts.items())])
    chance = lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 30)) / float(1 << 30)
    places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: chance(i) < rate)
    window = lambda i: F.substring("raw", i * STRIDE + 1, F.lit(WINDOW))
    chosen = rows.select("label", F.explode(F.transform(places, window)).alias("window")).distinct()
    one = rows.groupBy("label").agg(F.min_by(window(F.lit(0)), "h").alias("window"))
    got = sorted((r["label"], bytes(r["window"])) for r in chosen.unionByName(one).distinct().collect())
    if reject:
        got += [(UNKNOWN, w) for w in gibberish([w for _, w in got], sample)]
    return train([w for _, w in got], [k for k, _ in got])


def predict(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every row; ``und`` with score 0 for null texts and texts without a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                labels, scores = net.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(labels, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double")


def stays(label: str, score: float, n_bytes: int, least: float, gibberish: float) -> bool:
    """Whether a text passes; ``und`` with a score above 0 comes from a network that was fitted to reject.

    A text shorter than a window is too little to be called gibberish and stays.
    """
    if label != UNKNOWN:
        return score >= least
    return score > 0 and (score < gibberish or n_bytes < WINDOW)


def keep_identified(docs: DataFrame, net: ByteConvNet, text_col: str = "text", least: float = 0.5, gibberish: float = 0.95) -> DataFrame:
    """Rows of ``docs`` that pass; columns stay.

    A whole text's language needs a score of ``least``; ``und`` goes from a score of ``gibberish``, if the text fills a
    window; null texts and texts without a letter go.
    """
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices_at(batch, at, 2 << 20):
                texts = part.column(at)
                labels, scores = net.predict(texts.to_pylist())
                sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
                good = [stays(k, s, n, least, gibberish) for k, s, n in zip(labels, scores, sizes, strict=True)]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, schema)


def crc_fold(doc_id: int | None, parts: int = 4) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts
