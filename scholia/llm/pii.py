"""Personal data by patterns and by a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans exactly. The network, trained in numpy on generated labelled text, adds spans
that the patterns miss (such as phone numbers without a country code). It reads windows of ``WINDOW`` characters
that overlap by half; each is decoded by Viterbi, every character's tag is taken from the window where it
lies most centrally, and the tags are then read as one sequence over the whole text.

Windows that cannot change the result are left out. A run of tags becomes a span only if, without signs at its
ends, it holds an at sign and no blank (email), or a digit and nothing but the signs of numbers (the others). Such
a run lies within a *reach*: the unbroken stretch of such characters around an at sign or a digit, and the signs
on either side up to the next letter or digit. Tags of every reach and of the letters that end it are computed.
A run that goes beyond a reach holds such a letter as well as the character that broke the stretch, so it is
no span, wherever the computed tags stop. Spans are thus the same as with all windows (``everything``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import one_blas_thread, text_slices, text_slices_at

#: The kinds, in order.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: Started only where a run of digits starts: a later start in the run can't match if the first doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

WINDOW, STRIDE = 96, 48
_TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
_CHARS = 98  # padding, printable ASCII, blank, other


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns: leftmost, non-overlapping within a kind, failing matches dropped; by kind, then start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in _parts(m[0]))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def _parts(ip: str) -> list[str]:
    return [p if len(p) < 9 else p.lstrip("0")[:9] or "0" for p in ip.split(".")]


# --- network -------------------------------------------------------------------------------------------


def char_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    ids = np.where((points >= 32) & (points < 127), points - 31, 97)
    return np.where((points >= 9) & (points <= 13), 96, ids).astype(np.uint8)


_AT = ord("@") - 31
_DIGIT = np.zeros(_CHARS, bool)
_DIGIT[ord("0") - 31 : ord("9") - 30] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) - 31 for c in "+() .-/"]] = True


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a blank, and whether it is a letter or digit, as ``str`` says."""
    all_ = [chr(c) for c in range(0x110000)]
    return np.fromiter(map(str.isspace, all_), bool, len(all_)), np.fromiter(map(str.isalnum, all_), bool, len(all_))


def reaches(text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the reach of each at sign and digit, with the letters that end it; some coincide."""
    starts, ends = [], []
    at, digit = np.flatnonzero(ids == _AT), np.flatnonzero(_DIGIT[ids])
    if len(at) or len(digit):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        blank, alnum = _classes()
        solid = np.flatnonzero(alnum[points])
        for places, breaks in ((at, blank[points] if len(at) else None), (digit, ~_NUMERIC[ids] if len(digit) else None)):
            if len(places):
                stops = np.append(np.flatnonzero(breaks), len(ids))
                after = np.searchsorted(stops, places)
                before = np.where(after > 0, stops[after - 1], -1)
                pairs = np.unique(np.stack([before, stops[after]]), axis=1)
                left, right = np.searchsorted(solid, pairs[0], "right"), np.searchsorted(solid, pairs[1])
                edged = np.concatenate([[0], solid, [len(ids) - 1]])
                starts.append(edged[left])
                ends.append(edged[right + 1])
    return (np.concatenate(starts), np.concatenate(ends)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Embedding, one LSTM per direction, a linear layer to tag scores and CRF transitions."""

    def __init__(self, seed: int = 3, dims: int = 8, hidden: int = 14):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"E": rng.normal(0, 0.5, (_CHARS, dims)).astype(np.float32), "O": g(2 * hidden, _TAGS), "b": np.zeros(_TAGS, np.float32), "T": np.zeros((_TAGS, _TAGS), np.float32)}
        for d in "fr":
            self.p |= {f"W{d}": g(dims, 4 * hidden), f"U{d}": g(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States of one direction over time-major input; with ``keep`` also what the backward pass needs."""
        n, h = x.shape[1], self.hidden
        pre = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        states, kept = np.empty((len(x), n, h), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = pre[t] + s @ self.p[f"U{d}"]
            gates = _sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            c_new = gates[:, h : 2 * h] * c + gates[:, :h] * g
            tc = np.tanh(c_new)
            if keep:
                kept.append((t, s, c, gates, g, tc))
            s, c = gates[:, 2 * h :] * tc, c_new
            states[t] = s
        return states, kept

    def scores(self, ids: np.ndarray, keep: bool = False):
        """Tag scores, time-major, of windows of character ids."""
        x = self.p["E"][ids.T]
        runs = [self._run(x, d, keep) for d in "fr"]
        both = np.concatenate([runs[0][0], runs[1][0]], axis=2)
        return both @ self.p["O"] + self.p["b"], (x, both, runs)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the CRF and its gradients."""
        em, (x, both, runs) = self.scores(ids, keep=True)
        steps, n, _ = em.shape
        trans, y = self.p["T"], tags.T
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0]
        for t in range(1, steps):
            alpha[t] = em[t] + _lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _lse(trans + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = _lse(alpha[-1], 1)
        g_em = np.exp(alpha + beta - log_z[:, None])
        pair = np.exp(alpha[:-1][:, :, :, None] + trans + (em[1:] + beta[1:])[:, :, None, :] - log_z[:, None, None])
        g_trans = pair.sum(axis=(0, 1))
        own = np.take_along_axis(em, y[:, :, None], 2).sum() + trans[y[:-1], y[1:]].sum()
        np.add.at(g_trans, (y[:-1].ravel(), y[1:].ravel()), -1)
        np.put_along_axis(g_em, y[:, :, None], np.take_along_axis(g_em, y[:, :, None], 2) - 1, 2)
        g_em /= n
        flat = both.reshape(-1, both.shape[2])
        grads = {"T": g_trans / n, "O": flat.T @ g_em.reshape(-1, _TAGS), "b": g_em.sum(axis=(0, 1))}
        g_both, h, g_x = g_em @ self.p["O"].T, self.hidden, np.zeros_like(x)
        for k, d in enumerate("fr"):
            g_s, g_c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            g_z_all, prev = np.empty((steps, n, 4 * h), np.float32), np.empty((steps, n, h), np.float32)
            for t, s, c, gates, g, tc in reversed(runs[k][1]):
                g_s = g_s + g_both[t][:, k * h : (k + 1) * h]
                g_c = g_c + g_s * gates[:, 2 * h :] * (1 - tc * tc)
                g_gates = np.concatenate([g_c * g, g_c * c, g_s * tc], axis=1) * gates * (1 - gates)
                g_z = np.concatenate([g_gates, g_c * gates[:, :h] * (1 - g * g)], axis=1)
                g_z_all[t], prev[t] = g_z, s
                g_c = g_c * gates[:, h : 2 * h]
                g_s = g_z @ self.p[f"U{d}"].T
            z = g_z_all.reshape(-1, 4 * h)
            grads |= {f"W{d}": x.reshape(-1, x.shape[2]).T @ z, f"U{d}": prev.reshape(-1, h).T @ z, f"c{d}": z.sum(axis=0)}
            g_x += g_z_all @ self.p[f"W{d}"].T
        g_e = np.zeros_like(self.p["E"])
        np.add.at(g_e, ids.T.ravel(), g_x.reshape(-1, g_x.shape[2]))
        return float((log_z.sum() - own) / n), grads | {"E": g_e}

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int = 48, rate: float = 0.015, seed: int = 5) -> Tagger:
        one_blas_thread()
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(ids), batch)
            _, grads = self.gradients(ids[pick], tags[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            pace = rate * min(1, 3 * (1 - step / (steps + 1)))
            for k, p in self.p.items():
                g = grads[k] * min(1, 5 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                p -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, ids: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Best tags of each window under the transitions; an inside tag only follows its own kind."""
        one_blas_thread()
        trans = self.p["T"].copy()
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            wrong = np.ones(_TAGS, bool)
            wrong[[inside - 1, inside]] = False
            trans[wrong, inside] = -1e4
        out = np.zeros(ids.shape, np.int8)
        for at in range(0, len(ids), chunk):
            em, _ = self.scores(ids[at : at + chunk])
            best, back = em[0], []
            for t in range(1, len(em)):
                all_ = best[:, :, None] + trans
                back.append(all_.argmax(axis=1))
                best = em[t] + all_.max(axis=1)
            tag = best.argmax(axis=1)
            rows = np.arange(len(tag))
            out[at : at + chunk, -1] = tag
            for t in range(len(em) - 2, -1, -1):
                tag = back[t][rows, tag]
                out[at : at + chunk, t] = tag
        return out

    def tags(self, texts: list[str], everything: bool = False) -> list[np.ndarray | None]:
        """Tags reconciled over the windows of whole texts: of all reaches, or of ``everything``; None where none is computed."""
        found: list[np.ndarray | None] = [None] * len(texts)
        windows, places, q = [], [], STRIDE // 2
        for i, text in enumerate(texts):
            ids = char_ids(text)
            n_blocks = max(2, -(-len(ids) // STRIDE))
            if everything:
                active = np.arange(n_blocks - 1)
            else:
                starts, ends = reaches(text, ids)
                edges = np.zeros(n_blocks, np.int64)
                np.add.at(edges, np.clip((starts - q) // STRIDE, 0, n_blocks - 2), 1)
                np.add.at(edges, np.clip((ends - q) // STRIDE, 0, n_blocks - 2) + 1, -1)
                active = np.flatnonzero(np.cumsum(edges))
            if not len(active):
                continue
            padded = np.zeros(n_blocks * STRIDE, np.uint8)
            padded[: len(ids)] = ids
            windows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[active * STRIDE])
            places.append((i, active, n_blocks, len(ids)))
        if not windows:
            return found
        decoded, at = self.decode(np.concatenate(windows)), 0
        for i, active, n_blocks, n in places:
            tags = np.zeros(n_blocks * STRIDE, np.int8)
            for w, got in zip(active * STRIDE, decoded[at : at + len(active)], strict=True):
                lo = 0 if w == 0 else q
                hi = WINDOW if w == (n_blocks - 2) * STRIDE else WINDOW - q
                tags[w + lo : w + hi] = got[lo:hi]
            at += len(active)
            found[i] = tags[:n]
        return found

    def spans(self, texts: list[str], everything: bool = False) -> list[list[tuple[str, int, int]]]:
        """Spans read from the tags, kept if they hold what their kind needs at least."""
        out = []
        for text, tags in zip(texts, self.tags(texts, everything), strict=True):
            own = []
            if tags is not None and tags.any():
                kind = np.where(tags > 0, (tags + 1) // 2, 0)
                new = np.append(True, (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1))
                starts = np.flatnonzero(new)
                for a, b in zip(starts, np.append(starts[1:], len(tags)), strict=True):
                    if kind[a] and (span := _plausible(text, KINDS[kind[a] - 1], int(a), int(b))):
                        own.append(span)
            out.append(own)
        return out


def _plausible(text: str, kind: str, a: int, b: int) -> tuple[str, int, int] | None:
    while b > a and not text[b - 1].isalnum():
        b -= 1
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    part = text[a:b]
    digits = sum("0" <= c <= "9" for c in part)
    if a and (text[a - 1].isalnum() and part[:1].isalnum()) or b < len(text) and text[b].isalnum():
        return None
    if kind == "email":
        good = 0 < part.find("@") < part.rfind(".") and not any(c.isspace() for c in part)
    elif kind == "ip":
        numbers = part.split(".")
        good = len(numbers) == 4 and all(p.isdecimal() and p.isascii() and len(p) < 4 and int(p) <= 255 for p in numbers)
    else:
        clean = all("0" <= c <= "9" or c in "+() .-/" for c in part)
        good = clean and (7 <= digits <= 15 and len(part) > digits if kind == "phone" else 13 <= digits <= 19 and luhn("".join(c for c in part if "0" <= c <= "9")))
    return (kind, a, b) if good else None


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


# --- labelled text ---------------------------------------------------------------------------------------


def labelled_windows(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows of generated text with tags: words of random syllables, personal data, and look-alikes without a tag."""
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    syllables = ["an", "the", "ion", "re", "st", "que", "ich", "en", "do", "la", "é", "ü", "ment", "os", "ka", "by"]
    letters = "abcdefghijklmnopqrstuvwxyzàäçéñöüß"

    def word() -> str:
        made = "".join(pick(syllables if rng.random() < 0.5 else letters) for _ in range(int(rng.integers(1, 6))))
        return made.capitalize() if rng.random() < 0.15 else made

    def ascii_word() -> str:
        return "".join(c for c in word() if c.isascii()) or "info"

    def card() -> str:
        body = digits(15)
        full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return pick([full, "-".join(full[i : i + 4] for i in range(0, 16, 4)), " ".join(full[i : i + 4] for i in range(0, 16, 4))])

    def phone() -> str:
        return pick([f"+{digits(2)} {digits(3)} {digits(7)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)}/{digits(7)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"+{digits(2)}{digits(9)}"])

    made = {
        "email": lambda: f"{ascii_word()}{pick(['.', '_', '', '-'])}{pick([ascii_word(), digits(2)])}@{ascii_word()}{pick(['', digits(1)])}.{pick(['com', 'org', 'example.com', 'de'])}",
        "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)),
        "card": card, "phone": phone,
    }
    alike = [lambda: digits(int(rng.integers(1, 9))), lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: "".join(pick("0123456789abcdef") for _ in range(32)), lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(3)},{digits(2)}", lambda: f"@{word()}", lambda: f"{pick('abx')}{digits(20)}", lambda: f"{digits(5)}.{digits(4)}", lambda: f"#{digits(4)}"]
    xs, ys = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.int64)
    for i in range(n):
        text, spans = "", []
        while len(text) < 2 * WINDOW:
            roll = rng.random()
            if roll < 0.12:
                kind = pick(KINDS)
                part = made[kind]()
                spans.append((kind, len(text), len(text) + len(part)))
            else:
                part = pick(alike)() if roll < 0.2 else word()
            text += part + pick([" ", " ", " ", ", ", ". ", "\n", " | "])
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            tags[a:b] = 2 + 2 * KINDS.index(kind)
            tags[a] -= 1
        start = int(rng.integers(0, len(text) - WINDOW + 1))
        xs[i], ys[i] = char_ids(text)[start : start + WINDOW], tags[start : start + WINDOW]
    return xs, ys


@lru_cache(maxsize=2)
def trained(windows: int = 6000, steps: int = 420) -> Tagger:
    """The network fitted on generated windows; the same in every process."""
    return Tagger().fit(*labelled_windows(windows), steps)


# --- operators -------------------------------------------------------------------------------------------


def all_spans(texts: list[str | None], tagger: Tagger) -> list[tuple[list, list]]:
    """Base spans, and all spans: the base ones and those of the network that touch none of them; each by kind, then start."""
    whole = [t or "" for t in texts]
    out = []
    for text, more in zip(whole, tagger.spans(whole), strict=True):
        base = base_spans(text)
        added = [s for s in more if all(s[2] <= a or b <= s[1] for _, a, b in base)]
        out.append((base, sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1])) if added else base))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` per row; a null text is empty.

    Counts and digest are of the base spans, ``spans`` lists all; places are code points, end exclusive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                got = all_spans(part.column("text").to_pylist(), tagger)
                cols = [part.column("id")] + [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
                cols += [pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got], pa.string()), pa.array([written(a) for _, a in got], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones joined, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``.

    Masking goes on until none is found, as text around a mask may form a new match. Null texts stay null.
    """
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices_at(batch, at, 4 << 20):
                texts = part.column(at).to_pylist()
                todo = [i for i, t in enumerate(texts) if t]
                while todo:
                    found = all_spans([texts[i] for i in todo], tagger)
                    todo = [i for i, (_, spans) in zip(todo, found, strict=True) if spans]
                    for i, spans in zip(todo, [s for _, s in found if s], strict=True):
                        texts[i] = masked(texts[i], spans)
                cols = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(run, schema)
