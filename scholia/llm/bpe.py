"""Byte-pair encoding and decoding through a table of distinct words.

A text is split into the pre-tokenizer's words in the Spark job; each distinct word of a partition is encoded
once and the ids are joined back by position. Words meet their ids in units, the stretches between single blanks:
a blank before anything but white space always begins a word. Decoding joins ids to the vocabulary's pieces. The
tables of words and of units belong to the worker that reads the partition, as a shuffle of every (text, position, word) row would weigh several
times the texts; each is emptied at ``TABLE_WORDS`` entries, which bounds memory and changes no result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholia.llm.common import text_slices

TABLE_WORDS = 400_000
#: The byte-level pre-tokenizer's words; \s there is Unicode's White_Space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Outside these ranges the library's Unicode tables may be of another version: such texts are encoded whole by the library.
_PLAIN = regex.compile(r"[\x00-ɏͰ-ϿЀ-џ -⁯€぀-ヿ一-龥]*+")


@lru_cache(maxsize=4)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


class WordCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = regex.compile(WORD)
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in specials.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.pieces = pieces(spec)
        self.line = self.pieces.index(b"\n")
        self.table: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not _PLAIN.fullmatch(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.split is None or "<" not in text and not self.split.search(text):
            return self._ordinary(text)
        return b"".join(self.special.get(part) or self._ordinary(part) for part in self.split.split(text))

    def _ordinary(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        units = self.units
        try:
            return self._joined(self.words.findall(first)) + b"".join([units[u] for u in rest])
        except KeyError:
            if len(units) > TABLE_WORDS:
                units.clear()
            new = [u for u in dict.fromkeys(rest) if u not in units]
            if any(not u or u[0].isspace() for u in new):
                # More than one blank at a place: only the words' own pattern cuts there, and no table has such a unit.
                return self._joined(self.words.findall(text))
            found = [self.words.findall(" " + u) for u in new]
            self._learn(chain.from_iterable(found))
            table = self.table
            for u, words in zip(new, found, strict=True):
                units[u] = table[words[0]] if len(words) == 1 else b"".join([table[w] for w in words])
            return self._joined(self.words.findall(first)) + b"".join([units[u] for u in rest])

    def _joined(self, words: list[str]) -> bytes:
        self._learn(words)
        table = self.table
        return b"".join([table[w] for w in words])

    def _learn(self, words: Iterable[str]) -> None:
        """Have all of some words in the table; new ones are encoded as one text, a line each."""
        table = self.table
        if len(table) > TABLE_WORDS:
            table.clear()
        new = [w for w in dict.fromkeys(words) if w not in table]
        lines = [w for w in new if not w[-1].isspace()]
        if lines:
            ids = np.array(self.library.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.line)
            if len(ends) == len(lines) - 1:
                every, cuts = ids.tobytes(), [-4, *(4 * ends).tolist(), len(ids) * 4]
                table.update((w, every[a + 4 : b]) for w, a, b in zip(lines, cuts[:-1], cuts[1:], strict=True))
                new = [w for w in new if w not in table]
        if new:
            for w, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
                table[w] = np.array(e.ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        piece = self.pieces
        return b"".join([piece[i] for i in ids.tolist()]).decode("utf-8", "replace")


def pieces(spec: dict) -> list[bytes]:
    """Bytes of every id, from the vocabulary's printable spelling of bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
    for piece, i in spec["model"]["vocab"].items():
        out[i] = bytes(chars[c] for c in piece) if all(c in chars for c in piece) else piece.encode()
    for t in spec["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``(id, ids, n_tokens, ids_sha256, decoded_sha256)`` of every whole text; a null text is empty.

    ``ids`` is left out with ``keep_ids=False``. The decoded digest is of the text that the ids decode to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in text_slices(batch, "text", 4 << 20):
                ids = [own.encode(t or "") for t in part.column("text").to_pylist()]
                arrays = [np.frombuffer(b, "<u4") for b in ids]
                cols = [part.column("id")] + ([pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32()))] if keep_ids else [])
                cols += [
                    pa.array([len(a) for a in arrays], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(a).encode()).hexdigest() for a in arrays], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["id", *(["ids"] if keep_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = {"id": "long", "ids": "array<int>", "n_tokens": "long"}
    return rows.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
