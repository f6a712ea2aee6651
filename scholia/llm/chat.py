"""Chat formatting with typed content parts.

A message's text is a plain string or a JSON list of parts (``text``, ``image``, ``audio``, ``document``). A
visitor flattens the parts in order: text is escaped, every attachment becomes a numbered placeholder, its
reference is recorded and its expanded token count follows from its size. Turns are marked by
``<|im_start|>role`` and ``<|im_end|>``. Within texts a backslash is doubled and ``<|`` gets a backslash, so no
text can hold a control string and the escape can be undone exactly.

A conversation is never gathered: rows are dealt by conversation, sorted by turn, and flow through in order;
each turn gives its own piece of the output, and what is needed from earlier turns is a few running values.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"((?:[^\n\\]|\\.)*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def _amount(value) -> float:
    """A size from a part; what isn't a number between 0 and a billion says nothing and counts as 0."""
    try:
        size = float(value)
    except (TypeError, ValueError, OverflowError):
        return 0.0
    return size if 0 <= size <= 1e9 else 0.0


@dataclass
class PartVisitor:
    """Flattens parts in order; numbering goes on over the turns of a conversation.

    A size that is missing or no sensible number leaves the least count: one token, or one page.
    """

    image_patch: int = 28
    audio_tokens_per_s: float = 25.0
    page_tokens: int = 512
    counts: dict = field(default_factory=lambda: {"image": 0, "audio": 0, "document": 0})
    attachments: list = field(default_factory=list)

    def visit(self, part) -> str:
        kind = part.get("type") if isinstance(part, dict) else "text"
        return getattr(self, f"visit_{kind}", self.visit_unknown)(part)

    def visit_text(self, part) -> str:
        return escape(str(part if not isinstance(part, dict) else part.get("text") or ""))

    def visit_image(self, part) -> str:
        tokens = math.ceil(_amount(part.get("width")) / self.image_patch) * math.ceil(_amount(part.get("height")) / self.image_patch)
        return self._placed("image", part, max(1, tokens))

    def visit_audio(self, part) -> str:
        return self._placed("audio", part, max(1, math.ceil(_amount(part.get("seconds")) * self.audio_tokens_per_s)))

    def visit_document(self, part) -> str:
        return self._placed("document", part, max(1, math.ceil(_amount(part.get("pages")))) * self.page_tokens)

    def visit_unknown(self, part) -> str:
        return escape(json.dumps(part, ensure_ascii=False, sort_keys=True))

    def _placed(self, kind: str, part: dict, tokens: int) -> str:
        self.counts[kind] += 1
        self.attachments.append((kind, self.counts[kind], str(part.get("ref") or ""), tokens))
        return f"<|{kind}_{self.counts[kind]}|>"


def content_parts(text: str | None, typed: bool) -> list:
    """Parts of a message: a JSON list of objects with a type if ``typed``, else one part that holds the text as it is."""
    if typed and text and text.lstrip().startswith("["):
        try:
            got = json.loads(text)
        except ValueError:
            return [{"type": "text", "text": text}]
        if isinstance(got, list) and got and all(isinstance(p, dict) and "type" in p for p in got):
            return got
    return [{"type": "text", "text": text or ""}]


def format_turn(role: str, body: str) -> str:
    return f"{START}{escape_role(role)}\n{body}{END}\n"


def parse_turns(formatted: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """Role, unescaped text and the place of the still escaped text of every turn of formatted output."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape_role(m[1]), unescape(m[2]), m.span(2)
        at = m.end()


_ATTACHMENT = pa.struct([("kind", pa.string()), ("number", pa.int64()), ("ref", pa.string()), ("tokens", pa.int64())])


def format_turns(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", typed: bool = True) -> DataFrame:
    """One row per turn, in order: ``(conv_id, position, role, piece, loss_start, loss_end, attachments)``.

    ``piece`` is the turn's part of the conversation's output (join pieces by position for the whole);
    ``loss_start`` and ``loss_end`` bound the part under the loss mask, null unless the role is assistant.
    Ties of turn are ordered by role, then text; null turns come first, null roles and texts are empty,
    a null conversation id is a conversation of its own.
    """
    rows = messages.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(lambda b: _format(b, typed), _FORMATTED)


_FORMATTED = "conv_id long, position long, role string, piece string, loss_start long, loss_end long, attachments array<struct<kind:string,number:long,ref:string,tokens:long>>"


def _format(batches: Iterator[pa.RecordBatch], typed: bool) -> Iterator[pa.RecordBatch]:
    conv, position, visitor, begun = None, 0, PartVisitor(), False
    for batch in batches:
        out = [[] for _ in range(7)]
        for own, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not begun or own != conv:
                conv, position, visitor, begun = own, 0, PartVisitor(), True
            visitor.attachments = []
            body = "".join(map(visitor.visit, content_parts(text, typed)))
            piece = format_turn(role, body)
            start = len(START) + len(escape_role(role)) + 1 if role == "assistant" else None
            stop = None if start is None else start + len(body)
            for col, v in zip(out, (own, position, role, piece, start, stop, visitor.attachments), strict=True):
                col.append(v)
            position += 1
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(_ATTACHMENT)]
        arrays = [pa.array([[dict(zip(("kind", "number", "ref", "tokens"), x, strict=True)) for x in v] for v in c], k) if k == kinds[6] else pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "position", "role", "piece", "loss_start", "loss_end", "attachments"])


def digests(formatted: DataFrame) -> DataFrame:
    """Read the output of format_turns back: one row per conversation with digests of its turns and of its loss text,
    and the number of attachments and of the tokens that their placeholders expand to.

    A SHA-256 over a conversation is sequential, so its pieces pass through one task, in order; they
    are hashed as they come and never held together.
    """
    ordered = formatted.select("conv_id", "position", "piece", "loss_start", "loss_end", F.size("attachments").alias("placed"), F.aggregate("attachments", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("expanded")).repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long")


def attached(formatted: DataFrame) -> DataFrame:
    """What format_turns has placed, per conversation: ``(conv_id, n_attachments, attachment_tokens, typed_chars)``, the last the length of its output."""
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda n, x: n + x["tokens"])
    return formatted.groupBy("conv_id").agg(F.sum(F.size("attachments")).alias("n_attachments"), F.sum(tokens).alias("attachment_tokens"), F.sum(F.length("piece")).alias("typed_chars"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"]

    def done(rows: list[list]) -> pa.RecordBatch:
        cols = list(zip(*[(r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), *r[5:]) for r in rows], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for c, n in zip(cols, names, strict=True)], names)

    now = None
    for batch in batches:
        rows = []
        for conv, piece, a, b, placed, expanded in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end", "placed", "expanded")), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    rows.append(now)
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, text, _ in parse_turns(piece):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
            if a is not None:
                lost = unescape(piece[a:b])
                now[3] += len(lost)
                now[4].update(lost.encode())
            now[5] += len(piece)
            now[6] += placed
            now[7] += expanded
        if rows:
            yield done(rows)
    if now is not None:
        yield done([now])
