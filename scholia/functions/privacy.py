"""Redaction of secrets and scans for text that should not be published."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Placeholder, patterns, sensitive key names, depth.
PLACEHOLDER = "‹redacted›"
SECRET_URI = r"(?i)\bop://[A-Za-z0-9._~%/-]*[A-Za-z0-9]"
JWT = r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
TOKEN = r"\bgh[pousr]_[A-Za-z0-9]{30,}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
LONG = r"\b[A-Za-z0-9+/_-]{40,}={0,2}\b"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
HOME = r"/home/([^/\s]+)/"
UNEXPANDED = r"\$\{[A-Za-z_][A-Za-z0-9_]*\}"
SENSITIVE = ("password", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "authorization", "auth", "credential", "private_key", "privatekey", "client_secret", "access_key", "session", "cookie")
MAX_DEPTH = 8
KINDS = {"op-ref": SECRET_URI, "jwt": JWT, "pem-private-key": PEM, "github-token": TOKEN, "email": EMAIL}


def _unicode(pattern: str) -> str:
    """Word boundaries as Unicode has them, ASCII classes as written."""
    return "(?U)" + pattern


def _benign(kind: str, keep_names: bool):
    """Matches that stay, as a test on the match."""
    if kind == "email":
        return lambda m: F.contains(F.lower(m), F.lit("noreply"))
    if kind == "op-ref" and keep_names:
        return lambda m: ~m.rlike(r"(?i)(?<=/)[a-z0-9]{26}(?=/|$)")
    return None


def redacted(rows: DataFrame, text_col: str = "text", keep_names: bool = False) -> DataFrame:
    """``rows`` with unambiguous secrets masked in the text, and ``n_masked``: how many of each kind, in the order of KINDS.

    Each kind is a step of its own on the text that the kinds before it left; a step's text is a column, so no
    pattern runs twice over the same text, and texts without a match of a kind are passed on as they are.
    """
    for i, kind in enumerate(KINDS):
        pattern, stays = _unicode(KINDS[kind]), _benign(kind, keep_names)
        rows = rows.withColumn(f"__found{i}", F.regexp_extract_all(text_col, F.lit(pattern), 0))
        if stays is None:
            rows = rows.withColumn(text_col, F.when(F.size(f"__found{i}") > 0, F.regexp_replace(text_col, pattern, PLACEHOLDER)).otherwise(F.col(text_col)))
            rows = rows.withColumn(f"__n{i}", F.size(f"__found{i}"))
        else:
            # Texts between the matches, put together again with each match or the placeholder.
            rows = rows.withColumn("__between", F.when(F.size(f"__found{i}") > 0, F.split(text_col, pattern, -1)))
            rest = F.zip_with(f"__found{i}", F.slice("__between", 2, F.size("__between")), lambda m, b: F.concat(F.when(stays(m), m).otherwise(PLACEHOLDER), F.coalesce(b, F.lit(""))))
            rows = rows.withColumn(text_col, F.when(F.size(f"__found{i}") > 0, F.concat(F.col("__between")[0], F.array_join(rest, ""))).otherwise(F.col(text_col)))
            rows = rows.withColumn(f"__n{i}", F.size(F.filter(f"__found{i}", lambda m: ~stays(m)))).drop("__between")
        rows = rows.drop(f"__found{i}")
    every = [F.struct(F.lit(k).alias("kind"), F.col(f"__n{i}").alias("count")) for i, k in enumerate(KINDS)]
    return rows.withColumn("n_masked", F.array(*every)).drop(*[f"__n{i}" for i in range(len(KINDS))])


def redact(entries: DataFrame, keep_names: bool = False) -> DataFrame:
    """``(relpath, text, hits)``; hits are the kinds masked with their counts. A text without hits is as before."""
    found = redacted(entries.select("relpath", F.col("content").alias("text")), "text", keep_names)
    return found.select("relpath", "text", F.filter("n_masked", lambda h: h["count"] > 0).alias("hits"))


def free_text(text: F.Column, mode: str = "length") -> F.Column:
    if mode == "pattern":
        return F.regexp_replace(F.regexp_replace(text, _unicode(LONG), PLACEHOLDER), _unicode(SECRET_URI), PLACEHOLDER)
    return F.concat(F.lit(f"{PLACEHOLDER} len="), F.length(text))


_SECRETS = [re.compile(p) for p in (*KINDS.values(), LONG)]
_SENSITIVE_KEY = re.compile("|".join(map(re.escape, SENSITIVE)))


def mask_parsed(parsed):
    """A parsed JSON value with what is secret masked in place; keys, their order and plain scalars stay.

    What stands under a sensitive key, or below ``MAX_DEPTH`` containers, is replaced whole. Places still to be
    looked at wait in a list, so nesting of any depth needs no recursion.
    """
    top = [parsed]
    places = [(top, 0, 0)]
    while places:
        holder, at, depth = places.pop()
        held = holder[at]
        if depth > MAX_DEPTH or isinstance(at, str) and _SENSITIVE_KEY.search(at.lower()):
            holder[at] = PLACEHOLDER
        elif isinstance(held, (dict, list)):
            places.extend((held, inner, depth + 1) for inner in (held.keys() if isinstance(held, dict) else range(len(held))))
        elif isinstance(held, str):
            for secret in _SECRETS:
                held = secret.sub(PLACEHOLDER, held)
            holder[at] = held
    return top[0]


def redact_json(values: F.Column) -> F.Column:
    """JSON texts, redacted; keys keep their order. A text that is no JSON, or nests too deep to be read, is treated as one string.

    JSON of any shape has no type in Spark that a built-in expression could walk, so this is an Arrow UDF.
    """

    def one(v):
        if v is None:
            return None
        try:
            return json.dumps(mask_parsed(json.loads(v)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return mask_parsed(v)

    def batch(v: pd.Series) -> pd.Series:
        return v.map(one)

    return F.pandas_udf(batch, "string")(values)


def leaks(entries: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(relpath, lineno, kind, snippet)`` of every suspicious place; ``names``: words that must not appear."""
    lines = entries.select("relpath", F.posexplode(F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n")).alias("at", "line"))
    found = lambda kind, hits: F.transform(hits, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("snippet")))
    every = lambda p: F.regexp_extract_all("line", F.lit(_unicode(p)), 0)
    home = F.filter(every(HOME), lambda m: ~m.rlike(r"^/home/<.*>/$"))
    secret = F.filter(every(LONG), lambda m: ~m.rlike(r"^(?i)[0-9a-f]+$") & (m.rlike(r"[+/=]") | m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")))
    kinds = [found("uuid", every(UUID)), found("home-path", home), found("unexpanded-placeholder", every(UNEXPANDED)), found("base64-secret", F.transform(secret, lambda m: F.concat(F.substring(m, 1, 12), F.lit("…"))))]
    if names:
        kinds.append(found("private-name", every(r"(?i)\b(" + "|".join(re.escape(n) for n in names) + r")\b")))
    return lines.select("relpath", (F.col("at") + 1).alias("lineno"), F.explode(F.concat(*kinds)).alias("f")).select("relpath", "lineno", "f.kind", "f.snippet")
