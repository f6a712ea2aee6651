"""Hybrid retrieval: term scores, nearest vectors, rank fusion, link expansion, filters and snippets."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.notes import with_metadata
from scholia.plans.lineage import durable

if TYPE_CHECKING:
    from scholia.plans.index import StoredIndex

#: Rank constant, most files a term may hit, nearest chunks, snippet width.
RRF_K, HIT_LIMIT, NEAREST, SNIPPET = 60, 50, 40, 160


def query_terms(query: str, nouns: list[str] | None = None) -> list[str]:
    """Nouns of a supplied analyser, then ASCII terms; blanks part the query where both give none. Distinct regardless of case."""
    found = [*(nouns or []), *ascii_terms(query)] or [t for t in query.split() if len(t) >= 2]
    return list({t.lower(): t for t in reversed(found)}.values())[::-1]


def ascii_terms(query: str) -> list[str]:
    found = [t for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9_.-]*", query) if len(t) >= 2]
    return list({t.lower(): t for t in reversed(found)}.values())[::-1]


def term_hits(entries: DataFrame, terms: list[str], fold: bool = True) -> DataFrame:
    """``(relpath, term, n)``: entries that contain each term, with the number of entries it hits.

    The terms travel as an array in the plan, so each entry is read once and only hits leave the scan; counts
    come from a second aggregation with one row per term.
    """
    if not terms:
        return entries.select("relpath", F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).limit(0)
    text = F.lower("content") if fold else F.col("content")
    own = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, F.lower(t) if fold else t))
    hits = durable(entries.select("relpath", F.explode(own).alias("term")))
    counts = hits.groupBy("term").agg(F.count("*").alias("n"))
    return hits.join(F.broadcast(counts), "term").select("relpath", "term", "n")


def lexical_scores(entries: DataFrame, terms: list[str]) -> DataFrame:
    """``(relpath, score)``: the sum of 1 / n over an entry's terms; terms that hit too many entries don't count."""
    return term_hits(entries, terms).where(F.col("n") <= HIT_LIMIT).groupBy("relpath").agg(F.sum(1.0 / F.col("n")).alias("score"))


def hook_scores(entries: DataFrame, terms: list[str]) -> DataFrame:
    """As lexical_scores, case-sensitive, in order of terms, rounded to four places at each addition."""
    hits = term_hits(entries, sorted(terms), fold=False).where(F.col("n") <= HIT_LIMIT)
    ordered = F.array_sort(F.collect_list(F.struct("term", "n")))
    return hits.groupBy("relpath").agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: F.round(a + 1.0 / x["n"], 4)).alias("score"))


def distance(vector: F.Column, query: list[float]) -> F.Column:
    target = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector, target, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x))


def nearest_entries(vectors: DataFrame, query: list[float], k: int = NEAREST, entry: str = "relpath", tie: str = "chunk_id") -> DataFrame:
    """``(entry, dist)``: best distance of each entry among the k nearest chunks, exact over all chunks."""
    near = vectors.select(entry, tie, distance(F.col("embedding"), query).alias("dist")).orderBy("dist", tie).limit(k)
    return near.groupBy(entry).agg(F.min("dist").alias("dist"))


def ranked(scores: DataFrame, *order: F.Column) -> DataFrame:
    """``(relpath, rank)`` from 1. Lists hold hits of a few terms or k chunks, so one window sorts them."""
    return scores.select("relpath", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(*lists: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: ``(relpath, score)``."""
    rows = lists[0]
    for x in lists[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("relpath").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))


def expand(fused: DataFrame, notes: DataFrame, top: int) -> DataFrame:
    """Add known entries that the best 2 * top link to, at half the score of their best linker, unless already scored."""
    best = fused.orderBy(F.desc(F.round("score", 9)), "relpath").limit(2 * top)
    linked = best.join(notes.select("relpath", "see"), "relpath").select(F.explode("see").alias("relpath"), (0.5 * F.col("score")).alias("score"))
    fresh = linked.join(notes.select("relpath"), "relpath", "left_semi").join(fused.select("relpath"), "relpath", "left_anti")
    return fused.unionByName(fresh.groupBy("relpath").agg(F.max("score").alias("score")))


def passes(status: str | None = None, tags: list[str] | None = None, kind: str | None = None, created_from: str | None = None, created_to: str | None = None) -> F.Column:
    ok = F.lit(True)
    if status:
        ok &= F.col("status") == status
    if kind:
        ok &= F.col("type") == kind
    if tags:
        ok &= F.size(F.array_except(F.array(*map(F.lit, tags)), "tags")) == 0
    if created_from:
        ok &= (F.col("created") != "") & (F.col("created") >= created_from)
    if created_to:
        ok &= (F.col("created") != "") & (F.col("created") <= created_to)
    return ok


def snippet(body: F.Column, query: str, nouns: list[str] | None = None) -> F.Column:
    flat = F.trim(F.regexp_replace(body, r"(?U)\s+", " "))
    at = F.lit(0)
    for t in reversed([*ascii_terms(query), *(nouns or [])]):
        here = F.locate(t.lower(), F.lower(flat))
        at = F.when(here > 0, here).otherwise(at)
    start = F.greatest(F.lit(0), at - 1 - SNIPPET // 3)
    start = F.when(at == 0, 0).otherwise(start)
    dots = lambda c: F.when(c, "…").otherwise("")
    return F.concat(dots(start > 0), F.substring(flat, start + 1, F.lit(SNIPPET)), dots(start + SNIPPET < F.length(flat)))


def search(entries: DataFrame, notes: DataFrame, vectors: DataFrame, query: str, vector: list[float], top: int = 8, nouns: list[str] | None = None, **filters) -> DataFrame:
    """``(relpath, title, score, status, tags, snippet)`` of the best ``top`` entries; filters apply after scoring and take no slots."""
    scores = lexical_scores(entries, query_terms(query, nouns))
    lexical = ranked(scores, F.desc(F.round("score", 9)), F.col("relpath"))
    near = ranked(nearest_entries(vectors, vector), F.col("dist"), F.col("relpath"))
    fused = expand(durable(fuse(lexical, near)), notes, top)
    empty = F.array().cast("array<string>")
    met = fused.join(notes.drop("sha256", "see"), "relpath", "left")
    met = met.withColumns({"title": F.coalesce("title", "relpath"), "tags": F.coalesce("tags", empty)} | {c: F.coalesce(c, F.lit("")) for c in ("status", "created", "type", "body")})
    best = met.where(passes(**filters)).orderBy(F.desc(F.round("score", 9)), "relpath").limit(top)
    return best.select("relpath", "title", F.round("score", 5).alias("score"), "status", "tags", snippet(F.col("body"), query, nouns).alias("snippet"))


def search_index(index: StoredIndex, entries: DataFrame, query: str, vector: list[float], top: int = 8, nouns: list[str] | None = None, refresh: bool = True, **filters) -> DataFrame:
    """As ``search``, from a stored index's metadata and vectors; ``entries`` are the texts as they are now.

    Unless ``refresh`` is off, new and changed entries are brought into the index first. Removed ones stay in it and can be
    found by their vectors until a full refresh; their snippet is empty. Texts are read for terms and for the snippets of the hits.
    """
    if refresh:
        index.refresh_stale(entries)
    known = index.entries().withColumn("body", F.lit(""))
    best = durable(search(entries, known, index.chunks(), query, vector, top, nouns, **filters).drop("snippet"))
    # At most ``top`` rows.
    texts = with_metadata(entries.join(F.broadcast(best.select("relpath")), "relpath", "left_semi")).select("relpath", "body")
    return best.join(texts, "relpath", "left").select(*best.columns, snippet(F.coalesce("body", F.lit("")), query, nouns).alias("snippet"))


def prompt_hits(entries: DataFrame, metadata: DataFrame, terms: list[str], statuses: list[str] | None = None, top: int = 5) -> DataFrame:
    """``(relpath, score, label)`` of the best entries of allowed statuses (none: all); a missing status is active."""
    allowed = metadata.withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit("active")))
    if statuses is not None:
        allowed = allowed.where(F.col("status").isin(statuses))
    note = F.when(F.col("status") == "active", "").otherwise(F.concat(F.lit(" [status: "), "status", F.when(F.coalesce("superseded_by", F.lit("")) != "", F.concat(F.lit(", superseded_by: "), "superseded_by")).otherwise(""), F.lit("]")))
    return hook_scores(entries, terms).join(allowed, "relpath").orderBy(F.desc("score"), F.desc("relpath")).limit(top).select("relpath", "score", F.concat("title", note).alias("label"))
