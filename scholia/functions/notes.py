"""Reading a note's parts with built-in expressions: metadata, body, tags, links, sections, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Patterns of tags by profile, of links and of file names.
TAGS = {"index": r"#[A-Za-z][A-Za-z0-9-]*", "graph": r"(?U)#[\w\-]+", "registry": r"#[a-z][a-z0-9-]*"}
SEE_LINK = r"(?m)^-\s+see:\s*\[[^\]]*\]\(([^)]+)\)"
TYPED_LINK = r"(?m)^\s*-\s+(see|ref|amends|extends):\s*\[([^\]]*)\]\(([^)]+)\)"
LOOSE_LINK = r"^\s*-\s+(see|ref|amends|extends):\s*\["
FILE_NAME = r"^\d{8}-\d{6}-.+\.md$"
LARGE_CHARS = 1200
PROFILES = ("index", "graph", "registry", "hook")


def strip(c: F.Column, chars: str = r"\s") -> F.Column:
    return F.regexp_replace(c, f"(?U)^[{chars}]+|[{chars}]+$", "")


def newlines(c: F.Column) -> F.Column:
    """Universal newlines, as a file read in text mode has them."""
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, r"\r\n?", "\n")).otherwise(c)


def file_name(path: F.Column) -> F.Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: F.Column) -> F.Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def stem(path: F.Column) -> F.Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def with_metadata(entries: DataFrame, profile: str = "index", content: str = "content") -> DataFrame:
    """Add ``meta`` (pairs in order) and ``body`` as the profile reads them.

    index: keys before the first colon, quotes of both kinds stripped. graph: word keys only, double quotes stripped.
    registry: the block ends at the first ``---`` anywhere, first key wins. hook: first line exactly ``---``, end a line exactly so.
    An absent or open block gives no pairs and the whole text as body.
    """
    text = newlines(F.col(content))
    closing = {"registry": F.locate("---", text, 4)}.get(profile, F.locate("\n---", text, 4))
    if profile == "hook":
        closing = F.when(text.rlike(r"^---\n(?s:.*?\n)?---(\n|$)"), F.locate("\n---\n", F.concat(text, F.lit("\n")), 4)).otherwise(0)
    rows = entries.withColumn("__text", text).withColumn("__end", F.when(F.startswith(text, F.lit("---")), closing).otherwise(0))
    block = F.when(F.col("__end") > 0, F.substring("__text", F.lit(4), F.col("__end") - 4)).otherwise("")
    body = F.when(F.col("__end") > 0, F.regexp_replace(F.substring("__text", F.col("__end") + 4, F.length("__text")), r"^\n+", "")).otherwise(F.col("__text"))
    lines = F.split(block, "\n")
    if profile == "graph":
        lines = F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x.rlike(r"(?U)^\w+:"))
        value = lambda x: strip(strip(F.regexp_replace(x, r"(?U)^\w+:", "")), '"')
    elif profile == "hook":
        lines = F.filter(lines, lambda x: x.rlike(r"^(status|superseded_by):"))
        value = lambda x: F.replace(strip(F.regexp_replace(x, r"^\w+:", "")), F.lit('"'), F.lit(""))
    else:
        lines = F.filter(lines, lambda x: F.contains(x, F.lit(":")))
        value = lambda x: strip(strip(strip(F.regexp_replace(x, r"^[^:]*:", "")), '"'), "'")
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), value(x).alias("v")))
    return rows.withColumn("meta", pairs).withColumn("body", body).drop("__text", "__end")


def value(key: str, first: bool = False) -> F.Column:
    """A key's value, the last one unless ``first``; null where absent."""
    own = F.filter("meta", lambda p: p["k"] == key)
    return F.try_element_at(own, F.lit(1 if first else -1))["v"]


def tags(profile: str) -> F.Column:
    return F.regexp_extract_all(F.coalesce(value("tags", profile == "registry"), F.lit("")), F.lit(TAGS[profile]), 0)


def parsed(entries: DataFrame) -> DataFrame:
    """Entries as the index keeps them: ``(relpath, title, tags, status, created, type, see, body, sha256)``."""
    rows = with_metadata(entries, "index")
    text = lambda k: F.coalesce(value(k), F.lit(""))
    return rows.select(
        "relpath", F.coalesce(value("title"), stem(F.col("relpath"))).alias("title"), tags("index").alias("tags"), text("status").alias("status"), text("created").alias("created"),
        text("type").alias("type"), F.transform(F.regexp_extract_all("body", F.lit(SEE_LINK), 1), lambda x: strip(x)).alias("see"), "body", F.sha2(newlines(F.col("content")), 256).alias("sha256"),
    )


def chunks(notes: DataFrame) -> DataFrame:
    """``(relpath, chunk_id, text)``: the whole entry, and each non-empty level-2 section of a large one."""
    head = strip(F.col("title"))
    parts = F.filter(F.split("body", r"(?m)^(?=##\s)"), lambda p: p.rlike(r"^##\s"))
    made = F.transform(parts, lambda p: F.struct(strip(F.regexp_replace(F.substring_index(p, "\n", 1), r"^[# ]+", "")).alias("h"), strip(F.when(F.contains(p, F.lit("\n")), F.regexp_replace(p, r"^[^\n]*\n", "")).otherwise("")).alias("b")))
    full = F.filter(made, lambda p: p["b"] != "")
    rows = notes.withColumn("__head", head).withColumn("__sections", F.when(F.length("body") > LARGE_CHARS, full).otherwise(F.array().cast("array<struct<h:string,b:string>>")))
    sections = F.transform("__sections", lambda p, i: F.struct(F.concat(F.lit("sec"), i).alias("chunk_id"), strip(F.concat(F.col("__head"), F.lit(" — "), p["h"], F.lit("\n\n"), p["b"])).alias("text")))
    whole = F.struct(F.lit("full").alias("chunk_id"), strip(F.concat(F.col("__head"), F.lit("\n\n"), F.col("body"))).alias("text"))
    return rows.select("relpath", F.inline(F.concat(F.array(whole), sections)))


def normal_path(path: F.Column) -> F.Column:
    """An absolute path without ``.``, ``..`` and empty parts."""
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, p: F.when((p == "") | (p == "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def typed_links(text: F.Column) -> F.Column:
    """``array<struct<kind, target>>`` in order of appearance, targets without anchors."""
    found = F.regexp_extract_all(text, F.lit(TYPED_LINK), 0)
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, TYPED_LINK, 1).alias("kind"), strip(F.substring_index(F.regexp_extract(m, TYPED_LINK, 3), "#", 1)).alias("target")))


def shortened(title: F.Column, width: int = 70) -> F.Column:
    return F.when(F.length(title) > width, F.concat(F.substring(title, 1, width - 1), F.lit("…"))).otherwise(title)
