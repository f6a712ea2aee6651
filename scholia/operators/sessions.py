"""Conversation logs, task lists, link checks of single files and the size guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import notes as fn
from scholia.plans.lineage import durable

#: Words that mark a decision.
DECISION_WORDS = (
    "にする", "にした", "方針", "計画", "プラン", "決定",
    "採用", "変更", "修正", "追加", "削除", "移行",
    "decide", "plan", "approach", "strategy", "change",
    "let's", "we should", "i want", "please",
)
GUARD_BYTES, RECENT_S = 300 * 1024, 45 * 60


def decisions(messages: DataFrame, by: str = "conv_id", order: str = "turn", words: tuple = DECISION_WORDS, most: int = 10) -> DataFrame:
    """``(by, n, text)``: what users decided: distinct texts by first place, at most ``most`` a conversation."""
    said = messages.where(F.col("role").isin("user", "human") & (F.length("text") >= 10) & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("text"), w)))
    short = fn.strip(F.regexp_replace(F.substring("text", 1, 200), "\n", " "))
    first = said.groupBy(by, short.alias("text")).agg(F.min(order).alias("at")).where("text <> ''")
    return first.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("at", "text"))).where(F.col("n") <= most).select(by, "n", "text")


def transcript(lines: DataFrame) -> DataFrame:
    """Rows with a JSON ``line`` as messages: ``role`` and ``text`` in place of the line, other columns kept.

    Content is a string, or blocks whose texts are joined by a blank; the type stands for an absent role.
    Lines that are no JSON object, or hold neither form of content, are left out.
    """
    read = lambda content: F.from_json("line", f"role string, type string, content {content}")
    rows = lines.withColumn("__plain", read("string")).withColumn("__parts", read("array<string>")["content"])
    parts = F.filter(F.transform("__parts", lambda x: F.get_json_object(x, "$.text")), lambda x: x != "")
    text = F.when(F.col("__parts").isNotNull(), F.array_join(parts, " ")).otherwise(F.col("__plain.content"))
    role = F.when(F.coalesce(F.col("__plain.role"), F.lit("")) != "", F.col("__plain.role")).otherwise(F.col("__plain.type"))
    kept = [c for c in lines.columns if c not in ("line", "role", "text")]
    return rows.select(*[F.col(f"`{c}`") for c in kept], role.alias("role"), text.alias("text")).where("text is not null")


def tail(messages: DataFrame, by: str = "conv_id", order: str = "turn", most: int = 200) -> DataFrame:
    # Rows of one place are told apart by all they hold.
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), *[F.col(f"`{c}`") for c in messages.columns if c not in (by, order)]))
    return messages.withColumn("__nth", nth).where(F.col("__nth") <= most).drop("__nth")


def mentioned_paths(lines: DataFrame, pattern: str = r'"file_path"\s*:\s*"([^"]+)"') -> DataFrame:
    """Distinct paths of a transcript, sorted, without temporary ones."""
    found = lines.select(F.explode(F.regexp_extract_all("line", F.lit(pattern), 1)).alias("path")).distinct()
    return found.where(~F.col("path").rlike("^(/tmp|/dev)"))


#: How a written file and a read entry are named in a transcript's lines.
FILE_PATH, ENTRY_PATH = r'"file_path"\s*:\s*"([^"]+)"', r'(\.claude/knowledge/entries/[^\s"]+\.md)'


def compaction_checkpoint(lines: DataFrame, at: Column, by: str = "session", order: str = "n", most: int = 200) -> DataFrame:
    """``(session, at, decisions, files, entries)`` of the last ``most`` lines ``(session, n, line)`` of each transcript.

    Files are written paths without temporary ones, entries are knowledge entries named in any line, both distinct and
    sorted; decisions as ``decisions`` gives them. ``checkpoint_files`` and ``session_state`` make the texts. A session of
    which nothing is found has empty lists. What is gathered for a session is bounded by its last lines.
    """
    last = durable(tail(lines.select(F.col(by).alias("session"), F.col(order).alias("n"), "line"), "session", "n", most))

    def named(pattern: str, name: str) -> DataFrame:
        found = last.select("session", F.explode(F.regexp_extract_all("line", F.lit(pattern), 1)).alias("x")).where(~F.col("x").rlike("^(/tmp|/dev)")).distinct()
        return found.groupBy("session").agg(F.array_sort(F.collect_list("x")).alias(name))

    said = decisions(transcript(last), "session", "n")
    said = said.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("decisions"))
    out = last.select("session").distinct().join(said, "session", "left").join(named(FILE_PATH, "files"), "session", "left").join(named(ENTRY_PATH, "entries"), "session", "left")
    none = F.array().cast("array<string>")
    return out.select("session", at.alias("at"), *[F.coalesce(c, none).alias(c) for c in ("decisions", "files", "entries")])


def todo_progress(lists: DataFrame) -> DataFrame:
    """``(id, progress)`` of rows ``(id, content)``."""
    count = lambda mark: F.regexp_count("content", F.lit(rf"(?m)^\s*- \[{mark}\]"))
    done, doing, open_ = count("x"), count("~"), count(" ")
    total = done + doing + open_
    now = F.regexp_extract("content", r"(?m)^\s*- \[~\]\s*(.*)$", 1)
    text = F.concat(done, F.lit("/"), total, F.lit(" completed"), F.when(now != "", F.concat(F.lit(", current: "), now)).otherwise(""))
    return lists.select("id", F.when(F.col("content").isNull(), "unknown").when(total == 0, "no tasks").otherwise(text).alias("progress"))


def active_task(index_lines: DataFrame, existing: DataFrame) -> DataFrame:
    """First existing folder named in backticks between the Active and Completed headings of ``(pos, line)``."""
    carried = F.last(F.when(F.col("line").startswith("## "), F.col("line")), True).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    own = index_lines.withColumn("section", carried).where(F.col("section").startswith("## Active"))
    named = own.select("pos", F.explode(F.regexp_extract_all("line", F.lit(r"`([^`]+)`"), 1)).alias("path")).join(existing, "path", "left_semi")
    return named.orderBy("pos").limit(1).select("path")


def link_lines(entries: DataFrame) -> DataFrame:
    """``(relpath, lineno, text, target, annotated, issue)`` of relative links outside code fences."""
    lines = entries.select("relpath", F.posexplode(F.split(fn.newlines(F.col("content")), "\n")).alias("i", "line"))
    fence = F.col("line").rlike(r"^\s*```")
    by = Window.partitionBy("relpath").orderBy("i")
    marked = lines.withColumn("fences", F.sum(fence.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("line").over(by))
    pending = r"<!--\s*pending:\s*#(\d+)\s*-->"
    issue = F.when(F.col("line").rlike(pending), F.regexp_extract("line", pending, 1)).when(F.col("before").rlike(pending), F.regexp_extract("before", pending, 1))
    link = r"\[([^\]]*)\]\(([^)]+)\)"
    own = marked.where(~fence & (F.col("fences") % 2 == 0) & F.col("line").rlike(link)).select("relpath", "i", issue.alias("issue"), F.explode(F.regexp_extract_all("line", F.lit(link), 0)).alias("m"))
    own = own.select("relpath", (F.col("i") + 1).alias("lineno"), F.regexp_extract("m", link, 1).alias("text"), F.regexp_extract("m", link, 2).alias("whole"), "issue")
    own = own.where(~F.col("whole").rlike("^(https?://|mailto:|#)")).withColumn("target", F.substring_index("whole", "#", 1)).where("target <> ''")
    return own.select("relpath", "lineno", "text", "target", F.col("issue").isNotNull().alias("annotated"), F.coalesce(F.concat(F.lit("#"), "issue"), F.lit("")).alias("issue"))


def link_check(entries: DataFrame, root: str = "/base/a/b/entries", files: DataFrame | None = None) -> DataFrame:
    """Links of link_lines whose target neither the own folder nor the root has: ``(relpath, lineno, target, state)``.

    ``files``: the ``relpath`` of all that is there, if that is more than ``entries``; distinct.
    """
    files = (entries if files is None else files).select(F.concat(F.lit(root + "/"), "relpath").alias("path"))
    links = link_lines(entries)
    near = fn.normal_path(F.concat(F.lit(root + "/"), fn.folder(F.col("relpath")), F.lit("/"), "target"))
    links = links.withColumn("p1", near).withColumn("p2", fn.normal_path(F.concat(F.lit(root + "/"), "target")))
    lost = links.join(files.toDF("p1"), "p1", "left_anti").join(files.toDF("p2"), "p2", "left_anti")
    return lost.select("relpath", "lineno", "target", F.when(F.col("annotated"), "annotated").otherwise("broken").alias("state"))


def guard(states: DataFrame, limit: int = GUARD_BYTES, recent_s: int = RECENT_S) -> DataFrame:
    """``(session, decision)``: block once a large session has not been written down lately."""
    quiet = F.col("last_write_age_s").isNull() | (F.col("last_write_age_s") > recent_s)
    return states.select("session", F.when(~F.col("already_blocked") & (F.col("size") >= limit) & quiet, "block").otherwise("allow").alias("decision"))


def is_generated_worktree(path: F.Column) -> F.Column:
    return path.rlike(r"/\.claude/worktrees/(agent-[0-9a-f]{16,}|wf_[A-Za-z0-9-]+-[0-9]+)(/|$)")


def entry_path(path: Column) -> Column:
    """An entry's path below the folder of entries; null for a path outside it or of another kind of file."""
    below = F.regexp_extract(path, r"^(?:.*?)/\.claude/knowledge/entries/(.+\.md)$", 1)
    return F.nullif(below, F.lit(""))


def change_lines(events: DataFrame) -> DataFrame:
    """``(session, ts, line)`` of write and edit events; temporary files and the log's own files leave none."""
    cut = lambda c: F.regexp_replace(F.substring(F.coalesce(c, F.lit("")), 1, 80), "\n", " ")
    # The form of a line.
    head = lambda tool: F.concat(F.lit("- `"), F.date_format("ts", "HH:mm"), F.lit(f"` **{tool}** `"), "path", F.lit("`"))
    edit = F.concat(head("Edit"), F.lit(" — `"), cut(F.col("old")), F.lit("` → `"), cut(F.col("new")), F.lit("`"))
    line = F.when(F.col("tool") == "Write", head("Write")).when(F.col("tool") == "Edit", edit)
    own = ~F.col("path").rlike(r"^(/tmp|/dev)") & ~F.col("path").rlike(r"(^|/)context-[^/]*\.md$") & (F.col("path") != "")
    return events.where(own).select("session", "ts", line.alias("line")).where("line is not null")


def checkpoint_files(sessions_: DataFrame) -> DataFrame:
    """``(session, content)`` from ``(session, at, decisions, files, entries)``; sessions with three empty lists give no file."""

    def section(title: str, items: str) -> F.Column:
        lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
        return F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n"), lines, F.lit("\n")))

    some = sessions_.where((F.size("decisions") > 0) | (F.size("files") > 0) | (F.size("entries") > 0))
    head = F.concat(F.lit("---\ncreated: "), F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit("\nstatus: active\n---\n"))
    return some.select("session", F.concat_ws("\n", head, section("Decisions", "decisions"), section("Modified files", "files"), section("Referenced entries", "entries")).alias("content"))


def session_state(sessions_: DataFrame) -> DataFrame:
    """``(session, files, decisions)``: base names of the last three files and the first five decisions."""
    last = F.slice("files", F.greatest(F.size("files") - 2, F.lit(1)), F.lit(3))
    return sessions_.select("session", F.transform(last, lambda p: fn.file_name(p)).alias("files"), F.slice("decisions", 1, 5).alias("decisions"))


def open_day_file(files: DataFrame, day: str) -> DataFrame:
    """The day's log file to go on with: the last of ``(path, content)`` named after the day that isn't consumed."""
    own = files.where(F.contains("path", F.lit(day)) & ~F.contains(F.substring("content", 1, 200), F.lit("status: consumed")))
    return own.orderBy(F.desc("path")).limit(1).select("path")
