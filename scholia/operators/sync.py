"""Changes between snapshots: index upkeep, mirrors, moves, link writers and gated commits, all as plans in rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import notes as fn
from scholia.functions.privacy import leaks
from scholia.operators.graph import Graph
from scholia.plans.lineage import durable

#: Fixed value: how the banner of a replaced entry begins.
BANNER = "> **⚠ superseded"


def index_diff(scanned: DataFrame, stored: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``(relpath, state)`` of two ``(relpath, sha256)`` snapshots; a scoped run looks at ``only`` and removes nothing."""
    if only is not None:
        scanned, stored = scanned.join(only, "relpath", "left_semi"), stored.join(only, "relpath", "left_semi")
    met = scanned.select("relpath", F.col("sha256").alias("new")).join(stored.select("relpath", F.col("sha256").alias("old")), "relpath", "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    out = met.select("relpath", state.alias("state"))
    return out if only is None else out.where("state <> 'removed'")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("state").agg(F.count("*").alias("n"))


def upserted(stored: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """The stored rows after the diff: unchanged ones kept, changed and added ones from ``fresh``; the same columns."""
    touched = diff.where("state <> 'unchanged'").select("relpath")
    new = fresh.join(diff.where("state in ('added', 'changed')").select("relpath"), "relpath", "left_semi")
    return stored.join(touched, "relpath", "left_anti").unionByName(new.select(*stored.columns))


def mirror_actions(source: DataFrame, target: DataFrame, suffix: str) -> DataFrame:
    """``(path, action, to_path)`` of a copy-only mirror of ``(path, sha256)``: copy, skip or shadow; no other file is overwritten.

    A source that differs from its target goes beside it; where that shadow is there and equal, the source is skipped.
    """
    shadow = F.regexp_replace("path", r"^(.*?[^/])(\.[^./]*)?$", f"$1-from-{suffix}$2")
    there = target.select("path", F.col("sha256").alias("t"))
    met = source.select("path", F.col("sha256").alias("s"), shadow.alias("shadow")).join(there, "path", "left").join(there.toDF("shadow", "u"), "shadow", "left")
    action = F.when(F.col("t").isNull(), "copy").when((F.col("s") == F.col("t")) | F.col("s").eqNullSafe(F.col("u")), "skip").otherwise("shadow")
    return met.select("path", action.alias("action"), F.when(action == "shadow", F.col("shadow")).when(action == "copy", F.col("path")).alias("to_path"))


def migrate_plan(paths: DataFrame) -> DataFrame:
    """``(old_path, new_path)``: flat files that start with a date go to its year and month."""
    flat = paths.where(F.col("path").rlike(r"^\d{8}-[^/]*\.md$"))
    return flat.select(F.col("path").alias("old_path"), F.concat(F.substring("path", 1, 4), F.lit("/"), F.substring("path", 5, 2), F.lit("/"), "path").alias("new_path"))


def link_map(moved: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """``(name, new_path)``: where links to a base name lead after a move of ``(old_path, new_path)``.

    ``present`` ``(path)`` are files that lie in folders already: they come before planned moves of the same name. Of
    several files of one name and rank the smallest path counts.
    """
    ranked = moved.select("new_path", F.lit(1).alias("rank"))
    if present is not None:
        ranked = ranked.unionByName(present.where(F.contains("path", F.lit("/"))).select(F.col("path").alias("new_path"), F.lit(0).alias("rank")))
    return ranked.groupBy(fn.file_name(F.col("new_path")).alias("name")).agg(F.min(F.struct("rank", "new_path"))["new_path"].alias("new_path"))


def rewrite_links(entries: DataFrame, moved: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """``(relpath, content)`` with every Markdown link to a base name of ``link_map`` changed to its path there.

    Links are numbered, looked up by base name and put back between the texts around them.
    """
    link = r"\]\(([^)\s]*\.md)(#[^)]*)?\)"
    cut = entries.select("relpath", F.split("content", link, -1).alias("between"), F.regexp_extract_all("content", F.lit(link), 0).alias("found"))
    each = cut.select("relpath", F.posexplode("found").alias("i", "m")).select("relpath", "i", F.regexp_extract("m", link, 1).alias("path"), F.regexp_extract("m", link, 2).alias("anchor"))
    each = each.withColumn("name", fn.file_name(F.col("path"))).join(link_map(moved, present), "name", "left")
    links = each.groupBy("relpath").agg(F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("]("), F.coalesce("new_path", "path"), "anchor", F.lit(")")).alias("t")))).alias("links"))
    pieces = F.transform("between", lambda b, i: F.concat(b, F.coalesce(F.get("links", i)["t"], F.lit(""))))
    return cut.join(links, "relpath", "left").select("relpath", F.array_join(pieces, "").alias("content"))


def _place(text: F.Column) -> tuple[F.Column, F.Column]:
    """A text's lines and after how many of them a link goes: the last link line, else a related heading; 0 without either."""
    lines = F.split(fn.newlines(text), "\n")
    last = F.aggregate(F.transform(lines, lambda x, i: F.when(x.rlike(fn.TYPED_LINK), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    heading = F.array_position(F.transform(lines, lambda x: x.rlike(r"^##\s*(関連|Related)\s*$")), True).cast("int")
    under = F.when(F.get(lines, heading) == "", heading + 1).otherwise(heading)
    return lines, F.when(last > 0, last).when(heading > 0, under).otherwise(0)


def _with_lines(text: F.Column, added: F.Column) -> F.Column:
    lines, at = _place(text)
    after = F.when(at < F.size(lines), F.slice(lines, at + 1, F.size(lines))).otherwise(F.array(F.lit("")))
    return F.array_join(F.concat(F.slice(lines, F.lit(1), at), added, after), "\n")


def _linked(g: Graph) -> DataFrame:
    return g.edges.where("kind <> 'superseded_by'").select("src", "dst").distinct()


def link_add_plan(requests: DataFrame, g: Graph, entries: DataFrame) -> DataFrame:
    """``(src, dst, kind, ok, error, line)`` for rows ``(src, dst, kind, reason)``; ``link_texts`` makes the texts. Apply only if every row is ok.

    ``line`` is null where nothing is added: on an error, and where the target is linked already.
    """
    q = requests.join(entries.select(F.col("relpath").alias("src"), (_place(F.col("content"))[1] > 0).alias("place")), "src", "left")
    q = q.join(g.nodes.select(F.col("id").alias("dst"), F.col("title").alias("title"), F.lit(True).alias("known")), "dst", "left")
    q = q.join(_linked(g).withColumn("has", F.lit(True)), ["src", "dst"], "left")
    error = F.when(F.col("place").isNull(), "no such source").when(F.col("known").isNull(), "no such target").when(F.col("src") == F.col("dst"), "self link").when(F.col("title") == "", "target has no title").when(F.col("title").rlike(r"[\[\]]"), "target title holds brackets").when(~F.col("place") & F.col("has").isNull(), "no place for a link")
    line = F.concat(F.lit("- "), "kind", F.lit(": ["), "title", F.lit("]("), "dst", F.lit(")"), F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" — "), "reason")).otherwise(""))
    return q.select("src", "dst", "kind", error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull() & F.col("has").isNull(), line).alias("line"))


def _added(plan: DataFrame) -> DataFrame:
    """``(relpath, added)``: each source's new lines by target; of several requests for one target the first kind counts."""
    one = plan.where("line is not null").groupBy("src", "dst").agg(F.min(F.struct("kind", "line"))["line"].alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("dst", "line"))), lambda x: x["line"])
    return one.groupBy(F.col("src").alias("relpath")).agg(lines.alias("added"))


def link_texts(entries: DataFrame, plan: DataFrame) -> DataFrame:
    """``(relpath, new_text)`` of the entries that a ``link_add_plan`` changes, each with all of its new links."""
    return entries.join(_added(plan), "relpath").select("relpath", _with_lines(F.col("content"), F.col("added")).alias("new_text"))


def _back_links(requests: DataFrame, g: Graph, entries: DataFrame, reason: str) -> DataFrame:
    """The ``link_add_plan`` of the back-links that are still to be made; one that is there needs neither a title nor a place."""
    asked = requests.select(F.col("new").alias("src"), F.col("old").alias("dst"), F.lit("amends").alias("kind"), F.lit(reason).alias("reason"))
    return link_add_plan(asked.join(_linked(g), ["src", "dst"], "left_anti"), g, entries)


def supersede_plan(requests: DataFrame, g: Graph, chains: DataFrame, entries: DataFrame) -> DataFrame:
    """``(old, new, ok, error)`` for rows ``(old, new)``, repeats once: what replacing entries would run into; ``superseded_texts`` makes the texts.

    ``chains`` are the graph's successors; a replacement whose own chain leads back to the old entry closes a circle.
    Within one batch an entry is replaced once, by the smallest of its replacements, and never by one that is replaced itself.
    """
    nodes = g.nodes.select("id", "title")
    heads = fn.with_metadata(entries, "graph").select(F.col("relpath").alias("old"), (F.size("meta") > 0).alias("headed"), F.coalesce(fn.value("superseded_by"), F.lit("")).alias("has"))
    back = chains.select(F.col("id").alias("new"), F.col("successor").alias("old"), F.lit(True).alias("circle"))
    asked = requests.select("old", "new").distinct()
    links = _back_links(asked, g, entries, "").select(F.col("src").alias("new"), F.col("dst").alias("old"), F.col("error").alias("unlinked"))
    q = asked.join(nodes.toDF("old", "old_title"), "old", "left").join(nodes.toDF("new", "new_title"), "new", "left").join(heads, "old", "left").join(back, ["old", "new"], "left").join(links, ["old", "new"], "left")
    error = F.when(F.col("old_title").isNull(), "no such entry").when(F.col("new_title").isNull(), "no such replacement").when(F.col("old") == F.col("new"), "replaces itself")
    error = error.when(F.col("new_title") == "", "replacement has no title").when(F.col("new_title").rlike(r"[\[\]]"), "replacement's title holds brackets").when(F.col("circle"), "closes a circle")
    error = error.when(~F.col("headed"), "no metadata").when((F.col("has") != "") & (F.col("has") != F.col("new")), "has another successor")
    q = durable(q.select("old", "new", error.when(F.col("unlinked").isNotNull(), F.concat(F.lit("back-link: "), "unlinked")).alias("error")))
    first = q.where("error is null").groupBy("old").agg(F.min("new").alias("first"))
    q = q.join(first, "old", "left").join(first.select(F.col("old").alias("new"), F.lit(True).alias("leaves")), "new", "left")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("first") != F.col("new"), "has another successor").when(F.col("leaves"), "replacement is replaced itself")
    return q.select("old", "new", error.isNull().alias("ok"), error.alias("error"))


def _marked(text: F.Column, new: F.Column, title: F.Column, date: str) -> F.Column:
    """The text with status and successor as a pair of its metadata and a banner below it; what is there already stays."""
    end = F.locate("\n---", text, 4)
    head, rest = F.substring(text, F.lit(1), end - 1), F.substring(text, end, F.length(text))
    pair = F.array(F.lit("status: superseded"), F.concat(F.lit("superseded_by: "), new))
    kept = F.filter(F.split(head, "\n"), lambda x: ~F.startswith(x, F.lit("superseded_by:")))
    is_status = lambda x: F.startswith(x, F.lit("status:"))
    placed = F.flatten(F.transform(kept, lambda x: F.when(is_status(x), pair).otherwise(F.array(x))))
    stated = (fn.value("status") == "superseded") & (fn.value("superseded_by") == new)
    head = F.when(stated, head).otherwise(F.array_join(F.when(F.exists(kept, is_status), placed).otherwise(F.concat(kept, pair)), "\n"))
    line_end = F.locate("\n", rest, 2)
    closing = F.when(line_end > 0, F.substring(rest, F.lit(1), line_end)).otherwise(F.concat(rest, F.lit("\n")))
    body = F.when(line_end > 0, F.substring(rest, line_end + 1, F.length(rest))).otherwise("")
    banner = F.concat(F.lit(f"\n{BANNER} ({date})** — current: ["), title, F.lit("]("), new, F.lit(")\n"))
    return F.concat(head, closing, F.when(F.contains(text, F.lit(BANNER)), "").otherwise(banner), body)


def superseded_texts(plan: DataFrame, g: Graph, entries: DataFrame, date: str, reason: str = "") -> DataFrame:
    """``(relpath, new_text)`` of the entries that a ``supersede_plan`` changes: replaced ones marked, replacements linked back.

    A piece that is there already is left alone, so a plan applied in part can be applied again, and one applied whole gives no rows.
    """
    good = plan.where("ok").select("old", "new")
    marks = good.join(g.nodes.select(F.col("id").alias("new"), "title"), "new").select(F.col("old").alias("relpath"), F.col("new").alias("successor"), F.col("title").alias("successor_title"))
    rows = entries.select("relpath", fn.newlines(F.col("content")).alias("content")).join(marks, "relpath", "left").join(_added(_back_links(good, g, entries, reason)), "relpath", "left")
    rows = fn.with_metadata(rows.where("successor is not null or added is not null"), "graph")
    rows = rows.withColumn("text", F.when(F.col("successor").isNotNull(), _marked(F.col("content"), F.col("successor"), F.col("successor_title"), date)).otherwise(F.col("content")))
    rows = rows.withColumn("text", F.when(F.col("added").isNotNull(), _with_lines(F.col("text"), F.col("added"))).otherwise(F.col("text")))
    return rows.where("text <> content").select("relpath", F.col("text").alias("new_text"))


def commit_decision(gates: DataFrame) -> DataFrame:
    """``(repo, result)`` by ordered gates (enabled, in_tree, busy, n_changes, n_findings, mode)."""
    blocked = (F.col("n_findings") > 0) & (F.col("mode") == "block")
    result = F.when(~F.col("enabled"), "disabled").when(~F.col("in_tree"), "not_a_repo").when(F.col("busy"), "in_progress").when(F.col("n_changes") == 0, "no_changes").when(blocked, "blocked").otherwise("committed")
    return gates.select("repo", result.alias("result"))


def commit_message(changes: DataFrame) -> DataFrame:
    """``(repo, message)``: the first ten paths, in order, by their last two parts, and how many more there are."""
    paths = changes.select("repo", "path").distinct()
    first = paths.withColumn("nth", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).where("nth <= 10")
    parts = F.split("path", "/")
    short = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")
    named = first.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("nth", short.alias("name")))).alias("p"))
    more = F.when(F.col("n") > 10, F.concat(F.lit(" …and "), F.col("n") - 10, F.lit(" more"))).otherwise("")
    counts = paths.groupBy("repo").agg(F.count("*").alias("n"))
    return named.join(counts, "repo").select("repo", F.concat(F.array_join(F.transform("p", lambda x: x["name"]), ", "), more).alias("message"))


#: Equal files are numbered within so many parts of their paths, so that no task has to number all copies of one file.
COPY_PARTS = 64


def _nth_copy(files: DataFrame) -> DataFrame:
    """``files`` ``(path, sha256)`` with ``nth``, their number among those of equal content: by a hash of the path, then the path."""
    dealt = files.withColumn("deal", F.conv(F.substring(F.md5("path"), 1, 4), 16, 10).cast("int") % COPY_PARTS)
    counts = dealt.groupBy("sha256", "deal").agg(F.count("*").alias("n"))
    # At most COPY_PARTS rows of one content.
    above = counts.select("sha256", "deal", (F.sum("n").over(Window.partitionBy("sha256").orderBy("deal")) - F.col("n")).alias("above"))
    within = F.row_number().over(Window.partitionBy("sha256", "deal").orderBy("path"))
    return dealt.join(above, ["sha256", "deal"]).select("path", "sha256", (F.col("above") + within).alias("nth"))


def change_set(before: DataFrame, after: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """``(path, status, other)`` of two snapshots ``(path, sha256)`` of a tree, one row per path that changed.

    Status ``A``, ``M`` or ``D``; a removed and an added file of equal content are a rename, both rows ``R`` with each
    other's path in ``other``. Of several equal files the nth removed one goes with the nth added one; what is left over
    stays removed or added. Renames are told over the whole tree; then only paths with one of ``prefixes`` are kept.
    """
    met = before.select("path", F.col("sha256").alias("old")).join(after.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    met = durable(met.where(~F.col("old").eqNullSafe(F.col("new"))))
    lost, came = (_nth_copy(met.where(f"{gone} is null").select("path", F.col(has).alias("sha256"))) for gone, has in (("new", "old"), ("old", "new")))
    pairs = durable(lost.withColumnRenamed("path", "a").join(came.withColumnRenamed("path", "b"), ["sha256", "nth"]).select("a", "b"))
    partner = pairs.select(F.col("a").alias("path"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("path"), F.col("a").alias("other")))
    status = F.when(F.col("other").isNotNull(), "R").when(F.col("new").isNull(), "D").when(F.col("old").isNull(), "A").otherwise("M")
    out = met.join(partner, "path", "left").select("path", status.alias("status"), "other")
    return out if prefixes is None else out.where(F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("path"), p)))


def commit_plan(changes: DataFrame, files: DataFrame, mode: Column) -> DataFrame:
    """``(repo, n_changes, n_findings, result, message)`` from a change set with its ``repo`` and the tree's ``(path, content)``.

    Findings are those of a leak scan over changed files that are there. ``mode`` tells from ``repo`` whether they block.
    Repositories without changes have no row.
    """
    paths = changes.select("repo", "path").distinct()
    scanned = files.join(paths, "path").select(F.concat_ws("\n", "repo", "path").alias("relpath"), "content")
    findings = leaks(scanned).groupBy(F.substring_index("relpath", "\n", 1).alias("repo")).agg(F.count("*").alias("n_findings"))
    gates = paths.groupBy("repo").agg(F.count("*").alias("n_changes")).join(findings, "repo", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))
    gates = durable(gates.select("*", mode.alias("mode"), F.lit(True).alias("enabled"), F.lit(True).alias("in_tree"), F.lit(False).alias("busy")))
    return gates.select("repo", "n_changes", "n_findings").join(commit_decision(gates), "repo").join(commit_message(changes), "repo")


def stale(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """``(relpath)`` of new and changed entries: what a refresh at query time has to bring up to date."""
    return index_diff(scanned, stored).where("state in ('added', 'changed')").select("relpath")


def replace_section(text: F.Column, heading: str, body: F.Column) -> F.Column:
    """The text with the lines under ``## heading``, up to the next ``## ``, replaced; the section is appended if absent."""
    head = "## " + heading
    lines = F.split(text, "\n")
    at = F.array_position(lines, head).cast("int")
    rest = F.slice(lines, at + 1, F.size(lines))
    after = F.array_position(F.transform(rest, lambda x: F.startswith(x, F.lit("## "))), True).cast("int")
    tail = F.when(after > 0, F.concat(F.lit("\n"), F.array_join(F.slice(rest, after, F.size(rest)), "\n"))).otherwise("")
    return F.when(at > 0, F.concat(F.array_join(F.slice(lines, F.lit(1), at), "\n"), F.lit("\n\n"), body, F.lit("\n"), tail)).otherwise(F.concat(F.regexp_replace(text, r"\n+$", ""), F.lit(f"\n\n{head}\n\n"), body, F.lit("\n")))
