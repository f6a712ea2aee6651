"""The typed link graph of the notes: build, degrees, breadth-first search, lineage and lint."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import notes
from scholia.operators.components import connected_components
from scholia.plans.lineage import durable

#: Where the entries are taken to lie; the repository's root is three folders up.
ROOT = "/base/a/b/entries"
#: The two line forms of the tag registry.
REGISTRY = (r"(?mU)^- (#[\w\-]+)", r"(?mU)^`(#[\w\-]+)`$")


@dataclass
class Graph:
    """nodes (id, title, tags, status), edges (src, dst, kind, resolution, pos), problems (id, check, detail)."""

    nodes: DataFrame
    edges: DataFrame
    problems: DataFrame

    def inner_edges(self) -> DataFrame:
        """Edges whose both ends are nodes."""
        ids = self.nodes.select("id")
        return self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def read(entries: DataFrame, *kept: str) -> DataFrame:
    """``(id, title, tags, status, successor, links, malformed)``: what ``build`` takes from the entries' texts; columns ``kept`` stay."""
    rows = notes.with_metadata(entries, "graph")
    text = lambda k: F.coalesce(notes.value(k), F.lit(""))
    lines = F.split(notes.newlines(F.col("content")), "\n")
    bad = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda p: p["text"].rlike(notes.LOOSE_LINK) & ~p["text"].rlike(notes.TYPED_LINK))
    return rows.select(
        F.col("relpath").alias("id"), text("title").alias("title"), F.array_distinct(notes.tags("graph")).alias("tags"), text("status").alias("status"), text("superseded_by").alias("successor"),
        notes.typed_links(F.col("content")).alias("links"), bad.alias("malformed"), *kept,
    )


def _resolved(rows: DataFrame, root: str, other_files: list[str] | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Named successors, links, those of them that lead to files, and edges with repeats, from the rows of ``read``."""
    base = F.lit(root + "/")
    files = rows.select(F.concat(base, "id").alias("path"))
    if other_files:
        files = files.unionByName(rows.sparkSession.createDataFrame([(f"{root}/{p}",) for p in other_files], "path string"))

    def at(target: F.Column, folder: F.Column) -> F.Column:
        return notes.normal_path(F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, F.lit("/"), target)))

    inside = lambda p: F.startswith(p, base)
    relative = lambda p: F.substring(p, F.lit(len(root) + 2), F.length(p))

    # Successors resolve from the root only.
    named = rows.where("successor <> ''").withColumn("path", at(notes.strip(F.substring_index("successor", "#", 1)), F.lit(root)))
    named = named.join(files.withColumn("there", F.lit(True)), "path", "left").withColumn("good", F.coalesce("there", F.lit(False)) & inside(F.col("path"))).withColumn("dst", relative(F.col("path")))
    after = named.where("good and dst <> id").select(F.col("id").alias("src"), "dst", F.lit("superseded_by").alias("kind"), F.lit("frontmatter").alias("resolution"), F.lit(0).alias("pos"))

    web = lambda t: F.startswith(t, F.lit("http://")) | F.startswith(t, F.lit("https://"))
    links = rows.select("id", F.posexplode("links").alias("pos", "link")).select("id", (F.col("pos") + 1).alias("pos"), "link.kind", "link.target").where((F.col("target") != "") & ~web(F.col("target")))
    links = links.withColumn("p1", at(F.col("target"), F.lit(root))).withColumn("p2", at(F.col("target"), F.concat(base, notes.folder(F.col("id")))))
    links = links.join(files.select(F.col("path").alias("p1"), F.lit(True).alias("f1")), "p1", "left").join(files.select(F.col("path").alias("p2"), F.lit(True).alias("f2")), "p2", "left")
    links = durable(links.select("id", "pos", "kind", "target", "p1", "p2", F.when(F.col("f1"), F.col("p1")).when(F.col("f2"), F.col("p2")).alias("path"), F.when(F.col("f1"), "root").otherwise("fallback").alias("resolution")))
    met = links.where(F.col("path").isNotNull() & inside(F.col("path"))).withColumn("dst", relative(F.col("path")))
    listed = met.where("dst <> id").select(F.col("id").alias("src"), "dst", "kind", "resolution", "pos")
    nth = F.row_number().over(Window.partitionBy("src", "dst", "kind").orderBy("pos"))
    all_edges = after.unionByName(listed).withColumn("nth", nth)
    return named, links, met, durable(all_edges)


def edges(rows: DataFrame, root: str = ROOT, other_files: list[str] | None = None) -> DataFrame:
    """The edges that ``build`` finds, from kept rows of ``read`` alone."""
    return _resolved(rows, root, other_files)[-1].where("nth = 1").drop("nth")


def build(entries: DataFrame, root: str = ROOT, other_files: list[str] | None = None) -> Graph:
    """Nodes, resolved and deduplicated edges, and findings. ``other_files``: paths below the root that exist but are no entries."""
    rows = durable(read(entries))
    nodes = rows.select("id", "title", "tags", "status")
    named, links, met, all_edges = _resolved(rows, root, other_files)

    repo = root.rsplit("/", 3)[0] + "/"
    lost = links.where("path is null").withColumn("near", F.startswith("p1", F.lit(repo)) | F.startswith("p2", F.lit(repo)))
    finding = lambda df, check, detail: df.select("id", (F.lit(check) if isinstance(check, str) else check).alias("check"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    problems = [
        finding(rows.where("title = ''"), "missing-title", "no frontmatter title"),
        finding(rows.where(~notes.file_name(F.col("id")).rlike(notes.FILE_NAME)), "filename", "does not match <date>-<time>-...-<slug>.md"),
        finding(rows.select("id", F.explode("malformed").alias("m")), "malformed-link", F.concat(F.lit("line "), "m.line", F.lit(": does not parse as a link, no edge produced: "), F.substring(notes.strip(F.col("m.text")), 1, 80))),
        finding(rows.where("successor <> '' and status <> 'superseded'"), "superseded-status-mismatch", F.concat(F.lit("superseded_by present but status is '"), F.when(F.col("status") == "", "(none)").otherwise(F.col("status")), F.lit("'"))),
        finding(named.where("not good"), "superseded-broken", F.concat(F.lit("superseded_by: ("), "successor", F.lit(") resolves to no entry"))),
        finding(named.where("good and dst = id"), "self-link", "superseded_by: links to itself"),
        finding(rows.where("successor = '' and status = 'superseded'"), "superseded-missing-successor", "status: superseded but no superseded_by"),
        finding(lost, F.when(F.col("near"), "broken-link").otherwise("out-of-tree"), F.concat("kind", F.lit(": ("), "target", F.lit(") resolves to no file"))),
        finding(met.where("dst = id"), "self-link", F.concat("kind", F.lit(": links to itself"))),
        finding(all_edges.where("nth > 1").withColumnRenamed("src", "id"), "duplicate-link", F.concat("kind", F.lit(": ("), "dst", F.lit(") listed more than once"))),
    ]
    found = problems[0]
    for p in problems[1:]:
        found = found.unionByName(p)
    return Graph(nodes, all_edges.where("nth = 1").drop("nth"), found)


def edge_kinds(g: Graph) -> DataFrame:
    return g.edges.groupBy("kind").agg(F.count("*").alias("n"))


def degrees(g: Graph) -> DataFrame:
    """``(id, n_out, n_in, degree)`` of every node; parallel edges of several kinds count each."""
    e = g.inner_edges()
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    ends = ends.unionByName(g.nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"), (F.sum("o") + F.sum("i")).alias("degree"))


def hubs(g: Graph, top: int = 10) -> DataFrame:
    return degrees(g).orderBy(F.desc("degree"), "id").limit(top)


def orphans(g: Graph) -> DataFrame:
    return degrees(g).where("degree = 0").select("id")


def components(g: Graph) -> DataFrame:
    """``(id, component)`` of every node; a component is named by its smallest id."""
    found = connected_components(g.inner_edges().select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return g.nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def resolve(g: Graph, query: str) -> str:
    """The node with this id, or the only one whose id contains the text."""
    hits = [r.id for r in g.nodes.where(F.contains("id", F.lit(query))).orderBy(F.col("id") != query, "id").limit(11).collect()]
    if hits and (hits[0] == query or len(hits) == 1):
        return hits[0]
    raise LookupError(f"no entry matches '{query}'" if not hits else f"ambiguous query '{query}': " + ", ".join(hits[:10]))


def _both_ways(g: Graph) -> DataFrame:
    e = durable(g.inner_edges())
    out = e.select(F.col("src").alias("at"), F.col("dst").alias("other"), F.lit("→").alias("dir"), "kind", F.struct(F.lit(0).alias("d"), "src", "pos").alias("turn"))
    return out.unionByName(e.select(F.col("dst").alias("at"), F.col("src").alias("other"), F.lit("←").alias("dir"), "kind", F.struct(F.lit(1).alias("d"), "src", "pos").alias("turn")))


def search_from(g: Graph, start: str, depth: int | None = None, target: str | None = None) -> DataFrame:
    """Breadth-first rows ``(depth, from, dir, kind, id)``, each node at its first visit; the start has no row.

    Nodes are visited in the order of a queue: parents first, then out-edges before in-edges, edges by source and place.
    """
    steps = _both_ways(g)
    empty = F.array().cast("array<struct<d:int,src:string,pos:int>>")
    seen = g.nodes.where(F.col("id") == start).select(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("dir"), F.lit(None).cast("string").alias("kind"), "id", empty.alias("turn"))
    seen = durable(seen)
    level = 0
    while depth is None or level < depth:
        front = seen.where(F.col("depth") == level)
        met = front.select(F.col("id").alias("at"), F.col("turn").alias("before")).join(steps, "at").join(seen.select(F.col("id").alias("other")), "other", "left_anti")
        first = F.min(F.struct(F.array_append("before", F.col("turn")).alias("turn"), "at", "dir", "kind"))
        fresh = met.groupBy("other").agg(first.alias("f"))
        level += 1
        fresh = durable(fresh.select(F.lit(level).alias("depth"), F.col("f.at").alias("from"), "f.dir", "f.kind", F.col("other").alias("id"), "f.turn"))
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        if target is not None and not fresh.where(F.col("id") == target).isEmpty():
            break
    return seen.where("depth > 0").drop("turn")


def neighborhood(g: Graph, start: str, depth: int = 1) -> DataFrame:
    return search_from(g, start, depth)


def shortest_path(g: Graph, a: str, b: str) -> DataFrame:
    """``(hop, from, dir, kind, to)`` along one shortest undirected path; no rows where a is b or b can't be reached."""
    found = durable(search_from(g, a, target=b))
    walk, now = [], b
    while now != a:
        row = found.where(F.col("id") == now).first()
        if row is None:
            walk = []
            break
        walk.append((row["depth"], row["from"], row["dir"], row["kind"], now))
        now = row["from"]
    return found.sparkSession.createDataFrame(sorted(walk), "hop int, from string, dir string, kind string, to string")


def successors(g: Graph) -> DataFrame:
    """``(id, step, successor)``: each entry's chain of replacements, up to its end or before it repeats.

    An entry has at most one replacement, so what is known of its first steps is put together with what is known
    of the entry where they end: the steps known double each round, until no chain goes on.
    """
    known = durable(g.edges.where("kind = 'superseded_by'").select(F.col("src").alias("id"), F.lit(1).alias("step"), F.col("dst").alias("successor")))
    steps = 1
    while True:
        ends = known.where(F.col("step") == steps).select("id", F.col("successor").alias("at"))
        if ends.isEmpty():
            return known
        further = ends.join(known.select(F.col("id").alias("at"), "step", "successor"), "at").where("successor <> id")
        further = further.select("id", (F.col("step") + steps).alias("step"), "successor").join(known, ["id", "successor"], "left_anti")
        known = durable(known.unionByName(further))
        steps *= 2


def _doubled(links: DataFrame) -> DataFrame:
    """``(id, ptr, root, dist, n)`` for links ``(id, next)``, at most one per id, over the ids at either end.

    Each round an entry takes over what its pointer's entry knows, so pointers reach twice as far: ``root`` is the last
    entry reached, ``dist`` the links walked, ``n`` the entries that walk into this one, itself included. One row per entry
    is kept, and the number of rounds is the logarithm of the longest chain. Rounds end once no pointer is left, or as many
    as the round before: then those left run into a circle, since a longer chain would have ended some of its pointers.
    """
    ids = links.select("id").union(links.select("next")).distinct()
    now = ids.join(links, "id", "left").select("id", F.col("next").alias("ptr"), F.coalesce("next", "id").alias("root"), F.col("next").isNotNull().cast("long").alias("dist"), F.lit(1).cast("long").alias("n"))
    now, before = durable(now), -1
    while (left := now.where("ptr is not null").count()) not in (0, before):
        before = left
        ahead = now.select(F.col("id").alias("ptr"), F.col("ptr").alias("p"), F.col("root").alias("r"), F.col("dist").alias("d"))
        into = now.where("ptr is not null").groupBy(F.col("ptr").alias("id")).agg(F.sum("n").alias("more"))
        step = now.join(ahead, "ptr", "left").join(into, "id", "left")
        now = durable(step.select("id", F.col("p").alias("ptr"), F.coalesce("r", "root").alias("root"), (F.col("dist") + F.coalesce("d", F.lit(0))).alias("dist"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    return now


def _circled(links: DataFrame, into: DataFrame) -> DataFrame:
    """``(id, next, circle)`` for the members of circles; ``into`` are the links of entries that run into one, ``circle`` is its smallest id."""
    far, steps, n = durable(into.select("id", F.col("next").alias("ptr"))), 1, into.count()
    # After as many steps as there are entries every walk is on its circle, and every member is where some walk stands.
    while steps < n:
        far = durable(far.join(far.select(F.col("id").alias("ptr"), F.col("ptr").alias("p")), "ptr").select("id", F.col("p").alias("ptr")))
        steps *= 2
    on = durable(links.join(far.select(F.col("ptr").alias("id")).distinct(), "id", "left_semi"))
    least, steps, n = durable(on.select("id", F.col("next").alias("ptr"), F.least("id", "next").alias("low"))), 1, on.count()
    while steps < n:
        ahead = least.select(F.col("id").alias("ptr"), F.col("ptr").alias("p"), F.col("low").alias("l"))
        least = durable(least.join(ahead, "ptr").select("id", F.col("p").alias("ptr"), F.least("low", "l").alias("low")))
        steps *= 2
    return durable(on.join(least.select("id", F.col("low").alias("circle")), "id"))


def _replacements(g: Graph) -> DataFrame:
    return durable(g.edges.where("kind = 'superseded_by' and src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("next")).distinct())


def _circles(links: DataFrame, walked: DataFrame) -> DataFrame | None:
    into = durable(links.join(walked.where("ptr is not null").select("id"), "id", "left_semi"))
    return None if into.isEmpty() else _circled(links, into)


def chains(g: Graph) -> DataFrame:
    """``(id, current, n_ancestors)``: the last entry of each entry's chain before it repeats, and how many entries lead to it.

    Only one row per entry is kept, however long the chains are: circles are found first and opened, what is left is a
    forest whose roots are ends of chains and members of circles.
    """
    links = _replacements(g)
    walked = _doubled(links)
    circles = _circles(links, walked)
    if circles is None:
        found = walked.select("id", F.col("root").alias("current"), (F.col("n") - 1).alias("older"))
    else:
        on = circles.select(F.col("id").alias("root"), "circle")
        open_ = _doubled(links.join(circles.select("id"), "id", "left_anti"))
        trees = links.select("id").union(links.select("next")).distinct().join(open_, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.coalesce("n", F.lit(1)).alias("n"))
        trees = durable(trees.join(on, "root", "left"))
        whole = trees.where("id = root and circle is not null").groupBy("circle").agg(F.sum("n").alias("all"))
        # A walk goes round its circle to the entry before the one where it came in.
        last = circles.select(F.col("next").alias("root"), F.col("id").alias("last"))
        joined = trees.join(whole, "circle", "left").join(last, "root", "left")
        older = F.when((F.col("id") == F.col("root")) & F.col("circle").isNotNull(), F.col("all") - 1).otherwise(F.col("n") - 1)
        found = joined.select("id", F.coalesce("last", "root").alias("current"), older.alias("older"))
    return g.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("current", "id").alias("current"), F.coalesce("older", F.lit(0)).alias("n_ancestors"))


def current(g: Graph) -> DataFrame:
    """``(id, current)``: the last entry of each entry's chain, itself without one."""
    return chains(g).select("id", "current")


def ancestors(g: Graph) -> DataFrame:
    """``(id, ancestor)``: entries that this one replaced, step by step."""
    return successors(g).select(F.col("successor").alias("id"), F.col("id").alias("ancestor"))


def cycles(g: Graph) -> DataFrame:
    """``(id, cycle)`` for every member of a circle of replacements; the circle is written from its smallest id."""
    links = _replacements(g)
    circles = _circles(links, _doubled(links))
    if circles is None:
        return g.nodes.select("id", F.lit("").alias("cycle")).limit(0)
    # Opened behind its smallest id, a circle is a chain: the way that is left to that id gives each member its place.
    left = _doubled(circles.where("id <> circle").select("id", "next")).select("id", "dist")
    placed = circles.join(left, "id").groupBy("circle").agg(F.array_sort(F.collect_list(F.struct((-F.when(F.col("id") != F.col("circle"), F.col("dist"))).alias("place"), "id"))).alias("path"))
    path = F.concat(F.array("circle"), F.filter(F.transform("path", lambda x: x["id"]), lambda i: i != F.col("circle")))
    return placed.select(path.alias("path")).select(F.explode("path").alias("id"), F.array_join(F.array_append("path", F.col("path")[0]), " → ").alias("cycle"))


def would_cycle(g: Graph, old: str, new: str) -> bool:
    """Whether replacing ``old`` by ``new`` would close a circle."""
    return old == new or not successors(g).where((F.col("id") == new) & (F.col("successor") == old)).isEmpty()


def registry_tags(text: str, spark) -> DataFrame:
    one = spark.range(1).select(F.lit(text).alias("t"))
    both = [one.select(F.explode(F.regexp_extract_all("t", F.lit(p), 1)).alias("tag")) for p in REGISTRY]
    return both[0].union(both[1]).distinct()


def lint(g: Graph, registry: DataFrame | None = None, only_names: list[str] | None = None) -> DataFrame:
    """All findings ``(id, check, detail)``; with ``only_names`` those of entries with these file names."""
    found = g.problems.unionByName(cycles(g).select("id", F.lit("supersede-cycle").alias("check"), F.col("cycle").alias("detail")))
    if registry is not None:
        used = g.nodes.select("id", F.explode("tags").alias("tag")).join(registry, "tag", "left_anti")
        unknown = used.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("t"))
        found = found.unionByName(unknown.select("id", F.lit("unknown-tag").alias("check"), F.concat(F.lit("not in registry: "), "t").alias("detail")))
    if only_names:
        found = found.where(notes.file_name(F.col("id")).isin([n.rsplit("/", 1)[-1] for n in only_names]))
    return found


def stats(g: Graph) -> DataFrame:
    """``(metric, name, value)``: nodes, edges, edges by kind, hubs, number of orphans and component sizes."""
    row = lambda df, metric, name, value: df.select(F.lit(metric).alias("metric"), name.alias("name"), value.cast("long").alias("value"))
    none = F.lit("")
    sizes = components(g).groupBy("component").agg(F.count("*").alias("n"))
    parts = [
        row(g.nodes.agg(F.count("*").alias("n")), "nodes", none, F.col("n")), row(g.edges.agg(F.count("*").alias("n")), "edges", none, F.col("n")),
        row(edge_kinds(g), "kind", F.col("kind"), F.col("n")), row(hubs(g), "hub", F.col("id"), F.col("degree")),
        row(orphans(g).agg(F.count("*").alias("n")), "orphans", none, F.col("n")), row(sizes, "component", F.col("component"), F.col("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias("json"))
