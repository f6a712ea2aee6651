"""A stored index of entries, chunks and vectors in hash partitions of the path, brought up to date by versions.

Layout below the index's folder::

    entries/version=V/part=K    metadata and content hash of the entries whose path falls into part K
    chunks/version=V/part=K     their chunks with vectors
    manifest/v=V                one row per part: which version holds it; and what the refresh did

A refresh compares content hashes, parses and embeds new and changed entries only, and rewrites only the parts that
hold a new, changed or removed key; all others keep their version. The manifest is written last and counts once it is
complete, so a reader sees the state before a refresh or after it, and what a failed refresh has left is overwritten by
the next. A micro-batch carries its number into the manifest, so a repeated batch changes nothing.

The driver handles one row per part, whatever the number of entries. ``parts`` is fixed when the index is made; a part
is what one task rewrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import notes
from scholia.functions.embedding import HashedWords, embedded
from scholia.operators import sync
from scholia.plans.lineage import durable

PARTS = 64
_ENTRY = "relpath string, title string, tags array<string>, status string, created string, type string, see array<string>, sha256 string"
_CHUNK = "relpath string, chunk_id string, embedding array<float>"
_MANIFEST = "part int, entries_version long, chunks_version long, batch long, indexed_at string"
STATES = ("added", "changed", "removed", "unchanged")


def content_hash(entries: DataFrame) -> DataFrame:
    return entries.select("relpath", F.sha2(notes.newlines(F.col("content")), 256).alias("sha256"))


class StoredIndex:
    """``embed`` adds an ``embedding`` to rows ``(relpath, chunk_id, text)``; chunks that it leaves out have no vector."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS, embed: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self.embed = embed or (lambda chunks: embedded(chunks, HashedWords()))

    # --- reading ---

    def part(self) -> F.Column:
        return (F.conv(F.substring(F.md5("relpath"), 1, 6), 16, 10).cast("int") % self.parts).alias("part")

    def version(self) -> int:
        """The latest version whose manifest is complete, 0 for none."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        done = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max(done, default=0)

    def manifest(self) -> DataFrame:
        v = self.version()
        return self.spark.read.parquet(f"{self.root}/manifest/v={v}") if v else self.spark.createDataFrame([], _MANIFEST)

    def _read(self, kind: str, schema: str, parts: set[int] | None = None) -> DataFrame:
        held = [(r.part, r[f"{kind}_version"]) for r in self.manifest().collect() if r[f"{kind}_version"] and (parts is None or r.part in parts)]
        if not held:
            return self.spark.createDataFrame([], f"{schema}, part int")
        paths = [f"{self.root}/{kind}/version={v}/part={p}" for p, v in held]
        return self.spark.read.schema(f"{schema}, version long, part int").option("basePath", f"{self.root}/{kind}").parquet(*paths).drop("version")

    def entries(self) -> DataFrame:
        return self._read("entries", _ENTRY).drop("part")

    def chunks(self) -> DataFrame:
        return self._read("chunks", _CHUNK).drop("part")

    # --- writing ---

    def stale(self, scanned: DataFrame) -> DataFrame:
        """``(relpath)`` of scanned entries that are new or differ from what is stored."""
        return sync.stale(content_hash(scanned), self.entries().select("relpath", "sha256"))

    def refresh(self, scanned: DataFrame, only: DataFrame | None = None, batch: int | None = None, at: str = "") -> dict[str, int]:
        """Bring the index up to date with ``(relpath, content)`` and count what happened.

        With ``only``, a table of paths, the run looks at these and removes nothing. A batch that the index has seen already
        is left alone. The counts: entries by state, ``embedded_chunks``, ``parts_written``, ``version``.
        """
        held = {r.part: r for r in self.manifest().collect()}
        seen = max([-1, *(r.batch for r in held.values() if r.batch is not None)])
        out = dict.fromkeys([*STATES, "embedded_chunks", "parts_written"], 0)
        before = self.version()
        if batch is not None and batch <= seen:
            return out | {"version": before}
        stored = self._read("entries", _ENTRY)
        diff = durable(sync.index_diff(content_hash(scanned), stored.select("relpath", "sha256"), only).select("relpath", "state", self.part()))
        for r in (by_part := diff.groupBy("part", "state").agg(F.count("*").alias("n")).collect()):
            out[r.state] += r.n
        touched = {r.part for r in by_part if r.state != "unchanged"}
        version = before + 1
        versions = {p: (r.entries_version, r.chunks_version) for p, r in held.items()}
        if touched:
            gone, news = diff.where("state <> 'unchanged'").select("relpath"), diff.where("state in ('added', 'changed')").select("relpath")
            fresh = notes.parsed(scanned.select("relpath", "content").join(news, "relpath", "left_semi"))
            made = self.embed(notes.chunks(fresh)).select("relpath", "chunk_id", F.col("embedding").cast("array<float>").alias("embedding"), self.part())
            written = {}
            for kind, schema, new in (("entries", _ENTRY, fresh.drop("body").withColumn("part", self.part())), ("chunks", _CHUNK, made)):
                old = self._read(kind, schema, touched).join(gone, "relpath", "left_anti")
                path = f"{self.root}/{kind}/version={version}"
                # Each part is one task's rows, its rows in order of the path; nothing refers to this version yet, so a leftover of a failed run may go.
                old.unionByName(new.select(*old.columns)).repartition("part").sortWithinPartitions("part", "relpath").write.mode("overwrite").partitionBy("part").parquet(path)
                rows = self.spark.read.schema(f"{schema}, part int").parquet(path)
                written[kind] = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
            out["embedded_chunks"] = self.spark.read.schema(f"{_CHUNK}, part int").parquet(f"{self.root}/chunks/version={version}").join(news, "relpath", "left_semi").count()
            out["parts_written"] = len(touched)
            versions |= {p: tuple(version if p in written[k] else None for k in ("entries", "chunks")) for p in touched}
        elif batch is None:
            return out | {"version": before}
        rows = [(p, *versions.get(p, (None, None)), batch if batch is not None else (None if seen < 0 else seen), at) for p in range(self.parts)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        return out | {"version": version}

    def refresh_stale(self, scanned: DataFrame) -> dict[str, int]:
        """What a search does first: new and changed entries are brought up to date, removed ones stay until a full refresh."""
        return self.refresh(scanned, durable(self.stale(scanned)))

    def vacuum(self) -> int:
        """Remove the manifests before the latest and all versions that it doesn't name; gives how many folders went."""
        jvm, latest, gone = self.spark.sparkContext._jvm, self.version(), 0
        named = {k: {r[f"{k}_version"] for r in self.manifest().collect()} for k in ("entries", "chunks")}
        for kind, prefix, keep in (("entries", "version=", named["entries"]), ("chunks", "version=", named["chunks"]), ("manifest", "v=", {latest})):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for s in fs.listStatus(path) if fs.exists(path) else []:
                name = s.getPath().getName()
                if name.startswith(prefix) and int(name[len(prefix) :]) not in keep:
                    gone += fs.delete(s.getPath(), True)
        return gone
