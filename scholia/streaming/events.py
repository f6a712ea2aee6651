"""Structured Streaming forms: index upkeep by micro-batch, ordered handling of writes, and the size guard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scholia.functions import notes, privacy
from scholia.operators import sessions, sync
from scholia.plans.index import StoredIndex
from scholia.plans.lineage import durable


def index_upkeep(load: Callable[[], DataFrame | None], store: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that brings an index up to date with a micro-batch of ``(relpath, content)``.

    Only new and changed entries are parsed and written; a batch is a scoped run, so it removes nothing. ``load``
    gives the stored index and ``store`` writes the next version, which makes a repeated batch harmless. Of several
    versions of a note in one batch the one with the largest ``modified_at`` counts, if there is such a column, then the largest text.
    """

    def run(batch: DataFrame, number: int) -> None:
        place = [c for c in ("modified_at", "content") if c in batch.columns]
        fresh = notes.parsed(batch.groupBy("relpath").agg(F.max(F.struct(*place))["content"].alias("content")))
        stored = load()
        if stored is None:
            store(fresh, number)
            return
        diff = sync.index_diff(fresh.select("relpath", "sha256"), stored.select("relpath", "sha256"), fresh.select("relpath"))
        store(sync.upserted(stored, fresh, diff), number)

    return run


def stored_index_upkeep(index: StoredIndex, report: Callable[[int, dict], None] | None = None) -> Callable[[DataFrame, int], None]:
    """As index_upkeep, for a stored index: a batch rewrites only the parts of its changed keys, and a repeated batch nothing.

    ``report`` gets each batch's number and counts.
    """

    def run(batch: DataFrame, number: int) -> None:
        place = [c for c in ("modified_at", "content") if c in batch.columns]
        last = durable(batch.groupBy("relpath").agg(F.max(F.struct(*place))["content"].alias("content")))
        counts = index.refresh(last, last.select("relpath"), number)
        if report:
            report(number, counts)

    return run


def write_event_stages(entries: DataFrame) -> dict[str, DataFrame]:
    """What follows a write, in order: redaction, leak scan of the redacted text, link check."""
    clean = privacy.redact(entries).select("relpath", F.col("text").alias("content"), "hits")
    return {"redacted": clean, "leaks": privacy.leaks(clean), "links": sessions.link_check(clean.select("relpath", "content"))}


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``(start, event_type, n)`` per window of event time; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


#: Events of one moment: writes come first, then smaller ones.
_PLACE = ("us", "kind", "bytes")


def _measured(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "write", "write").otherwise("grow")
    return events.where("session is not null and ts is not null").select("session", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), kind.alias("kind"), F.coalesce(F.col("bytes").cast("long"), F.lit(0)).alias("bytes"))


def first_blocks(events: DataFrame, limit: int = sessions.GUARD_BYTES, recent_s: int = sessions.RECENT_S) -> DataFrame:
    """``(session, ts, size, n_events)``: where each session is blocked, once: the first event at which its bytes so far reach the limit while no write is recent.

    ``events``: (session, ts, kind, bytes), kind ``write`` or else growth. Events of one moment are taken writes first, then by
    bytes. Rows without a session or a time say nothing; null bytes are 0.
    """
    so_far = Window.partitionBy("session").orderBy("us", F.desc("kind"), "bytes").rowsBetween(Window.unboundedPreceding, 0)
    rows = _measured(events).withColumn("size", F.sum("bytes").over(so_far)).withColumn("wrote", F.max(F.when(F.col("kind") == "write", F.col("us"))).over(so_far)).withColumn("n_events", F.count("*").over(so_far))
    due = rows.where((F.col("size") >= limit) & (F.col("wrote").isNull() | (F.col("us") - F.col("wrote") > recent_s * 1_000_000)))
    return due.groupBy("session").agg(F.min_by(F.struct("ts", "size", "n_events"), "n_events").alias("b")).select("session", "b.*")


def guard_stream(events: DataFrame, limit: int = sessions.GUARD_BYTES, recent_s: int = sessions.RECENT_S, late: str = "10 minutes", keep_s: int = 30 * 86400) -> DataFrame:
    """``first_blocks`` of a stream, whatever the order in which events come: ``(session, ts, decision, size, n_events)``.

    Events wait in the session's state until the watermark (``late`` behind the newest event) has passed them and are then
    taken by time; later ones are dropped, so the result is ``first_blocks`` of all events that came in time. A timer at the first
    waiting event takes it up without further events of its session. A session without events for ``keep_s`` is forgotten.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, last, blocked, n, seen, *lists = state.get if state.exists else (0, None, False, 0, 0, [], [], [])
        waiting = list(zip(*lists, strict=True))
        for part in parts:
            waiting += [(int(u), k, int(b)) for u, k, b in part[list(_PLACE)].itertuples(index=False)]
        mark = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda e: (e[0], e[1] != "write", e[2]))
        seen = max([seen, *(e[0] for e in waiting)])
        ready = sum(e[0] <= mark * 1000 for e in waiting)
        out = []
        for us, kind, grown in waiting[:ready]:
            last, size, n = us if kind == "write" else last, size + grown, n + 1
            if not blocked and size >= limit and (last is None or us - last > recent_s * 1_000_000):
                blocked = True
                out.append((key[0], us, "block", size, n))
        waiting = waiting[ready:]
        if waiting or seen // 1000 + keep_s * 1000 > mark:
            state.update((size, last, blocked, n, seen, *([e[i] for e in waiting] for i in range(3))))
            state.setTimeoutTimestamp(max(mark, waiting[0][0] // 1000 if waiting else seen // 1000 + keep_s * 1000) + 1)
        else:
            state.remove()
        yield pd.DataFrame(out, columns=["session", "us", "decision", "size", "n_events"])

    held = "size long, last long, blocked boolean, n long, seen long, us array<long>, kinds array<string>, sizes array<long>"
    # The session's type is kept as text, since a state's key may be of any.
    rows = _measured(events.withColumn("session", F.col("session").cast("string")).withWatermark("ts", late))
    blocks = rows.groupBy("session").applyInPandasWithState(step, "session string, us long, decision string, size long, n_events long", held, "append", GroupStateTimeout.EventTimeTimeout)
    return blocks.select("session", F.timestamp_micros("us").alias("ts"), "decision", "size", "n_events")


def event_source(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of write and edit events ``(session, ts, tool, path, old, new, content)`` from files of JSON objects, one a line.

    A line that is no JSON object, names another tool or no path gives no row. An event without ``timestamp`` has its file's time.
    """
    said = F.from_json("value", "session_id string, timestamp string, tool_name string, tool_input struct<file_path:string,old_string:string,new_string:string,content:string>")
    rows = spark.readStream.text(folder).select(said.alias("e"), F.col("_metadata.file_modification_time").alias("filed"))
    kept = rows.where("e.tool_name in ('Write', 'Edit') and e.tool_input.file_path <> ''")
    at = F.coalesce(F.try_to_timestamp("e.timestamp"), "filed")
    return kept.select(F.col("e.session_id").alias("session"), at.alias("ts"), F.col("e.tool_name").alias("tool"), F.col("e.tool_input.file_path").alias("path"), F.col("e.tool_input.old_string").alias("old"), F.col("e.tool_input.new_string").alias("new"), F.col("e.tool_input.content").alias("content"))


class WriteStages:
    """What follows writes, as sinks of one stream in a fixed order: ``redacted``, then ``log``, then ``links``.

    Each stage writes its rows of a batch to a folder of the batch's number, replacing what an attempt before has left, and only
    then the next one begins. A batch that broke off is repeated as a whole by the stream, so no stage holds rows twice, and none is
    ahead of the one before it. Links are checked against all entries redacted so far, which the first stage has stored.
    """

    STAGES = ("redacted", "log", "links")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def __call__(self, batch: DataFrame, number: int) -> None:
        """A foreachBatch function over rows of ``event_source``; of several writes of an entry in a batch the last counts, then the largest text."""
        events = durable(batch)
        entries = events.where("content is not null").withColumn("relpath", sessions.entry_path(F.col("path"))).where("relpath is not null")
        last = entries.groupBy("relpath").agg(F.max(F.struct("ts", "content"))["content"].alias("content"))
        self._store("redacted", number, privacy.redact(last).select("relpath", F.col("text").alias("content"), "hits"))
        self._store("log", number, sessions.change_lines(events))
        own = self._folder("redacted", number)
        fresh = self.spark.read.parquet(own).select("relpath", "content")
        self._store("links", number, sessions.link_check(fresh, files=self.read("redacted").select("relpath").distinct()))

    def _folder(self, stage: str, number: int) -> str:
        return f"{self.root}/{stage}/batch={number}"

    def _store(self, stage: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._folder(stage, number))

    def read(self, stage: str) -> DataFrame:
        """All rows of a stage with their ``batch``."""
        return self.spark.read.parquet(f"{self.root}/{stage}")

    def start(self, events: DataFrame, checkpoint: str):
        """Handle all events that are there, going on after the last whole batch; the started stream."""
        return events.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
