import pytest
from pyspark.sql import functions as F

from scholia.operators import search, sync
from scholia.plans.index import StoredIndex
from scholia.streaming import events

TEXT = "---\ntitle: {0}\ntags: #a\nstatus: active\n---\n\nbody of {0}\n"


def rows(spark, **texts):
    return spark.createDataFrame([(f"{k}.md", v) for k, v in texts.items()] or [], "relpath string, content string")


def held(index):
    return {r.relpath: r.sha256 for r in index.entries().collect()}


def test_only_parts_of_changed_keys_are_rewritten(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"), parts=8)
    assert index.version() == 0 and index.entries().collect() == [] and index.chunks().collect() == []
    texts = {f"n{i}": TEXT.format(i) for i in range(40)}
    first = index.refresh(rows(spark, **texts))
    assert (first["added"], first["embedded_chunks"], first["parts_written"], first["version"]) == (40, 40, 8, 1)
    assert index.refresh(rows(spark, **texts)) | {"unchanged": 0} == dict.fromkeys(first, 0) | {"version": 1}
    before = {r.part: r.entries_version for r in index.manifest().collect()}
    texts["n3"] += "more"
    del texts["n5"]
    second = index.refresh(rows(spark, **texts))
    assert (second["added"], second["changed"], second["removed"], second["unchanged"], second["embedded_chunks"]) == (0, 1, 1, 38, 1)
    after = {r.part: r.entries_version for r in index.manifest().collect()}
    assert sum(before[p] != after[p] for p in before) == second["parts_written"] <= 2
    assert set(held(index)) == {f"{k}.md" for k in texts} == {r.relpath for r in index.chunks().collect()}
    # What only older manifests name goes, the index stays as it is.
    kept = held(index)
    assert index.vacuum() >= 1 and held(index) == kept


def test_a_failed_refresh_leaves_the_state_before_it(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"), parts=4)
    index.refresh(rows(spark, a="one", b="two"))
    before, embed = held(index), index.embed
    index.embed = lambda chunks: chunks.withColumn("embedding", F.raise_error(F.lit("no model")).cast("array<float>"))
    with pytest.raises(Exception, match="no model"):
        index.refresh(rows(spark, a="one", b="new"))
    assert held(index) == before and index.version() == 1
    index.embed = embed
    assert index.refresh(rows(spark, a="one", b="new"))["changed"] == 1 and held(index) != before


def test_all_entries_of_a_part_may_go(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"), parts=1)
    index.refresh(rows(spark, a="one"))
    assert index.refresh(rows(spark))["removed"] == 1
    assert index.entries().collect() == [] == index.chunks().collect()
    assert index.refresh(rows(spark, a="one"))["added"] == 1 and len(held(index)) == 1


def test_stream_updates_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    index = StoredIndex(spark, str(tmp_path / "i"), parts=8)
    run = events.stored_index_upkeep(index, lambda number, counts: seen.append((number, counts)))
    for texts in ({"a": "one", "b": "two"}, {"b": "new", "c": "three"}):
        rows(spark, **texts).coalesce(1).write.mode("append").parquet(source)
        q = spark.readStream.schema("relpath string, content string").parquet(source).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert [(n, c["added"], c["changed"]) for n, c in seen] == [(0, 2, 0), (1, 1, 1)]
    before, version = held(index), index.version()
    run(rows(spark, b="late", d="four"), 1)
    assert held(index) == before and index.version() == version and seen[-1][1]["parts_written"] == 0


def test_search_finds_deleted_entries_until_a_full_refresh(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"), parts=4)
    texts = {f"n{i}": TEXT.format(f"topic{i}") for i in range(6)}
    index.refresh(rows(spark, **texts))
    vector = index.chunks().where("relpath = 'n2.md'").first().embedding
    del texts["n2"]
    texts["n9"] = TEXT.format("fresh")
    found = search.search_index(index, rows(spark, **texts), "fresh", list(vector), status="active").collect()
    assert found[0].relpath == "n9.md" and "body of fresh" in found[0].snippet
    assert "n2.md" in {r.relpath for r in found} and next(r.snippet for r in found if r.relpath == "n2.md") == ""
    index.refresh(rows(spark, **texts))
    assert "n2.md" not in {r.relpath for r in search.search_index(index, rows(spark, **texts), "fresh", list(vector)).collect()}


def test_change_set_pairs_equal_files_once(spark):
    tree = lambda x: spark.createDataFrame(sorted(x.items()), "path string, sha256 string")
    was = {"k/a": "1", "k/b": "2", "k/gone": "3", **{f"k/old{i}": "same" for i in range(5)}, "other/x": "9"}
    are = {"k/a": "1", "k/b": "5", "k/new": "4", **{f"k/now{i}": "same" for i in range(3)}, "other/y": "9"}
    got = {r.path: (r.status, r.other) for r in sync.change_set(tree(was), tree(are), ["k/"]).collect()}
    assert got["k/b"] == ("M", None) and got["k/gone"] == ("D", None) and got["k/new"] == ("A", None) and "k/a" not in got and "other/y" not in got
    renamed = {p: o for p, (s, o) in got.items() if s == "R"}
    assert len(renamed) == 6 and all(renamed[o] == p for p, o in renamed.items()) and sum(s == "D" for s, _ in got.values()) == 3


def test_links_prefer_present_files(spark):
    moved = spark.createDataFrame([("x.md", "2026/02/x.md"), ("x.md", "2026/01/x.md"), ("y.md", "2026/03/y.md")], "old_path string, new_path string")
    present = spark.createDataFrame([("2025/z/y.md",), ("w.md",)], "path string")
    assert {r.name: r.new_path for r in sync.link_map(moved, present).collect()} == {"x.md": "2026/01/x.md", "y.md": "2025/z/y.md"}
