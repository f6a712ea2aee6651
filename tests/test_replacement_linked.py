"""Replacements whose back-link is there already."""

from scholia.operators import graph, sync

LINKED = "---\ntitle: {0}\nstatus: active\n---\n\n- see: [x]({1})\n"


def planned(spark, *pairs):
    files = {"2026/01/untitled.md": "---\nstatus: active\n---\n\nold\n", "2026/01/odd.md": "---\ntitle: a [b]\nstatus: active\n---\n\nold\n", "2026/01/new.md": LINKED.format("New", "2026/01/untitled.md") + "- ref: [y](2026/01/odd.md)\n", "2026/01/other.md": LINKED.format("Other", "2026/01/new.md")}
    e = spark.createDataFrame(list(files.items()), "relpath string, content string")
    g = graph.build(e)
    plan = sync.supersede_plan(spark.createDataFrame([(f"2026/01/{a}.md", f"2026/01/{b}.md") for a, b in pairs], "old string, new string"), g, graph.successors(g), e)
    return plan, g, e


def test_a_linked_entry_without_a_label_can_be_replaced(spark):
    plan, *_ = planned(spark, ("untitled", "new"), ("odd", "new"))
    assert {r.error for r in plan.collect()} == {None}
    plan, *_ = planned(spark, ("untitled", "other"), ("odd", "other"))
    assert {r.error for r in plan.collect()} == {"back-link: target has no title", "back-link: target title holds brackets"}


def test_a_linked_entry_without_a_label_is_marked_and_nothing_added(spark):
    plan, g, e = planned(spark, ("untitled", "new"))
    (made,) = sync.superseded_texts(plan, g, e, "2026-09-01", "r").collect()
    assert made.relpath == "2026/01/untitled.md"
    assert made.new_text == "---\nstatus: superseded\nsuperseded_by: 2026/01/new.md\n---\n\n> **⚠ superseded (2026-09-01)** — current: [New](2026/01/new.md)\n\nold\n"
