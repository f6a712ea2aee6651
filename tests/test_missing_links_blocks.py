"""Pairs of entries that share tags, made from blocks of entries with the same tags."""

from itertools import combinations

import pytest

from scholia.operators import review

TAGS = [["#a", "#b"], ["#b", "#a", "#b"], ["#a", "#b", "#c"], ["#c", "#d"], ["#a", "#c", "#d", "#e"], ["#a"], []]


def asked(spark):
    own = {f"2026/{i % 12 + 1:02}/n{i}.md": TAGS[i % 3 if i % 4 else i % len(TAGS)] for i in range(90)}
    names = sorted(own)
    # One entry is linked to many, both ways; one to itself, one to none that exists.
    links = [(names[3], n) for n in names[::2]] + [(n, names[3]) for n in names[::5]] + list(zip(names[10:40], names[11:41])) + [(names[7], names[8])] * 2 + [(names[5], "gone.md")]
    notes = spark.createDataFrame([(k, "draft" if k == names[50] else "active", v) for k, v in own.items()], "relpath string, status string, tags array<string>")
    del own[names[50]]
    return own, {frozenset(e) for e in links}, notes, spark.createDataFrame(links, "src string, dst string")


@pytest.mark.parametrize("shared", [1, 2, 3])
def test_pairs_of_pieces_and_cells(spark, monkeypatch, shared):
    for name, size in (("PIECE", 7), ("BLOCK", 6), ("CELL", 2)):
        monkeypatch.setattr(review, name, size, raising=False)
    own, linked, notes, edges = asked(spark)
    want = [(a, b, len(set(own[a]) & set(own[b]))) for a, b in combinations(sorted(own), 2) if len(set(own[a]) & set(own[b])) >= shared and frozenset((a, b)) not in linked]
    got = [(r.a, r.b, r.n) for r in review.missing_connections(notes, edges, shared).collect()]
    assert sorted(got) == want


def test_pairs_are_not_shuffled(spark):
    *_, notes, edges = asked(spark)
    plan = review.missing_connections(notes, edges)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert not any(x in above for x in ("Exchange", "Join", "Aggregate", "Sort"))
