from pyspark.sql import functions as F

from scholia.operators import graph


def linked(spark, edges):
    rows = spark.createDataFrame([(a, b, "superseded_by", "frontmatter", 0) for a, b in edges], "src string, dst string, kind string, resolution string, pos int")
    ids = sorted({x for e in edges for x in e})
    nodes = spark.createDataFrame([(i, i, [], "") for i in ids], "id string, title string, tags array<string>, status string")
    return graph.Graph(nodes, rows, spark.createDataFrame([], "id string, check string, detail string"))


def test_chains_and_circles_of_any_length(spark):
    chain = [f"a{i:04d}" for i in range(260)]
    circle = [f"c{(7 * i) % 131:04d}" for i in range(131)]
    tail = ["t0", "t1", circle[5]]
    edges = [*zip(chain, chain[1:], strict=False), *zip(circle, circle[1:] + circle[:1], strict=True), *zip(tail, tail[1:], strict=False), ("p", "q"), ("q", "p")]
    g, to = linked(spark, edges), dict(edges)
    want = set()
    for a in to:
        path = [a]
        while path[-1] in to and to[path[-1]] not in path:
            path.append(to[path[-1]])
            want.add((a, len(path) - 1, path[-1]))
    got = [tuple(r) for r in graph.successors(g).select("id", "step", "successor").collect()]
    assert len(got) == len(want) and set(got) == want
    current = {r.id: r.current for r in graph.current(g).collect()}
    assert {current[c] for c in chain} == {chain[-1]}
    assert graph.ancestors(g).where(F.col("id") == chain[-1]).count() == len(chain) - 1
    ends, reached = {}, {}
    for a, _, b in sorted(want, key=lambda w: w[1]):
        ends[a], reached[b] = b, reached.get(b, 0) + 1
    found = {r.id: (r.current, r.n_ancestors) for r in graph.chains(g).collect()}
    assert found == {i: (ends.get(i, i), reached.get(i, 0)) for i in found} and set(found) == {x for e in edges for x in e}
    assert graph.would_cycle(g, chain[-1], chain[0])
    written = {r.id: r.cycle for r in graph.cycles(g).collect()}
    assert set(written) == {*circle, "p", "q"} and written["p"] == "p → q → p"
    assert {written[c] for c in circle} == {" → ".join([*circle, circle[0]])} and circle[0] == min(circle)
    assert graph.cycles(linked(spark, edges[:5])).count() == 0


def test_trees_that_run_into_chains_and_circles(spark):
    edges = [("a", "c"), ("b", "c"), ("c", "d"), ("e", "x"), ("f", "e"), ("x", "y"), ("y", "z"), ("z", "x"), ("h", "z")]
    found = {r.id: (r.current, r.n_ancestors) for r in graph.chains(linked(spark, edges)).collect()}
    assert found == {"a": ("d", 0), "b": ("d", 0), "c": ("d", 2), "d": ("d", 3), "e": ("z", 1), "f": ("z", 0), "h": ("y", 0), "x": ("z", 5), "y": ("x", 5), "z": ("y", 5)}
    assert {r.id: r.cycle for r in graph.cycles(linked(spark, edges)).collect()} == dict.fromkeys("xyz", "x → y → z → x")
    assert graph.chains(linked(spark, [("p", "p2")])).count() == 2


def test_a_chain_of_a_hundred_thousand_keeps_one_row_an_entry(spark):
    n = 100_000
    name = F.format_string("k%06d", F.col("id"))
    nodes = spark.range(n).select(name.alias("id"), name.alias("title"), F.array().cast("array<string>").alias("tags"), F.lit("").alias("status"))
    edges = spark.range(n - 1).select(name.alias("src"), F.format_string("k%06d", F.col("id") + 1).alias("dst"), F.lit("superseded_by").alias("kind"), F.lit("frontmatter").alias("resolution"), F.lit(0).alias("pos"))
    got = graph.chains(graph.Graph(nodes, edges, nodes)).select(F.count("*"), F.min("current"), F.max("current"), F.count_if(F.col("n_ancestors") == F.substring("id", 2, 6).cast("long"))).first()
    assert tuple(got) == (n, "k099999", "k099999", n)
