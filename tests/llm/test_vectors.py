import numpy as np

from scholia.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n int"


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = {k: set() for k in range(len(good))}
    for p in range(len(good)):
        for q in range(p):
            x, y = good[p][1], good[q][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[p].add(q)
                links[q].add(p)
    return good, links


def reach(links, start):
    seen, todo = {start}, [start]
    while todo:
        for k in links[todo.pop()] - seen:
            seen.add(k)
            todo.append(k)
    return seen


def clusters(rng, centers, each, dims=64, spread=0.02):
    base = rng.normal(size=(centers, dims))
    return np.concatenate([b + rng.normal(size=(each, dims)) * spread * np.linalg.norm(b) for b in base])


def test_links_equal_brute_force_with_blocks_and_copies(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(80, 64)), clusters(rng, 3, 25, spread=0.01)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[90].tolist()) for i in range(4)]
    df = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], SCHEMA)
    good, links = brute(rows)
    want = sorted((good[k][0], len(links[k]), min(good[m][0] for m in reach(links, k))) for k in links)
    for block in (1024, 8):
        got = vectors.near_vectors(df, block=block).collect()
        assert sorted((r.id, r.n_links, r.component_id) for r in got) == want
        assert all(r.kept == (r.id == r.component_id) for r in got)


def test_recall_right_at_the_threshold(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    angle = np.arccos(0.905)
    y = np.cos(angle) * x + np.sin(angle) * side
    df = spark.createDataFrame([(i, v.tolist(), 0, "x", 1) for i, v in enumerate(np.concatenate([x, y]))], SCHEMA)
    got = vectors.near_vectors(df).collect()
    assert sum(r.n_links > 0 for r in got) >= 0.93 * len(got)


def test_query_equals_brute_force(spark, sf_dir):
    from scholia.llm.queries import op9_vectors

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    good, links = brute(rows)
    want = sorted((good[k][0], len(links[k]), min(good[m][0] for m in reach(links, k))) for k in links)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in op9_vectors(spark, sf_dir).collect()) == want


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, -0.0]), (None, [1.0, 0.0]), (8, [1.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, None, None) for r in rows], SCHEMA)
    got = sorted(((r.id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()))
    assert got == sorted([(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 8, 9)] + [(7, 2, 7, True)] * 2 + [(0, 2, 7, False)])
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert [r.n_links for r in vectors.near_vectors(df.where("vec_id = 1")).collect()] == [0]
