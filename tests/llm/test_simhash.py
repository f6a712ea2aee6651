import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scholia.llm import simhash

SCHEMA = "doc_id long, text string, source string, id string"


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_equals_plain_form():
    for text in [None, "", " \t\n", "One", "one TWO", "Äpfel sind rot\x0bund ÉTÉ " * 40, "a b c d", "x" * 5000, "w " * 70000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_tree_and_split_nodes_equal_brute_force(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0}
    for base in list(fps)[:40]:
        for _ in range(6):
            base ^= 1 << rng.randrange(64)
            fps.add(base)
    center = rng.getrandbits(64)
    fps |= {center ^ 1 << i ^ 1 << j for i in range(20) for j in range(20)}
    fps = sorted(fps)
    a, b = (np.array(x + [0] * (-len(x) % simhash.RUN), np.uint64)[None] for x in (fps[::2], fps[1::2]))
    there = [np.arange(x.shape[1])[None] < n for x, n in ((a, len(fps[::2])), (b, len(fps[1::2])))]
    row, i, j = simhash.pairs_within(a, there[0], b, there[1])
    assert not row.any() and set(zip(i.tolist(), j.tolist(), strict=True)) == {(i, j) for i, x in enumerate(fps[::2]) for j, y in enumerate(fps[1::2]) if bin(x ^ y).count("1") <= 2}
    df = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(),) for x in fps], "fp long")
    for leaf in (2000, 6):
        links = [(r.u % 2**64, r.v % 2**64) for r in simhash.near_links(df, leaf).collect()]
        assert all(u in fps and v in fps for u, v in links)
        at = {f: i for i, f in enumerate(fps)}
        got = simhash.spanning_roots(len(fps), np.array([at[u] for u, _ in links]), np.array([at[v] for _, v in links])).tolist()
        assert got == brute_roots(fps)
    levels = simhash.node_levels(df, 6)
    assert len(levels) > 3 and levels[-1][1].where("n > 6").isEmpty()


def test_groups_nulls_ties_and_clashing_columns(spark):
    clash = spark.createDataFrame([(1, "a b c", 5, 6, 7), (2, "a b c", 5, 6, 7)], "doc_id long, text string, __key int, __nth int, row int").withColumn("h", F.lit(1)).withColumn("nth", F.lit(2)).withColumn("a.b", F.lit(3))
    assert [tuple(r) for r in simhash.drop_near_duplicates(clash).collect()] == [(1, "a b c", 5, 6, 7, 1, 2, 3)] and simhash.drop_near_duplicates(clash).columns == clash.columns
    assert [r.doc_id for r in simhash.drop_near_duplicates(clash, shingle=5, threshold=0.8).collect()] == [1]
    rows = [(5, "a b c d e", "s", "x"), (3, "A b c d e", None, "y"), (3, "A b c d e", None, "y"), (9, None, "s", None), (8, "", "s", None), (None, "zz yy xx", "s", "q"), (7, "other words entirely here now", "s", "q")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert found == {(5, 3), (3, 3), (9, 8), (8, 8), (None, None), (7, 7)}
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 7), (False, 8), (True, 0)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    from scholia.llm.queries import op1_simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(d.text) for d in docs]
    want = {(d.doc_id, f"{f:016x}", docs[r].doc_id) for d, f, r in zip(docs, fps, brute_roots(fps), strict=True)}
    assert {tuple(r) for r in op1_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_pipeline_candidates_come_through_the_fingerprint_index(spark, monkeypatch):
    """Without any band, texts of five-word fingerprints within two bits are still found, and only they."""
    from scholia.llm import jaccard

    real = jaccard._sketched
    monkeypatch.setattr(jaccard, "_sketched", lambda *a: real(*a).withColumn("bands", F.array().cast("array<long>")))
    rng, rows = random.Random(4), []
    for i in range(8):
        words = [f"w{rng.randrange(5_000)}" for _ in range(3_000)]
        rows.append((10 * i, " ".join(words)))
        words[rng.randrange(3_000)] = "changed"
        rows.append((10 * i + 1, " ".join(words)))
    close = {b[0] for a, b in zip(rows[::2], rows[1::2], strict=True) if (simhash.fingerprint(a[1], 5) ^ simhash.fingerprint(b[1], 5)).bit_count() <= 2}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df, shingle=5, threshold=0.8).collect()}
    assert len(close) > 2 and kept == {r[0] for r in rows} - close
