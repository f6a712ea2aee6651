import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from scholia.llm import jaccard, simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Smallest id of every group over pairs of a similarity of 0.8 or more; texts without words are alike."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or (both and 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both)):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {min(rows[j][0] for j in range(len(rows)) if find(j) == r) for r in {find(i) for i in range(len(rows))}}


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.getrandbits(32)}"
    return words


def made():
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "One", "one two", "one two three four five", "one two three four five six"]
    for size in (30, 60, 200):
        base = [f"w{rng.getrandbits(20)}" for _ in range(size)]
        # From plain near copies over pairs about the threshold to others, and a chain whose ends are unlike.
        texts += [" ".join(edited(rng, base, n)) for n in (0, 0, 1, 1, 2, 3, 4, 6, size // 3) for _ in range(4)]
        for _ in range(8):
            base = base[size // 20 + 1 :] + [f"w{rng.getrandbits(20)}" for _ in range(size // 20 + 1)]
            texts.append(" ".join(base))
    return list(enumerate(texts))


def test_groups_equal_brute_force(spark):
    rows = made()
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, threshold=0.8)
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and 10 < len(want) < len(rows) - 10
    assert simhash.drop_near_duplicates(kept.limit(0), shingle=5, threshold=0.8).count() == 0


def test_exact_comparison_equals_brute_force():
    rows = [(i, t) for i, t in made() if plain_set(t)]
    root = jaccard.roots([jaccard.shingles(t, 5) for _, t in rows], 0.8)
    assert {rows[i][0] for i in set(root.tolist())} == brute_kept(rows)


def test_blocks_of_a_large_set_lose_no_link(spark):
    rows = made()
    df = spark.createDataFrame(rows, "id long, text string").withColumn("text_hash", simhash.text_key(F.col("text")))
    for group in (512, 3):
        found = jaccard.grouped(df, 5, 0.8, group).groupBy("root").agg(F.min("id").alias("id")).collect()
        assert {r.id for r in found} == brute_kept(rows)


def test_stage_leaves_no_near_copies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == brute_kept([(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()])
