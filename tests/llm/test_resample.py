import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scholia.llm import resample as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, longest=1, percent=10):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    own = lambda t: WORD.findall((t or "").translate(lower))
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in docs for f in grams(own(x))), Counter(bucket(f) for x in target for f in grams(own(x)))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000))))
    rows = []
    for d, x in docs:
        f = grams(own(x))
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(own(x))])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_random_rows_equal_plain_form(spark, monkeypatch, longest):
    monkeypatch.setattr(rs, "BLOCK_ROWS", 7)
    rng = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "Ärger", "日本", "x1", "ω", "rare", "word"]
    docs = [(rng.choice([None, -(2**63), 2**63 - 1, *range(-40, 300)]), rng.choice([None, "", "...", " ".join(rng.choice(words) + rng.choice(["", ",", "--"]) for _ in range(rng.randrange(60)))])) for _ in range(400)]
    docs += [(7, "alpha " * 25)] * 30 + [(8, "beta " * 5_000)]
    target = ["alpha beta", None, "rare rare rare", ""]
    df = spark.createDataFrame([(d, x, 1, "y", 2) for d, x in docs], "doc_id long, text string, rank int, f string, place int").repartition(5)
    got = rs.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), longest=longest, percent=40)
    assert ordered(got.collect()) == ordered(plain(docs, target, longest, 40))


def test_radix_sort_orders_any_whole_numbers(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, -5, 0, 3, 2**40, -(2**63), 2**63 - 1]), rng.randrange(-3, 3), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a long, b int, i int").repartition(4)
    for keys, key in (([F.col("a"), F.col("b")], lambda r: (r[0] is None, r[0] or 0, r[1])), ([F.col("b"), F.col("i")], lambda r: (r[1], r[2])), ([F.lit(1)], lambda r: 0)):
        got = sorted(rs.radix_ranked(df, keys, bits=13, block_rows=40).collect(), key=lambda r: r.place)
        assert [r.place for r in got] == list(range(500))
        assert [key(r) for r in got] == sorted(key(r) for r in rows) and ordered(tuple(r)[:3] for r in got) == ordered(rows)
    assert rs.radix_ranked(df.limit(0), [F.col("a")]).collect() == []


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert rs.resample(docs, target).collect() == []
    few = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert [(r.n_features, r["rank"]) for r in rs.resample(few, target).collect()] == [(2, None)]
