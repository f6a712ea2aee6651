import re

from pyspark.sql import functions as F

from scholia.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def plain_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > 3 * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = 3.0 * sizes[i]
            free.discard(i)
        left = sum(sizes) - sum(out[i] for i in set(range(len(sizes))) - free)
    return out


def test_targets_equal_repeated_resharing():
    for sizes in ([10, 10, 10], [1, 50, 500, 3, 9], [0, 7], [5], [], [1, 1000, 1, 1, 1, 1000]):
        assert [round(x, 6) for x in mixing.targets(sizes)] == [round(x, 6) for x in plain_targets(sizes)]


def test_splitting_tree_keeps_row_and_column_sums():
    quotas = [100, 0, 7, 3001]
    got = mixing.split_quotas(quotas, 13)
    assert [sum(c) for c in zip(*got, strict=True)] == quotas
    assert {sum(r) for r in got} <= {sum(quotas) // 13, sum(quotas) // 13 + 1}
    assert mixing.split_quotas([], 4) == [[]] * 4 and mixing.split_quotas([2], 1) == [[2]]


def test_query_meets_its_contract(spark, sf_dir):
    from scholia.llm.queries import op8_mix

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op8_mix(spark, sf_dir).collect()
    again = op8_mix(spark, sf_dir).repartition(3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sizes, taken, target, longest = {}, {}, {}, {}
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or ""))
        assert 0 <= r.taken <= 3 * r.size
        s = docs[r.doc_id].source
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
        longest[s] = max(longest.get(s, 0), r.size)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, plain_targets([sizes[s] for s in order]), strict=True):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= longest[s] / 2 + 1


def test_draws_fill_the_shards_and_blocks_do_not_change_the_totals(spark, monkeypatch):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3], None) for i in range(600)], SCHEMA)
    for least, most in ((mixing.LEAST_ROWS, mixing.BLOCK_ROWS), (1, 2)):
        monkeypatch.setattr(mixing, "LEAST_ROWS", least)
        monkeypatch.setattr(mixing, "BLOCK_ROWS", most)
        got = mixing.mix(df).collect()
        shards = {}
        for r in got:
            for d in r.draws:
                shards[d.shard] = shards.get(d.shard, 0) + 1
        assert set(shards) == set(range(mixing.SHARDS))
        for s in "abc":
            own = [r for r in got if r.source == s]
            assert abs(sum(len(r.draws) * r.size for r in own) - own[0].target) <= 4


def test_query_tells_shards_and_positions(spark, sf_dir):
    from scholia.llm.queries import op8_mix

    for r in op8_mix(spark, sf_dir).collect():
        shards, positions = ([x for x in s.split(",") if x] for s in (r.shards, r.positions))
        assert len(shards) == len(positions) == (r.taken // r.size if r.size else 0) and all(0 <= int(x) < mixing.SHARDS for x in shards)


def test_names_used_inside_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b", "s", 7, 8, 9, 10)], "doc_id long, text string, source string, __key int, __nth int, draw int, row int").withColumn("a.b", F.lit(1)).withColumn("stretch", F.lit(2))
    out = mixing.take(df, draw_col="at")
    assert out.columns == [*df.columns, "at"] and [tuple(r)[:-1] for r in out.collect()] == [tuple(df.first())]


def test_nulls_repeats_empty_and_clashing_columns(spark):
    rows = [(1, "a b c", None, "x"), (1, "a b c", None, "x"), (None, "d e", "s", "y"), (3, None, "s", "z"), (4, "", "z", None), (5, "w " * 50_000, "t", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == 6 and {r.source_size for r in got if r.source is None} == {6}
    assert all(len(r.draws) == 0 for r in got if r.size == 0) and all(len(r.draws) <= 3 for r in got)
    assert len({(d.shard, d.position) for r in got for d in r.draws}) == sum(len(r.draws) for r in got)
    out = mixing.take(df)
    assert out.columns == df.columns and out.count() == sum(len(r.draws) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.take(df.limit(0)).count() == 0


def test_take_deals_stretches_in_order(spark):
    """Every draw comes out once, and each task holds its stretches in the order of the shards."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "abc"[i % 3], None) for i in range(400)], SCHEMA)
    want = {(r.id, d.shard, d.position) for r in mixing.mix(df).collect() for d in r.draws}
    rows = mixing.take(df).select("doc_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at")).orderBy("at").collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _, _ in want)
    places = {}
    for i, shard, position in want:
        places.setdefault(i, []).append((shard, position))
    for p in {r.p for r in rows}:
        last = (-1, 0)
        for r in (r for r in rows if r.p == p):
            left = sorted(x for x in places[r.doc_id] if x > last)
            assert left
            last = left[0]
