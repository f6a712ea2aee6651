"""Every query with SQL gives what DuckDB computes from the rendering rules."""

import math

import duckdb
import pytest

from scholia.queries import ORACLE_SQL, QUERIES

TABLES = ("events", "documents", "embeddings", "pages", "conversations")


def plain(row):
    return tuple(round(float(v), 6) if isinstance(v, float) and math.isfinite(v) else v for v in row)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    want = rel.select(*[f'"{c}"' for c in got.columns]).fetchall()
    assert sorted(map(plain, map(tuple, got.collect())), key=str) == sorted(map(plain, want), key=str)


def test_partitions_do_not_change_results(spark, sf_dir):
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append([sorted(map(str, QUERIES[q](spark, sf_dir).collect())) for q in ("hybrid_search_filtered", "lint_all", "neighborhood_d2")])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
