import duckdb
import pytest

from scholia.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, rel = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(map(tuple, got.collect())) == sorted(rel.select(*got.columns).fetchall())
