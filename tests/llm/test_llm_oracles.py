"""The queries of the subpackage that SQL can express against DuckDB, over the smallest tables."""

import pytest
from test_oracles import SF, TABLES, rows

from chatloom.llm import oracles, queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(oracles.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    found = rows(got.columns, got.collect())
    assert found and found == rows(names, want.fetchall())
