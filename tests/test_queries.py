"""Every query with SQL against DuckDB, at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry
from linkmill.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_same_rows(spark, duck, name):
    want = duck.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [list(want.columns).index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(str(tuple(r[i] for i in place)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
