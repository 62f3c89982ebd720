"""Every tree query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from boxwood import oracle
from boxwood import queries as trees

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "events", "customer", "part", "embeddings")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def ordered(rows, names):
    by = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([r[i] for i in by]) for r in rows)


def test_every_query_has_sql():
    assert trees.queries().keys() == oracle.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(trees.queries()))
def test_query(spark, db, name):
    got = trees.queries()[name](spark, SF)
    want = db.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert ordered(got.collect(), got.columns) == ordered(want.fetchall(), names)
