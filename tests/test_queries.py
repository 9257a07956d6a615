"""Each query of the catalogue against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([r[i] for i in order]) for r in found)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sql, name):
    df = catalogue.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in catalogue.oracle_sql():
        assert got
        return
    found = sql.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, found.fetchall())


def test_oracles_belong_to_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
