"""Every query with an oracle gives the rows of its SQL."""

import duckdb
import pytest

from rollmeter.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_catalog():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 70


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    want = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLES[name]}) q").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, map(tuple, want)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
