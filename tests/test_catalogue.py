"""Every query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from gradus.plans.catalogue import QUERIES, SQL

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cell(x):
    if x is None or x != x:
        return None
    if isinstance(x, (bool, str)):
        return x
    try:
        return round(float(x), 8)
    except (TypeError, ValueError):
        return str(x)


def rows(cols, table):
    at = [table[0].index(c) for c in cols]
    return sorted((tuple(cell(r[i]) for i in at) for r in table[1]), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = (df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(SQL[name])
    want = (rel.columns, rel.fetchall())
    assert sorted(got[0]) == sorted(want[0])
    cols = sorted(got[0])
    assert rows(cols, got) == rows(cols, want)
