"""Every query of the library against its SQL on the smallest tables, and its shape where it has none."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quillstone.plans import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, float) else str(v) if v is not None else None

    return sorted(map(repr, ([one(v) for v in r] for r in rows)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    query, sql = QUERIES[name]
    df = query(spark, sf)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if sql is None:
        assert rows
        return
    found = con.execute(f"SELECT * FROM ({sql})")
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(rows) == plain([r[i] for i in order] for r in found.fetchall())


def test_entry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
