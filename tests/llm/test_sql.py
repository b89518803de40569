"""The subpackage's queries against their SQL on the smallest tables."""

import duckdb
import pytest

from quillstone import llm


def plain(rows):
    return sorted(map(repr, ([round(float(v), 6) if isinstance(v, float) else v if v is None else str(v) for v in r] for r in rows)))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = llm.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(f"SELECT * FROM ({llm.oracle_sql()[name]})")
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([r[i] for i in order] for r in found.fetchall())
