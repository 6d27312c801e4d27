"""The corpus queries that have SQL, against DuckDB on the smallest tables."""

import os
from collections import Counter

import pytest

from lineflux.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(plain(v) for v in r) for r in got.select(*columns).collect()) == Counter(tuple(plain(v) for v in r) for r in want.fetchall())
