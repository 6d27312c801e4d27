"""Every query with SQL is held against DuckDB on the smallest tables."""

import math
import os

import pytest

from lineflux.plans import catalog

DIR = "/root/testdata/sf0.001"


def rows(records, columns):
    plain = lambda v: "-" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[c]) for c in columns) for r in records)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    want = [dict(zip(names, r)) for r in want.fetchall()]
    assert sorted(got.columns) == sorted(names)
    columns = sorted(names)
    assert rows([r.asDict() for r in got.collect()], columns) == rows(want, columns)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DIR.replace("sf0.001", "sf0.01")).count() > 0


def test_entry_imports_without_the_corpus_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("lineflux.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(q.startswith("op1") for q in e.queries()) and e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
