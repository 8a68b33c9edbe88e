"""Every core query with SQL gives the same rows as DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def core():
    import __spark_entry__ as entry

    mods = [m for m in entry._modules() if not m.__name__.startswith("codeloom.llm")]
    return {n: (q, m.ORACLES.get(n)) for m in mods for n, q in m.QUERIES.items()}


def cell(value):
    if value is None or value != value:
        return ""
    return f"{value:.6g}" if isinstance(value, float) else str(list(value)) if isinstance(value, (list, tuple)) else str(int(value)) if isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in SF.iterdir():
        c.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in core().items() if sql))
def test_oracle(spark, con, name):
    query, sql = core()[name]
    df = query(spark, str(SF))
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    want = sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(names) == columns and got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
