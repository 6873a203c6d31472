"""Every registered query with SQL against DuckDB."""

import os

import pytest

from larkspur.plans import evaluated, evidence, registry, states  # noqa: F401  they register their queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    res = duck.execute(registry.ORACLE_SQL[name])
    cols = [c[0] for c in res.description]
    want = [dict(zip(cols, r, strict=True)) for r in res.fetchall()]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: str([r[c] for c in sorted(cols)])
    assert sorted(map(key, rows)) == sorted(map(key, want))
