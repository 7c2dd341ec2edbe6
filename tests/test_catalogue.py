"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from quillon.plans import catalogue

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def shown(x) -> str:
    return "nan" if x != x else f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    rows = [r.asDict() for r in df.collect()]
    if name not in catalogue.ORACLES:
        assert rows
        return
    result = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    other = [dict(zip(names, r)) for r in result.fetchall()]
    key = lambda r: tuple(shown(r[c]) for c in sorted(names))
    assert sorted(map(key, rows)) == sorted(map(key, other))
