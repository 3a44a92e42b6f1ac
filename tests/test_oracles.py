"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from umbra.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, bool, str, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.ORACLES:
        assert columns and len(set(columns)) == len(columns)
        return
    result = duck.sql(catalogue.ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
