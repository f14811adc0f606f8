"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import framesift.plans  # noqa: F401
from framesift import registry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(registry.functions()))
def test_query(spark, duck, name):
    df = registry.functions()[name](spark, str(DATA))
    got = [tuple(r) for r in df.collect()]
    sql = registry.statements().get(name)
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(registry.functions()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
