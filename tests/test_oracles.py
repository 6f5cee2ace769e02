"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from photolake.plans import aberration, catalogue, chains, develop, pixels, profiles, registry, sources, streams  # noqa: F401  they register their queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def shown(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else float(x) if isinstance(x, decimal.Decimal) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert shown(df.columns, [tuple(r) for r in df.collect()]) == shown(rel.columns, rel.fetchall())
