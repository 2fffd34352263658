"""Every registered query against its SQL oracle in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if hasattr(v, "as_integer_ratio"):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(table, columns, records):
    order = [list(columns).index(c) for c in sorted(columns)]
    return sorted([tuple(repr(plain(r[i])) for i in order) for r in records])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    mine = rows(name, df.columns, df.collect())
    relation = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert mine == rows(name, relation.columns, relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() >= (name != "stable_chrome")


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
