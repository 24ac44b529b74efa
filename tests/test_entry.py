"""The driver's contract, and the queries against DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from silt import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    own = rows(df.columns, [tuple(r) for r in df.collect()])
    out = duck.execute(queries.ORACLE_SQL[name])
    assert own and own == rows([c[0] for c in out.description], out.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
