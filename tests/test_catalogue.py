"""Every registered query of the catalogue against its SQL in DuckDB, on the smallest tables, and the driver's entry points."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ctxloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalogue.QUERIES.items() if sql and n != "q_ppr_joins"])
def test_query_equals_sql(spark, db, name):
    query, sql = catalogue.QUERIES[name]
    mine = query(spark, DATA).toPandas()
    other = db.sql(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    columns = sorted(mine.columns)
    rows = lambda df: sorted(repr(tuple(map(plain, r))) for r in df[columns].itertuples(index=False, name=None))
    assert rows(mine) == rows(other)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "q_pack" in entry.queries()


def test_packs(spark):
    assert catalogue.q_pack_summary(spark, DATA).first()["within"]
