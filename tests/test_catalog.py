"""Registered queries against their SQL, on the smallest test tables where they are at hand."""

import os

import duckdb
import pytest

import __spark_entry__
from slotwise import catalog, catalog_details, catalog_packages  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def rounded(rows):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=key)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in catalog.ORACLES:
        found = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rounded(rows) == rounded([tuple(r[names.index(c)] for c in columns) for r in found.fetchall()])


def test_entry(spark, duck):
    assert __spark_entry__.entry(spark).count() > 0
