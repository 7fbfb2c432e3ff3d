"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from stratalog.packs import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in found)



@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
