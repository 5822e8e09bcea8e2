"""Every query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from rarefia import catalog

SF = "/root/testdata/sf0.001"


def same_rows(spark, name, queries, oracles, sf=SF):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    got, want = queries[name](spark, sf).toPandas(), db.execute(oracles[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    same_rows(spark, name, catalog.queries(), catalog.oracles())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
