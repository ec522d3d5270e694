"""Every engine query with SQL, against DuckDB at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry
from loam.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    tidy = lambda v: round(float(v), 5) if isinstance(v, float) else str(v)
    return sorted(str([tidy(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, oracle, name):
    df = plans.QUERIES[name](spark, FOLDER)
    found = oracle.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(found.columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
