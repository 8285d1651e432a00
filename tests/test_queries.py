"""Every query with SQL of its own gives the same rows in Spark and in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tallywheel.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{v[i]:.9g}" if isinstance(v[i], float) else str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, DIR)
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


def test_flattened_traces(spark):
    got = catalogue.flatten_traces(spark, DIR)
    assert got.groupBy("tx_hash").count().where("count <> 3").count() == 0
    assert {tuple(r["trace_address"]) for r in got.collect()} == {(), (0,), (1,)}


def test_entry_without_the_llm_folders(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
