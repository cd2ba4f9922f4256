"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

CATALOG = entry.core_catalog()
QUICK = [n for n, (_, sql) in CATALOG.items() if sql is not None and not n.startswith("stream_") and "gbt" not in n]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, con, sf_dir, name):
    fn, sql = CATALOG[name]
    df = fn(spark, sf_dir)
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert check.rows(df.columns, df.collect()) == check.rows(cols, cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.filter("pattern_id = 'P001'").count() == 131


def test_every_key_of_the_check_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
