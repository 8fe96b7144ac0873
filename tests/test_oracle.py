"""Every registered query equals its oracle SQL on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, as_counter

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    got = as_counter(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        assert got
        return
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == as_counter(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "month"
