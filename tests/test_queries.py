"""Every query of the catalogue against its SQL twin in DuckDB, at the smallest scale; the entry point runs."""

import duckdb
import pytest

import __spark_entry__
from tracelake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    got = canonical(df.columns, df.collect())
    found = sql.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == canonical(columns, found.fetchall())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[0] == "customer" and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
