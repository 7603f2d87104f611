"""Every query against its SQL on the smallest data."""

import datetime
import decimal

import duckdb
import pytest

from wayfold.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


def rows_of(columns, rows, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect(), sorted(df.columns))
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    relation = duck.sql(sql)
    assert sorted(relation.columns) == sorted(df.columns)
    assert got == rows_of(relation.columns, relation.fetchall(), sorted(df.columns))


def test_names_are_unique_and_documented():
    assert len(catalogue.queries()) > 100
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
