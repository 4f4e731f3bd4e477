"""Each query against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from quorbit.session import TABLES

NAMES = sorted(n for n in entry.oracle_sql())


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return connection


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    frame = entry.queries()[name](spark, small)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert normal([tuple(r) for r in frame.collect()], frame.columns) == normal(found.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_queries_without_sql(spark, small):
    energies = {round(entry.queries()[n](spark, small).first()["energy"], 4) for n in ("solve_ground_state", "solve_lanczos")}
    assert len(energies) == 1
    assert entry.queries()["sample_counts"](spark, small).agg({"n": "sum"}).first()[0] == 10_000
