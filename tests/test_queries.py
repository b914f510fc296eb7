"""Every registered query against its SQL, and what the entry point promises."""

import glob
import importlib
import os

import duckdb
import pytest

from corpusloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def spelled(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (int, float)):
        return repr(float(value))
    return repr(str(value).replace("+00:00", ""))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    mine = sorted([spelled(r[c]) for c in sorted(df.columns)] for r in df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted([spelled(v) for _, v in sorted(zip(names, row, strict=True))] for row in found.fetchall())
    assert mine == theirs


def test_every_query_without_sql_has_a_test_of_its_rows():
    from . import test_without_sql

    assert set(QUERIES) - set(ORACLES) == test_without_sql.TESTED


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert sum(r["n"] for r in entry.entry(spark).collect()) == 200
