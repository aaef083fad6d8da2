"""Every query with SQL gives DuckDB's rows; the driver contract holds."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from lexgrid.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = lambda found: sorted((tuple(plain(x) for x in r) for r in found), key=repr)
    assert rows(df.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
