import math
import os

import duckdb
import pytest

import __spark_entry__
from tablescribe.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(rows):
    shown = lambda x: "" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.4f}" if isinstance(x, float) else str(x)
    return sorted(tuple(shown(float(x) if isinstance(x, int) and not isinstance(x, bool) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    picked = ", ".join(f'"{c}"' for c in names)
    assert plain(got.select(*names).collect()) == plain(db.sql(f"select {picked} from ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
