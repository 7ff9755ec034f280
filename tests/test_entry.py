"""The registered queries on the smallest tables: all of the core run, and those with SQL give the same rows."""

import os

import pytest

import __spark_entry__ as entry
from cadenza.plans import catalog

FOLDER = os.environ.get("CADENZA_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda v: "" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows), sorted(columns)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{FOLDER}/{f}')")
    return con


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.FLAGSHIP in catalog.QUERIES


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_equal_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in got.description]
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(got.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    assert df.columns and df.count() >= 1


def test_flagship(spark):
    assert entry.entry(spark).columns == ["subset", "category", "n", "percent", "mean_score"]
