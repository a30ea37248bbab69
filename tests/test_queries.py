"""Every registered query of the reference operators against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

from scholia.plans import catalog

FOLDER = os.environ.get("SCHOLIA_TABLES", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    cols = [d[0] for d in result.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    left = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    right = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0
