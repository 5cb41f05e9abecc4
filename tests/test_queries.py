"""Every registered query with SQL gives the SQL's rows on the smallest tables; those without run on the largest."""

import glob
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from citygrid import plans

SF, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
WITHOUT = sorted(set(plans.QUERIES) - set(plans.SQL))


def attempt(run, name):
    try:
        return run(name)
    except Exception as e:  # noqa: BLE001 - told by the test of that query
        return e


def at_once(names, run):
    """{name: result or exception}: several queries at a time, as each is many small jobs."""
    with ThreadPoolExecutor(4) as pool:
        return dict(zip(names, pool.map(lambda n: attempt(run, n), names)))


@pytest.fixture(scope="module")
def small(spark, request):
    names = [i.callspec.params["name"] for i in request.session.items if i.originalname == "test_equal" and i.module is request.module]
    return at_once(names, lambda n: plans.QUERIES[n](spark, SF).toPandas())


@pytest.fixture(scope="module")
def large(spark, request):
    names = [i.callspec.params["name"] for i in request.session.items if i.originalname == "test_runs_on_the_largest_tables" and i.module is request.module]
    return at_once(names, lambda n: plans.QUERIES[n](spark, LARGE).toPandas())


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equal(small, duck, name):
    got = small[name]
    if isinstance(got, Exception):
        raise got
    want = duck.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda x: sorted(map(tuple, x[cols].astype(object).where(x[cols].notna(), None).astype(str).to_numpy()))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no tables")
@pytest.mark.parametrize("name", WITHOUT)
def test_runs_on_the_largest_tables(large, name):
    got = large[name]
    if isinstance(got, Exception):
        raise got
    assert len(got)
    if name.startswith("growth_") and "auc" in got:
        assert got["auc"][0] > 0.9 and got["fom"][0] > 0.4 and got["n"][0] > got["demand"][0] > 100


def test_entry_imports_without_the_corpus_operators():
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
