"""Every core query against its SQL twin in DuckDB, over whole small tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.core_queries(), registry.core_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def norm(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def lines(dicts):
    return sorted("|".join(f"{k}={norm(r[k])}" for k in sorted(r)) for r in dicts)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got = lines(r.asDict() for r in QUERIES[name](spark, SF).collect())
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert got == lines(dict(zip(names, r)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_no_cross_joins(spark):
    bad = []
    for name in sorted(SQL):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append(name)
    assert not bad


def test_nothing_imports_the_llm_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/tidemark/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "llm" not in open(path).read(), path
