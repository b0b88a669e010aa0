"""Every registered query of the tile engine against its SQL, on the smallest tables."""

import glob
import math
import os

import pytest

from tessella.plans import file_queries, shape_queries  # noqa: F401  they register their queries
from tessella.plans import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    return round(float(v), 6)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    sql = con.sql(Q.ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_without_sql(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark):
    """Only the columns a query needs are read, and simple filters are pushed down."""
    plan = Q.QUERIES["point_tiles_z14"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
    limit = Q.QUERIES["feature_limit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert limit.count("WindowGroupLimit") == 2  # before and after the exchange
    plan = Q.QUERIES["significant_tags_accept"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan
