"""Queries over every object: each id of the input is met."""

import os

import pytest

from tessella.plans import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


def ids(spark, table, column):
    return {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(column).collect()}


def test_simplify_levels_of_every_node(spark):
    found = Q.QUERIES["simplify_levels"](spark, SF).select("id", "z").collect()
    assert sorted(map(tuple, found)) == sorted((i, z) for i in ids(spark, "orders", "o_orderkey") for z in (6, 9, 13))


def test_semi_joins_over_every_reference(spark):
    parts, used = ids(spark, "part", "p_partkey"), ids(spark, "lineitem", "l_partkey")
    found = {n: {r.id for r in Q.QUERIES[n](spark, SF).collect()} for n in ("used_nodes_semi", "kept_nodes")}
    assert found["used_nodes_semi"] == parts & used and found["kept_nodes"] >= parts & used


def test_corners_of_every_tile(spark):
    key = ("z", "x", "y")
    found = Q.QUERIES["tile_corners"](spark, SF).select(*key).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, Q.QUERIES["tile_set"](spark, SF).select(*key).collect()))
    assert max(r.x for r in found) >= 8 and max(r.y for r in found) >= 5
