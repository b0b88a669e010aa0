"""Geographic tables derived from the generated star-schema tables, in Spark and in SQL.

Coordinates come from keys by whole-number arithmetic, so both engines see the same geography.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import projection as P


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to two tasks a core, for work that costs more than the read: a small file is read by few tasks."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def lon_of(key: str):
    return (F.col(key) * 7919) % 3600000 / 10000 - 180


def lat_of(key: str):
    return (F.col(key) * 104729) % 1700000 / 10000 - 85


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat, latp, tags (status, priority) from orders."""
    o = table(spark, sf_dir, "orders")
    tags = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    out = o.select(F.col("o_orderkey").alias("id"), lon_of("o_orderkey").alias("lon"), lat_of("o_orderkey").alias("lat"), tags.alias("tags"))
    return out.withColumn("latp", P.lat_to_latp("lat"))


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), lon_of("p_partkey").alias("lon"), lat_of("p_partkey").alias("lat"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, refs: each order's parts in a total order of its lines."""
    li = table(spark, sf_dir, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    listed = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(order)).alias("s"))
    return listed.select("id", F.transform("s", lambda x: x["l_partkey"]).alias("refs"))


def relations(spark: SparkSession, sf_dir: str, kind: int = 1) -> DataFrame:
    """id, tags, members: each customer's orders."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    members = F.transform(
        "s", lambda x, i: F.struct(i.alias("seq"), F.lit(kind).alias("type"), x["o_orderkey"].alias("ref"), x["o_orderpriority"].alias("role"))
    )
    tags = F.create_map(F.lit("admin_level"), F.col("c_nationkey").cast("string"), F.lit("segment"), "c_mktsegment")
    return c.join(m, c["c_custkey"] == m["o_custkey"]).select(F.col("c_custkey").alias("id"), tags.alias("tags"), members.alias("members"))


def nation_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name and box of each nation on a 5 x 5 grid, a little smaller than its cell."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    x, y = (k % 5) * 72 - 180, F.floor(k / 5) * 34 - 85
    return n.select(
        F.col("n_nationkey").alias("shape_id"), F.col("n_name").alias("name"),
        (x + 5).cast("double").alias("s_min_x"), (y + 3).cast("double").alias("s_min_y"),
        (x + 60).cast("double").alias("s_max_x"), (y + 30).cast("double").alias("s_max_y"),
    )


# the same tables for DuckDB
LON = "(({k} * 7919) % 3600000) / 10000::DOUBLE - 180"
LAT = "(({k} * 104729) % 1700000) / 10000::DOUBLE - 85"
LATP = "degrees(ln(tan(radians({lat} + 90) / 2)))"
TILE_X = "CAST(floor(({lon} + 180) / 360 * {n}) AS INTEGER)"
TILE_Y = "CAST(floor((180 - {latp}) / 360 * {n}) AS INTEGER)"
NODES = f"""n0 AS (SELECT o_orderkey AS id, {LON.format(k="o_orderkey")} AS lon, {LAT.format(k="o_orderkey")} AS lat, o_orderstatus AS status, o_orderpriority AS priority, o_custkey, o_totalprice FROM orders),
nodes AS (SELECT *, {LATP.format(lat="lat")} AS latp FROM n0)"""
REFS = """refs AS (SELECT l_orderkey AS id, l_partkey AS ref,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos FROM lineitem)"""
BOXES = """boxes AS (SELECT n_nationkey AS shape_id, n_name AS name, CAST((n_nationkey % 5) * 72 - 180 + 5 AS DOUBLE) AS x0, CAST((n_nationkey // 5) * 34 - 85 + 3 AS DOUBLE) AS y0,
  CAST((n_nationkey % 5) * 72 - 180 + 60 AS DOUBLE) AS x1, CAST((n_nationkey // 5) * 34 - 85 + 30 AS DOUBLE) AS y1 FROM nation)"""


def tile(z: int) -> str:
    n = 1 << z
    return f"{TILE_X.format(lon='lon', n=n)} AS x, {TILE_Y.format(latp='latp', n=n)} AS y"
