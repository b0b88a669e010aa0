"""Registered queries of the tile engine, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import attributes as A
from tessella.functions import projection as P
from tessella.functions import tags as G
from tessella.operators import features as O
from tessella.operators import pyramid as T
from tessella.operators import relations as R
from tessella.operators import spatial as S
from tessella.plans import derived as D
from tessella.plans import rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# projection and tiles


@query(f"WITH {D.NODES} SELECT id, {D.tile(14)} FROM nodes")
def point_tiles_z14(spark, d):
    """X1 X3 X4 X6"""
    return T.index_points(D.nodes(spark, d), 14).select("id", "x", "y")


@query(f"""WITH {D.NODES}, t AS (SELECT id, lon, latp, {D.tile(10)} FROM nodes)
SELECT id, x, y, CAST(floor((lon - (x / 1024::DOUBLE * 360 - 180)) / (360 / 1024::DOUBLE / 4096)) AS INTEGER) AS px,
  CAST(floor((180 - y / 1024::DOUBLE * 360 - latp) / (360 / 1024::DOUBLE / 4096)) AS INTEGER) AS py FROM t""")
def tile_pixels(spark, d):
    """X8 X9 F16 F19"""
    t = T.index_points(D.nodes(spark, d), 10)
    return O.far_points(t.withColumns({"px": P.pixel_x("lon", F.lit(10), "x"), "py": P.pixel_y("latp", F.lit(10), "y")})).select("id", "x", "y", "px", "py")


@query(f"""WITH {D.NODES} SELECT id, CAST(trunc(lon * 1e7) AS INTEGER) AS lon_e7, CAST(trunc(latp * 1e7) AS INTEGER) AS latp_e7,
  CAST(round((degrees(atan(exp(radians(latp)))) * 2 - 90) * 1e6) AS BIGINT) AS lat_e6 FROM nodes""")
def stored_coordinates(spark, d):
    """X1 X2"""
    return D.nodes(spark, d).select("id", P.to_e7("lon").alias("lon_e7"), P.to_e7("latp").alias("latp_e7"), F.round(P.latp_to_lat("latp") * 1e6).cast("long").alias("lat_e6"))


@query(f"""WITH {D.NODES}, p AS (SELECT {D.tile(12)} FROM nodes), u AS (SELECT unnest(range(0, 13)) AS z),
t AS (SELECT DISTINCT CAST(z AS INTEGER) AS z, x >> CAST(12 - z AS INTEGER) AS x, y >> CAST(12 - z AS INTEGER) AS y FROM p, u)
SELECT z, x, y, CAST(round((x / pow(2, z) * 360 - 180) * 1e6) AS BIGINT) AS west, CAST(round((180 - y / pow(2, z) * 360) * 1e6) AS BIGINT) AS north,
  CAST(round((degrees(atan(exp(radians(180 - y / pow(2, z) * 360)))) * 2 - 90) * 1e6) AS BIGINT) AS north_lat FROM t""")
def tile_corners(spark, d):
    """X5, of the tiles of every node"""
    t = T.tile_set(T.index_points(D.nodes(spark, d), 12), 12)
    e6 = lambda c: F.round(c * 1e6).cast("long")
    return t.select("z", "x", "y", e6(P.tilex_to_lon("x", "z")).alias("west"), e6(P.tiley_to_latp("y", "z")).alias("north"), e6(P.tiley_to_lat("y", "z")).alias("north_lat"))


@query(f"""WITH {D.NODES}, l AS (SELECT id, degrees(atan(exp(radians(latp)))) * 2 - 90 AS la FROM nodes)
SELECT id, CAST(round(degrees(100 / 6371000::DOUBLE / cos(radians(la))) * 1e9) AS BIGINT) AS degp_e9,
  CAST(round(radians(0.01::DOUBLE) * 6371000 * cos(radians(la)) * 1e3) AS BIGINT) AS mm FROM l""")
def metre_scale(spark, d):
    """X7"""
    n = D.nodes(spark, d)
    return n.select("id", F.round(P.meter_to_degp(F.lit(100), "latp") * 1e9).cast("long").alias("degp_e9"), F.round(P.degp_to_meter(F.lit(0.01), "latp") * 1e3).cast("long").alias("mm"))


@query(f"""WITH {D.NODES}, t AS (SELECT {D.tile(14)} FROM nodes), z AS (SELECT unnest(range(0, 15)) AS z)
SELECT CAST(z AS INTEGER) AS z, x >> CAST(14 - z AS INTEGER) AS x, y >> CAST(14 - z AS INTEGER) AS y, count(*) AS n FROM t, z GROUP BY ALL""")
def tile_pyramid_counts(spark, d):
    """X13 A1 A18 R6"""
    return T.roll_up(T.index_points(D.nodes(spark, d), 14).select("x", "y"), 14, 0, 14).groupBy("z", "x", "y").agg(F.count("*").alias("n"))


@query(f"""WITH {D.NODES}, t AS (SELECT {D.tile(12)} FROM nodes), z AS (SELECT unnest(range(0, 13)) AS z)
SELECT DISTINCT CAST(z AS INTEGER) AS z, x >> CAST(12 - z AS INTEGER) AS x, y >> CAST(12 - z AS INTEGER) AS y FROM t, z""")
def tile_set(spark, d):
    """A12 H12 D15"""
    return T.tile_set(T.index_points(D.nodes(spark, d), 12), 12)


@query(f"""WITH {D.NODES}, t AS (SELECT DISTINCT {D.tile(7)} FROM nodes), z AS (SELECT unnest([1, 2]) AS up),
k AS (SELECT up, unnest(range(0, CAST(pow(4, up) AS BIGINT))) AS k FROM z)
SELECT CAST(7 + up AS INTEGER) AS z, CAST(x * pow(2, up) + k % CAST(pow(2, up) AS BIGINT) AS BIGINT) AS x, CAST(y * pow(2, up) + k // CAST(pow(2, up) AS BIGINT) AS BIGINT) AS y FROM t, k""")
def tiles_beyond_precise(spark, d):
    """A13"""
    out = T.deeper(T.index_points(D.nodes(spark, d), 7).select("x", "y").distinct(), 7, 8, 9)
    return out.select("z", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(f"""WITH {D.NODES}, t AS (SELECT DISTINCT {D.tile(8)} FROM nodes), b AS (SELECT x, y, 360 / 256::DOUBLE AS s, x / 256::DOUBLE * 360 - 180 AS w, 180 - y / 256::DOUBLE * 360 AS n FROM t)
SELECT 8 AS z, x, y FROM b WHERE w + s / 8192 <= 41.9 AND w + s - s / 8192 >= -30.3 AND n - s + s / 8192 <= 60.2 AND n - s / 8192 >= -20.7""")
def tile_bbox_filter(spark, d):
    """F10 F11 X12"""
    t = T.index_points(D.nodes(spark, d), 8).select("z", "x", "y").distinct()
    return T.within_box(t, -30.3, -20.7, 41.9, 60.2)


_HILBERT = "SELECT id, z, x AS x0, y AS y0, x, y, 0::BIGINT AS d FROM t"
for _k in range(11, -1, -1):
    _s = 1 << _k
    _rx, _ry = f"(CASE WHEN (x & {_s}) > 0 THEN 1 ELSE 0 END)", f"(CASE WHEN (y & {_s}) > 0 THEN 1 ELSE 0 END)"
    _HILBERT = f"""SELECT id, z, x0, y0, CASE WHEN ry = 1 THEN lx WHEN rx = 1 THEN {_s - 1} - ly ELSE ly END AS x,
  CASE WHEN ry = 1 THEN ly WHEN rx = 1 THEN {_s - 1} - lx ELSE lx END AS y, d + {_s * _s}::BIGINT * xor(3 * rx, ry) AS d
 FROM (SELECT *, {_rx} AS rx, {_ry} AS ry, x & {_s - 1} AS lx, y & {_s - 1} AS ly FROM ({_HILBERT}))"""


@query(f"WITH {D.NODES}, t AS (SELECT id, 12 AS z, {D.tile(12)} FROM nodes) SELECT id, x0 AS x, y0 AS y, d + {(4**12 - 1) // 3} AS tile_id, 4095 - y0 AS tms_row FROM ({_HILBERT})")
def hilbert_tile_id(spark, d):
    """X14 X19"""
    t = T.index_points(D.nodes(spark, d), 12)
    return t.select("id", "x", "y", P.hilbert_tile_id("z", "x", "y").alias("tile_id"), P.flip_row("y", "z").alias("tms_row"))


_BITS = " | ".join(f"((CAST(x AS BIGINT) >> {k}) & 1) << {2 * k + 1} | ((CAST(y AS BIGINT) >> {k}) & 1) << {2 * k}" for k in range(10))


@query(f"WITH {D.NODES}, t AS (SELECT id, {D.tile(10)} FROM nodes) SELECT id, {' | '.join('(' + p + ')' for b in _BITS.split(' | ') for p in [b])} AS curve FROM t")
def curve_number(spark, d):
    """O2 E8"""
    t = T.cluster(T.index_points(D.nodes(spark, d), 10), 10)
    return t.select("id", T.interleaved(F.col("x"), F.col("y"), 10).alias("curve"))


# layers, limits, merges

_LAYER_ROWS = [("urgent", 0, 14, "", 3), ("high", 4, 14, "", 0), ("medium", 6, 10, "high", 5), ("other", 9, 12, "high", 0)]
_LAYERS = "layers(name, minzoom, maxzoom, write_to, feature_limit) AS (VALUES " + ", ".join(str(r) for r in _LAYER_ROWS) + ")"
_LAYER_OF = "CASE priority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'other' END"


def _layers(spark):
    return spark.createDataFrame(_LAYER_ROWS, "name string, minzoom int, maxzoom int, write_to string, feature_limit int")


def _features(spark, d):
    """Points with layer, z_order, attributes and minzoom."""
    n = D.nodes(spark, d)
    p = F.col("tags")["priority"]
    layer = F.when(p == "1-URGENT", "urgent").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("other")
    attrs = A.attribute_set(A.attribute("status", F.col("tags")["status"]))
    return n.withColumns({
        "layer": layer, "z_order": P.encode_z_order(F.col("id") % 40 - 20), "fmin": P.encode_min_zoom((F.col("id") % 13).cast("double")),
        "attrs": attrs, "status": F.col("tags")["status"], "feature_id": F.col("id"),
    })


@query(f"""WITH {D.NODES}, {_LAYERS}, f AS (SELECT *, {_LAYER_OF} AS layer, id % 13 AS fmin FROM nodes), z AS (SELECT unnest(range(0, 15)) AS z)
SELECT name, CAST(z AS INTEGER) AS z, count(*) AS n FROM f JOIN layers ON layer = name, z WHERE z BETWEEN minzoom AND maxzoom AND fmin <= z GROUP BY ALL""")
def layer_zoom_range(spark, d):
    """F12 F13 J23"""
    f = O.with_layers(_features(spark, d), _layers(spark))
    low = F.greatest("minzoom", "fmin")
    z = F.explode(F.when(low <= F.col("maxzoom"), F.sequence(low, F.col("maxzoom"))).otherwise(F.array().cast("array<int>")))
    return f.select("name", z.alias("z")).groupBy("name", "z").agg(F.count("*").alias("n"))


def _in_tiles(spark, d, zoom, highest):
    """Features at zooms up to the highest, with their tile, from their own zoom on."""
    f = O.with_layers(T.index_points(_features(spark, d), zoom), _layers(spark))
    return O.in_zoom_range(T.roll_up(f, zoom, 0, highest, "fmin"))


_TILES = f"""{D.NODES}, {_LAYERS}, f AS (SELECT *, {_LAYER_OF} AS layer, id % 13 AS fmin, (id % 40 - 20) * 10 AS z_order, {D.tile(12)} FROM nodes),
z AS (SELECT unnest(range(0, 13)) AS z), r AS (SELECT name, feature_limit, write_to, id, status, z_order, lon, latp, CAST(z AS INTEGER) AS z, x >> CAST(12 - z AS INTEGER) AS x, y >> CAST(12 - z AS INTEGER) AS y
  FROM f JOIN layers ON layer = name, z WHERE z BETWEEN minzoom AND maxzoom AND fmin <= z)"""


@query(f"""WITH {_TILES}, k AS (SELECT *, row_number() OVER (PARTITION BY name, z, x, y ORDER BY CASE WHEN feature_limit > 0 THEN -z_order ELSE z_order END, id) AS rn FROM r)
SELECT name, z, x, y, id FROM k WHERE feature_limit = 0 OR z >= 10 OR rn <= feature_limit""")
def feature_limit(spark, d):
    """W1 O1 O5 O6"""
    r = _in_tiles(spark, d, 12, 12)
    up = O.ascending(F.col("feature_limit"))
    order = [F.when(up, F.col("z_order")).otherwise(-F.col("z_order")), F.col("id")]
    return O.limit_features(r, ["name", "z", "x", "y"], order, F.col("feature_limit"), F.lit(10), max(x[4] for x in _LAYER_ROWS)).select("name", "z", "x", "y", "id")


@query(f"WITH {_TILES} SELECT name AS layer, z, x, y, status, z_order, count(*) AS n_points, min(id) AS feature_id FROM r GROUP BY ALL")
def combine_points(spark, d):
    """A2 A4 A5 W2"""
    r = _in_tiles(spark, d, 12, 12).withColumns({"geom_type": F.lit(0), "attr_hash": A.attr_hash(F.col("attrs"))})
    out = O.combine_points(r.withColumn("layer", F.col("name")), ["layer", "z", "x", "y", "status"], collect=False)
    return out.select("layer", "z", "x", "y", "status", "z_order", "n_points", "feature_id")


@query(f"WITH {_TILES} SELECT CASE WHEN write_to <> '' THEN write_to ELSE name END AS out_layer, z, count(*) AS n, count(DISTINCT name) AS sublayers FROM r GROUP BY ALL")
def union_write_to(spark, d):
    """U3 D12"""
    return O.output_layer(_in_tiles(spark, d, 12, 12)).groupBy("out_layer", "z").agg(F.count("*").alias("n"), F.countDistinct("name").alias("sublayers"))


@query("""SELECT l_orderkey % 64 AS x, l_suppkey AS feature_id, l_returnflag AS status, count(*) AS n FROM
 (SELECT DISTINCT l_orderkey % 64 AS l_orderkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY ALL""")
def distinct_in_tile(spark, d):
    """A3 A15"""
    li = D.table(spark, d, "lineitem")
    rows = li.select(
        F.lit(6).alias("z"), (F.col("l_orderkey") % 64).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("layer_id"), F.lit(0).alias("z_order"),
        F.lit(0).alias("geom_type"), A.attr_hash(A.attribute_set(A.attribute("flag", F.col("l_returnflag")), A.attribute("line", F.col("l_linestatus")))).alias("attr_hash"),
        F.col("l_suppkey").alias("feature_id"), F.lit(0).alias("osm_id"), F.col("l_returnflag").alias("status"),
    )
    return O.distinct_in_tile(rows).groupBy("x", "feature_id", "status").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey AS id, 'customer' AS src, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_nationkey FROM supplier""")
def union_sources(spark, d):
    """U1 U2"""
    c, s = D.table(spark, d, "customer"), D.table(spark, d, "supplier")
    a = c.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("src"), F.col("c_nationkey").alias("nation"))
    b = s.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("src"), F.col("s_nationkey").alias("nation"))
    return O.union_sources(a, b).drop("source_pos")


@query(f"""WITH {D.NODES}, t AS (SELECT id, {D.tile(6)} FROM nodes), o AS (SELECT x, y, count(*) AS old_n FROM t WHERE id % 2 = 0 GROUP BY ALL),
n AS (SELECT x, y, count(*) AS new_n FROM t WHERE id % 2 = 1 GROUP BY ALL)
SELECT coalesce(o.x, n.x) AS x, coalesce(o.y, n.y) AS y, old_n, new_n, coalesce(old_n, 0) + coalesce(new_n, 0) AS n FROM o FULL OUTER JOIN n ON o.x = n.x AND o.y = n.y""")
def merge_tiles(spark, d):
    """J24 S29 U4"""
    t = T.index_points(D.nodes(spark, d), 6)
    count = lambda k: t.where(F.col("id") % 2 == k).groupBy("z", "x", "y").agg(F.count("*").alias("data"))
    m = O.merge_tiles(count(0), count(1))
    return m.select("x", "y", F.col("old").alias("old_n"), F.col("new").alias("new_n"), (F.coalesce("old", F.lit(0)) + F.coalesce("new", F.lit(0))).alias("n"))


@query(f"""WITH {D.NODES}, t AS (SELECT id, 10 AS z, {D.tile(10)} FROM nodes), g AS (SELECT x, y, count(*) AS c FROM t GROUP BY ALL),
w AS (SELECT x, y, 1000 AS weight FROM g) SELECT x, y, (sum(weight) OVER (ORDER BY x, y) - weight) // 7000 AS batch FROM w""")
def batch_weights(spark, d):
    """W5 A18"""
    t = T.index_points(D.nodes(spark, d), 10).select("z", "x", "y").distinct()
    return T.weight_batches(t, 7000).select("x", "y", "batch")


# attributes


@query("""WITH z AS (SELECT unnest(range(0, 15, 3)) AS z), p AS (SELECT p_partkey AS id, CAST(z AS INTEGER) AS z,
 CASE WHEN p_size % 15 <= z THEN p_brand END AS brand, p_size AS size, CASE WHEN 7 <= z THEN p_size > 25 END AS large FROM part, z)
SELECT *, (CASE WHEN brand IS NULL THEN 0 ELSE 1 END) + 1 + (CASE WHEN large IS NULL THEN 0 ELSE 1 END) AS n FROM p""")
def attr_minzoom(spark, d):
    """F14 L9 L10 L11 L12"""
    p = D.spread(D.table(spark, d, "part").select("p_partkey", "p_brand", "p_size"))
    attrs = A.attribute_set(A.attribute("brand", F.col("p_brand"), F.col("p_size") % 15), A.attribute_integer("size", F.col("p_size")), A.attribute_boolean("large", F.col("p_size") > 25, 7))
    made = p.select(F.col("p_partkey").alias("id"), attrs.alias("s")).select("id", "s", F.explode(F.sequence(F.lit(0), F.lit(12), F.lit(3))).alias("z"))
    got = made.select("id", "z", A.shown(F.col("s"), F.col("z")).alias("a"))
    one = lambda k: F.element_at(F.filter("a", lambda x: x["key"] == k), 1)
    at = lambda k, f: F.when(F.exists("a", lambda x: x["key"] == k), one(k)[f])
    return got.select("id", "z", at("brand", "s").alias("brand"), at("size", "d").cast("int").alias("size"), (at("large", "d") == 1).alias("large"), F.size("a").alias("n"))


@query("""SELECT user_id, event_type AS key, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def attr_last_wins(spark, d):
    """A14"""
    e = D.table(spark, d, "events").select("user_id", F.col("event_type").alias("key"), "event_id", "value")
    return A.last_wins(e, ["user_id"], "key", ["event_id"])


@query("""SELECT 'part' AS layer, * FROM (VALUES ('brand', 0), ('price', 1), ('size', 3)) v(key, vtype) WHERE (SELECT count(*) FROM part) > 0
UNION ALL SELECT 'order', * FROM (VALUES ('priority', 0), ('total', 1)) v(key, vtype) WHERE (SELECT count(*) FROM orders) > 0""")
def vector_layers_fields(spark, d):
    """A16 K14"""
    p, o = D.table(spark, d, "part"), D.table(spark, d, "orders")
    a = p.select(F.lit("part").alias("layer"), A.attribute_set(A.attribute("brand", F.col("p_brand")), A.attribute_integer("size", F.col("p_size")), A.attribute_numeric("price", F.col("p_retailprice"))).alias("attrs"))
    b = o.select(F.lit("order").alias("layer"), A.attribute_set(A.attribute("priority", F.col("o_orderpriority")), A.attribute_numeric("total", F.col("o_totalprice"))).alias("attrs"))
    return A.layer_fields(a.unionByName(b))


@query("""WITH v AS (SELECT o_orderkey AS id, (o_orderkey % 9001 - 4500) * 1.0::DOUBLE / 2 AS z FROM orders)
SELECT id, CASE WHEN z > 1000 THEN CAST(floor(sqrt((z - 1000) * 10) + 10000) AS INTEGER) WHEN z < -1000 THEN CAST(floor(-10000 - sqrt((abs(z) - 1000) * 10)) AS INTEGER)
 ELSE CAST(floor(z * 10) AS INTEGER) END AS z_order, CASE WHEN floor(z / 100) > 15 THEN 15 WHEN z < 0 THEN 0 ELSE CAST(floor(z / 100) AS INTEGER) END AS min_zoom FROM v""")
def z_order_encode(spark, d):
    """X15 X16 L13 L14"""
    v = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 9001 - 4500) * 1.0 / 2).cast("double").alias("z"))
    return v.select("id", P.encode_z_order("z").alias("z_order"), P.encode_min_zoom(F.col("z") / 100).alias("min_zoom"))


@query(f"""WITH {D.NODES}, z AS (SELECT unnest([6, 9, 13]) AS z), l AS (SELECT id, degrees(atan(exp(radians(latp)))) * 2 - 90 AS la FROM nodes)
SELECT id, z, CASE WHEN z < 13 THEN CAST(round(degrees(30 / 6371000::DOUBLE / cos(radians(la))) * pow(2, 12 - z) * 1e8) AS BIGINT) ELSE 0 END AS level_e8,
 CASE WHEN z < 10 THEN CAST(round(degrees(500 / 6371000::DOUBLE / cos(radians(la))) * pow(2, 9 - z) * 1e6) AS BIGINT) ELSE 0 END AS area_e6 FROM l, z""")
def simplify_levels(spark, d):
    """X17 X18, for every node"""
    n = D.nodes(spark, d).withColumn("z", F.explode(F.array(*[F.lit(z) for z in (6, 9, 13)])))
    level = P.simplify_level("z", "latp", F.lit(0.01), F.lit(30.0), F.lit(2.0), F.lit(13))
    return n.select("id", "z", F.round(level * 1e8).cast("long").alias("level_e8"), F.round(P.filter_area_level("z", "latp", F.lit(500.0), F.lit(10)) * 1e6).cast("long").alias("area_e6"))


# tags


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority IS NOT NULL AND o_orderpriority = '1-URGENT'")
def significant_tags_accept(spark, d):
    """F1 F2 F3 P8"""
    return D.nodes(spark, d).where(G.significant(F.col("tags"), ["status=F", "priority=1-URGENT"])).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def significant_tags_reject(spark, d):
    """F1 F4"""
    return D.nodes(spark, d).where(G.significant(F.col("tags"), ["~priority", "~status=F"])).select("id")


@query("""SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS text_id, 'priority,status' AS keys, true AS holds, o_orderstatus AS status, '' AS name,
 CAST(o_orderpriority[1] AS INTEGER) AS level, 'H' AS patched FROM orders""")
def tag_lookups(spark, d):
    """L1 L3 L4 L5 L6 L17 L25 M13 S10"""
    t = F.col("tags")
    return D.nodes(spark, d).select(
        "id", F.col("id").cast("string").alias("text_id"), F.array_join(G.all_keys(t), ",").alias("keys"), (G.holds(t, "status") & G.has_tags(t)).alias("holds"),
        G.find(t, "status").alias("status"), G.find(t, "name").alias("name"),
        G.number(F.element_at(G.split_values(G.find(t, "priority"), "-"), 1), 0).cast("int").alias("level"), G.set_tag(t, "status", F.lit("H"))["status"].alias("patched"),
    )


# nodes, ways, relations


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def used_ways_semi(spark, d):
    """Ways of the relations that a tag accepts"""
    return R.used_ways(D.ways(spark, d), D.relations(spark, d).where(F.col("tags")["segment"] != "BUILDING")).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def used_nodes_semi(spark, d):
    """J7 R4, by all ways"""
    return R.used_nodes(D.part_nodes(spark, d), D.ways(spark, d)).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_size > 40 OR p_partkey IN (SELECT l_partkey FROM lineitem)")
def kept_nodes(spark, d):
    """J8, by all ways"""
    n = D.part_nodes(spark, d).join(D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    return R.kept_nodes(n, D.ways(spark, d), F.col("p_size") > 40).select("id")


@query(f"""WITH {D.REFS}, c AS (SELECT r.id, pos, CAST(round(({D.LON.format(k="p_partkey")}) * 10000) AS BIGINT) AS lon, CAST(round(({D.LAT.format(k="p_partkey")}) * 10000) AS BIGINT) AS lat
 FROM refs r JOIN part ON p_partkey = ref WHERE p_partkey % 10 <> 0),
m AS (SELECT r.id, count(*) FILTER (p_partkey IS NULL OR p_partkey % 10 = 0) AS missing FROM refs r LEFT JOIN part ON p_partkey = ref GROUP BY r.id)
SELECT c.id, any_value(missing) AS missing, count(*) AS n, string_agg(lon || ' ' || lat, ',' ORDER BY pos) AS coords, first(lon ORDER BY pos) = last(lon ORDER BY pos) AND first(lat ORDER BY pos) = last(lat ORDER BY pos) AS closed
FROM c JOIN m ON c.id = m.id GROUP BY c.id""")
def way_geometry(spark, d):
    """J1 J2 J3 J4 J5 F20 F21 G24"""
    w = R.way_coordinates(D.ways(spark, d), D.part_nodes(spark, d).where("id % 10 <> 0"))
    e4 = lambda c: F.round(c * 10000).cast("long").cast("string")
    return w.select("id", "missing", F.size("coords").cast("long").alias("n"), F.array_join(F.transform("coords", lambda p: F.concat_ws(" ", e4(p["lon"]), e4(p["lat"]))), ",").alias("coords"), "closed")


@query("""SELECT o_orderkey AS id, o_custkey AS rel_id, o_orderpriority AS role, CAST(c_nationkey AS VARCHAR) AS value, CAST(c_nationkey AS DOUBLE) AS least FROM orders JOIN customer ON o_custkey = c_custkey""")
def parent_relations(spark, d):
    """J9 J10 A19 L18 L20 D18"""
    w, r = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), D.relations(spark, d)
    least = R.least_parent_number(w, r, R.WAY, "admin_level")
    return R.parent_tag(w, r, R.WAY, "admin_level").join(least, "id").select("id", "rel_id", "role", "value", "least")


@query("""SELECT c_custkey AS id, c_nationkey + 1000000000 AS ancestor FROM customer UNION ALL SELECT c_custkey, n_regionkey + 2000000000 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT n_nationkey + 1000000000, n_regionkey + 2000000000 FROM nation""")
def relation_ancestors(spark, d):
    """J11 P5"""
    c, n = D.table(spark, d, "customer"), D.table(spark, d, "nation")
    up = lambda k, by: (F.col(k).cast("long") + by)
    e = c.select(F.col("c_custkey").alias("child"), up("c_nationkey", 1000000000).alias("parent")).unionByName(
        n.select(up("n_nationkey", 1000000000).alias("child"), up("n_regionkey", 2000000000).alias("parent"))
    )
    return R.ancestors(e)


@query("""SELECT o_custkey AS rel_id, o_orderkey AS node_id, o_orderpriority AS role FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
 ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '5-LOW')) WHERE rn = 1""")
def label_role_node(spark, d):
    """J26 W4 L8 D19 H10"""
    return R.first_role_node(D.relations(spark, d, R.NODE), D.nodes(spark, d), ["1-URGENT", "5-LOW"]).select("rel_id", "node_id", "role")


@query("SELECT c_custkey AS id, coalesce(n_name, '') AS value FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0")
def kv_lookup(spark, d):
    """J25 L23 D20"""
    store = D.table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    c = D.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"))
    return O.lookup(c, "k", store).select("id", "value")


# spatial joins


def _points_as_boxes(spark, d):
    return D.nodes(spark, d).select("id", F.col("lon").alias("min_x"), F.col("lat").alias("min_y"), F.col("lon").alias("max_x"), F.col("lat").alias("max_y"))


@query(f"WITH {D.NODES}, {D.BOXES} SELECT id FROM nodes WHERE EXISTS (SELECT 1 FROM boxes WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1)")
def intersects_semi(spark, d):
    """J13 J18 J19 L21 R8 R9"""
    return S.intersects(_points_as_boxes(spark, d), D.nation_boxes(spark, d), 20.0).select("id")


@query(f"""WITH {D.NODES}, {D.BOXES} SELECT id, string_agg(name, ',' ORDER BY name) AS names FROM nodes JOIN boxes ON lon + 9 >= x0 AND lon <= x1 AND lat + 4 >= y0 AND lat <= y1 GROUP BY id""")
def find_intersecting(spark, d):
    """J14 D17"""
    o = _points_as_boxes(spark, d).withColumns({"max_x": F.col("max_x") + 9, "max_y": F.col("max_y") + 4})
    return S.find_names(o, D.nation_boxes(spark, d), 20.0).select("id", F.array_join("names", ",").alias("names"))


@query(f"WITH {D.NODES}, {D.BOXES} SELECT id, name FROM nodes JOIN boxes ON lon >= x0 AND lon + 9 <= x1 AND lat >= y0 AND lat + 4 <= y1")
def covered_by(spark, d):
    """J15 J16 J22"""
    o = _points_as_boxes(spark, d).withColumns({"max_x": F.col("max_x") + 9, "max_y": F.col("max_y") + 4})
    return S.candidates(o, D.nation_boxes(spark, d), 20.0).where(S.box_covers()).select("id", "name")


@query(f"""WITH {D.NODES}, {D.BOXES} SELECT id, CAST(round(sum((least(lon + 9, x1) - greatest(lon, x0)) * (least(lat + 4, y1) - greatest(lat, y0))) * 1e4) AS BIGINT) AS area_e4
 FROM nodes JOIN boxes ON lon + 9 >= x0 AND lon <= x1 AND lat + 4 >= y0 AND lat <= y1 GROUP BY id""")
def area_intersecting(spark, d):
    """J17"""
    o = _points_as_boxes(spark, d).withColumns({"max_x": F.col("max_x") + 9, "max_y": F.col("max_y") + 4})
    return S.area_intersecting(o, D.nation_boxes(spark, d), 20.0).select("id", F.round(F.col("area") * 1e4).cast("long").alias("area_e4"))


@query(f"WITH {D.NODES} SELECT CAST(round(min(lon) * 1e4) AS BIGINT) AS min_lon, CAST(round(min(lat) * 1e4) AS BIGINT) AS min_lat, CAST(round(max(lon) * 1e4) AS BIGINT) AS max_lon, CAST(round(max(lat) * 1e4) AS BIGINT) AS max_lat FROM nodes")
def bbox_of_inputs(spark, d):
    """A17"""
    b = O.bbox_union(D.nodes(spark, d))
    return b.select(*[F.round(F.col(c) * 1e4).cast("long").alias(c) for c in b.columns])


@query(f"""WITH {D.REFS}, g AS (SELECT id, pos, ref % 4 AS v, lag(ref % 4) OVER (PARTITION BY id ORDER BY pos) AS before FROM refs)
SELECT id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS kept FROM g WHERE before IS NULL OR before <> v GROUP BY id""")
def repeats_dropped(spark, d):
    """W6 F17"""
    w = D.ways(spark, d).select("id", F.transform("refs", lambda r: r % 4).alias("v"))
    return w.select("id", F.array_join(O.drop_repeats(F.col("v")), ",").alias("kept"))


# PMTiles directory


@query(f"""WITH {D.NODES}, t AS (SELECT id, 8 AS z, {D.tile(8)} FROM nodes), h AS (SELECT x * 256 + y AS tile_id, count(*) % 3 AS body FROM t GROUP BY ALL),
l AS (SELECT *, CASE WHEN lag(tile_id) OVER (ORDER BY tile_id) = tile_id - 1 AND lag(body) OVER (ORDER BY tile_id) = body THEN 0 ELSE 1 END AS new FROM h),
g AS (SELECT *, sum(new) OVER (ORDER BY tile_id) AS run FROM l) SELECT min(tile_id) AS tile_id, any_value(body) AS body, count(*) AS run_length FROM g GROUP BY run""")
def pmtiles_rle(spark, d):
    """K5 K6 W3"""
    from tessella.sinks.pmtiles import run_lengths

    t = T.index_points(D.nodes(spark, d), 8)
    h = t.groupBy((F.col("x") * 256 + F.col("y")).cast("long").alias("tile_id")).agg((F.count("*") % 3).alias("body"))
    return run_lengths(h, "body")


# rules of the shipped profiles


@query("""WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'town' WHEN 2 THEN 'village' ELSE 'country' END AS place,
 (c_custkey * 7919) % 60000000 AS pop, CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '4' WHEN 2 THEN 'no' ELSE '' END AS capital FROM customer),
k AS (SELECT *, CASE WHEN capital = 'yes' THEN 2 WHEN capital = '4' THEN 4 END AS level FROM c),
r AS (SELECT *, CASE WHEN level BETWEEN 2 AND 4 THEN level + CASE WHEN pop > 3000000 THEN -2 WHEN pop > 1000000 THEN -1 WHEN pop < 100000 THEN 2 ELSE 0 END
  + CASE WHEN place = 'city' THEN 0 WHEN place = 'town' THEN 3 ELSE 5 END
 WHEN place NOT IN ('city', 'town') THEN NULL WHEN pop > 3000000 THEN 1 WHEN pop > 1000000 THEN 2 WHEN pop > 500000 THEN 3 WHEN pop > 200000 THEN 4 WHEN pop > 100000 THEN 5
 WHEN pop > 75000 THEN 6 WHEN pop > 50000 THEN 7 WHEN pop > 25000 THEN 8 WHEN pop > 10000 THEN 9 ELSE 10 END AS base FROM k)
SELECT id, level AS capital, CASE WHEN place = 'country' THEN CASE WHEN pop > 50000000 THEN 1 WHEN pop > 20000000 THEN 2 ELSE 3 END ELSE base END AS rank,
 CASE place WHEN 'country' THEN CASE WHEN pop > 50000000 THEN 1 WHEN pop > 20000000 THEN 2 ELSE 3 END WHEN 'city' THEN 5 WHEN 'town' THEN CASE WHEN pop > 8000 THEN 7 ELSE 8 END ELSE CASE WHEN pop > 2000 THEN 9 ELSE 10 END END AS minzoom FROM r""")
def place_rank(spark, d):
    """M1 M2"""
    k = F.col("c_custkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int"))
    tags = F.create_map(
        F.lit("place"), pick(4, "city", "town", "village", "country"), F.lit("population"), ((k * 7919) % 60000000).cast("string"), F.lit("capital"), pick(5, "yes", "4", "no", "", "")
    )
    t = D.table(spark, d, "customer").select(k.alias("id"), tags.alias("tags"))
    found = rules.place_attributes(F.col("tags"))
    return t.select("id", found["capital"].alias("capital"), found["rank"].alias("rank"), found["minzoom"].alias("minzoom"))


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS h, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 7 AS DOUBLE) END AS levels, CASE WHEN p_partkey % 5 = 0 THEN 30::DOUBLE END AS low FROM part),
r AS (SELECT id, coalesce(h, levels * 3.66::DOUBLE, 3.66::DOUBLE) AS a, coalesce(low, 0) AS b FROM p)
SELECT id, CAST(round((CASE WHEN a < b THEN a + b ELSE a END) * 100) AS BIGINT) AS height_cm, CAST(round(b * 100) AS BIGINT) AS base_cm FROM r""")
def building_height(spark, d):
    """M11"""
    k, s = F.col("p_partkey"), F.col("p_size")
    e = F.lit(None).cast("string")
    tags = F.create_map(
        F.lit("height"), F.when(k % 3 == 0, s.cast("string")).otherwise(e), F.lit("building:levels"), F.when(k % 2 == 0, (s % 7).cast("string")).otherwise(e),
        F.lit("min_height"), F.when(k % 5 == 0, F.lit("30")).otherwise(e),
    )
    t = D.table(spark, d, "part").select(k.alias("id"), tags.alias("tags"))
    height, base = rules.building_heights(F.col("tags"))
    return t.select("id", F.round(height * 100).cast("long").alias("height_cm"), F.round(base * 100).cast("long").alias("base_cm"))


@query("""WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 9 WHEN 1 THEN 8 WHEN 2 THEN 6 WHEN 3 THEN 5 WHEN 4 THEN 4 ELSE 3 END AS cls, o_orderkey % 3 AS b, o_orderkey % 23 - 11 AS layer FROM orders)
SELECT id, (cls + CASE b WHEN 0 THEN 10 WHEN 1 THEN -10 ELSE 0 END + CASE WHEN layer > 7 THEN 7 WHEN layer < -7 THEN -7 ELSE layer END * 10) * 10 AS z_order FROM o""")
def road_z_order(spark, d):
    """M12 X15"""
    k = F.col("o_orderkey")
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % n + 1).cast("int"))
    tags = F.create_map(
        F.lit("highway"), pick(6, "motorway", "trunk", "primary", "secondary", "tertiary", "path"), F.lit("bridge"), pick(3, "yes", "no", ""),
        F.lit("tunnel"), pick(3, "yes", "yes", "no"), F.lit("layer"), (k % 23 - 11).cast("string"),
    )
    t = D.table(spark, d, "orders").select(k.alias("id"), tags.alias("tags"))
    return t.select("id", P.encode_z_order(rules.road_order(F.col("tags"))).cast("long").alias("z_order"))


@query("""WITH o AS (SELECT o_orderkey AS id, pow((o_orderkey % 9000)::DOUBLE, 2) AS area FROM orders)
SELECT id, CASE WHEN area > 4891.97 * 4891.97 THEN 6 WHEN area > 2445.98 * 2445.98 THEN 7 WHEN area > 1222.99 * 1222.99 THEN 8 WHEN area > 611.5 * 611.5 THEN 9 WHEN area > 305.7 * 305.7 THEN 10
 WHEN area > 152.9 * 152.9 THEN 11 WHEN area > 76.4 * 76.4 THEN 12 WHEN area > 38.2 * 38.2 THEN 13 ELSE 14 END AS minzoom,
 CASE WHEN area > 305.7 * 305.7 THEN 10 WHEN area > 152.9 * 152.9 THEN 11 WHEN area > 76.4 * 76.4 THEN 12 WHEN area > 38.2 * 38.2 THEN 13 ELSE 14 END AS limited FROM o""")
def min_zoom_by_area(spark, d):
    """M10"""
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.pow((F.col("o_orderkey") % 9000).cast("double"), F.lit(2.0)).alias("area"))
    return o.select("id", rules.zoom_by_area(F.col("area")).alias("minzoom"), rules.zoom_by_area(F.col("area"), 10).alias("limited"))


@query("""SELECT s_suppkey AS id, CAST(floor(s_acctbal) AS BIGINT) AS ele, CAST(floor(floor(s_acctbal) * 3.2808399::DOUBLE) AS BIGINT) AS ele_ft,
 CASE s_suppkey % 4 WHEN 0 THEN 'bridge' WHEN 1 THEN 'tunnel' WHEN 2 THEN 'ford' END AS brunnel, s_name AS name_latin, CASE WHEN s_suppkey % 2 = 0 THEN 'de ' || s_name END AS name_de FROM supplier""")
def names_and_heights(spark, d):
    """M8 M9"""
    k = F.col("s_suppkey")
    yes = lambda i: F.when(k % 4 == i, F.lit("yes")).otherwise(F.lit("no"))
    tags = F.create_map(
        F.lit("ele"), F.col("s_acctbal").cast("string"), F.lit("bridge"), yes(0), F.lit("tunnel"), yes(1), F.lit("ford"), yes(2), F.lit("name"), F.col("s_name"),
        F.lit("name:de"), F.when(k % 2 == 0, F.concat(F.lit("de "), "s_name")).otherwise(F.lit("")),
    )
    t = D.table(spark, d, "supplier").select(k.alias("id"), tags.alias("tags"))
    ele, feet = rules.elevation(F.col("tags"))
    names = A.attribute_set(*rules.names(F.col("tags"), languages=("de",)))
    pick = lambda key: F.element_at(F.transform(F.filter(names, lambda a: a["key"] == key), lambda a: a["s"]), 1)
    at = lambda key: F.when(F.exists(names, lambda a: a["key"] == key), pick(key))
    return t.select("id", ele.cast("long").alias("ele"), feet.cast("long").alias("ele_ft"), rules.brunnel(F.col("tags")).alias("brunnel"), at("name:latin").alias("name_latin"), at("name:de").alias("name_de"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'glacier' WHEN 1 THEN 'ice_shelf' END AS subclass,
 CASE c_custkey % 4 WHEN 2 THEN 'residential' WHEN 3 THEN CASE WHEN c_custkey % 8 = 3 THEN 'ocean' ELSE c_mktsegment END END AS class FROM customer""")
def remap_attributes(spark, d):
    """M6 M15 P6 L24"""
    k = F.col("c_custkey")
    cla = F.element_at(F.array(F.lit("Glaciated areas"), F.lit("Antarctic Ice Shelf"), F.lit("Urban area"), F.lit("Lake")), (k % 4 + 1).cast("int"))
    props = F.create_map(F.lit("featurecla"), cla, F.lit("class"), F.col("c_mktsegment"))
    layer = F.when(k % 8 == 3, "ocean").otherwise("land")
    t = D.table(spark, d, "customer").select(k.alias("id"), rules.remap_external(props, layer).alias("p"))
    return t.select("id", F.col("p")["subclass"].alias("subclass"), F.col("p")["class"].alias("class"))


# geometry kernels, tiles and containers: no SQL can say what they give, tests do


def _way_lines(spark, d):
    """Ways as lines in lon/latp: id and WKB."""
    from tessella.plans.build import line_of

    return line_of(R.way_coordinates(D.ways(spark, d), D.part_nodes(spark, d)))


def _boxes_as_features(spark, d):
    """Nation boxes as polygon features of layer `land`, points of orders as `poi`."""
    from tessella.plans.build import box_polygon, point_geometry

    no_attrs = A.attribute_set(A.attribute("name", F.col("name")))
    b = D.nation_boxes(spark, d)
    polys = b.select(
        (F.col("shape_id") * 4 + 3).cast("long").alias("feature_id"), F.col("shape_id").cast("long").alias("osm_id"), F.lit(1).alias("source_pos"), F.lit("land").alias("layer"),
        F.lit(3).alias("geom_type"), box_polygon("s_min_x", "s_min_y", "s_max_x", "s_max_y").alias("geom"), no_attrs.alias("attrs"), F.lit(0).alias("fmin"), F.lit(0).alias("z_order"),
    )
    n = D.nodes(spark, d)
    points = n.select(
        (F.col("id") * 4).alias("feature_id"), F.col("id").alias("osm_id"), F.lit(0).alias("source_pos"), F.lit("poi").alias("layer"), F.lit(0).alias("geom_type"),
        point_geometry("lon", "latp").alias("geom"), A.attribute_set(A.attribute("status", F.col("tags")["status"])).alias("attrs"), (F.col("id") % 7).cast("int").alias("fmin"), F.lit(0).alias("z_order"),
    )
    return polys.unionByName(points)


def _tile_config():
    from tessella.sources.config import parse

    layers = {"poi": {"minzoom": 0, "maxzoom": 5, "feature_limit": 50, "feature_limit_below": 4}, "land": {"minzoom": 0, "maxzoom": 5, "simplify_below": 3, "filter_below": 2, "combine_polygons_below": 2}}
    settings = {"minzoom": 0, "maxzoom": 5, "basezoom": 5, "include_ids": True, "name": "q", "version": "1", "description": "", "compress": "gzip"}
    return parse({"settings": settings, "layers": layers})


@query(f"""WITH {D.REFS}, c AS (SELECT r.id, pos, radians({D.LON.format(k="p_partkey")}) AS lon, radians({D.LAT.format(k="p_partkey")}) AS lat FROM refs r JOIN part ON p_partkey = ref),
s AS (SELECT id, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM c WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id, CAST(round(sum(CASE WHEN lon2 IS NULL THEN 0 ELSE 2 * 6371000::DOUBLE * asin(sqrt(least(pow(sin((lat2 - lat) / 2), 2) + cos(lat) * cos(lat2) * pow(sin((lon2 - lon) / 2), 2), 1::DOUBLE))) END)) AS BIGINT) AS metres FROM s GROUP BY id""")
def way_length(spark, d):
    """G23 L22"""
    from tessella.plans.build import line_length

    w = R.way_coordinates(D.ways(spark, d), D.part_nodes(spark, d))
    return w.select("id", F.round(line_length(F.col("coords"))).cast("long").alias("metres"))


@query(f"""WITH {D.BOXES} SELECT shape_id AS id, CAST(round((x1 - x0) * (y1 - y0)) AS BIGINT) AS square_degrees, 5 AS points FROM boxes""")
def box_measures(spark, d):
    """G22 G24"""
    from tessella.kernels import overlay, wkb
    from tessella.plans.build import box_polygon

    b = D.nation_boxes(spark, d).select("shape_id", box_polygon("s_min_x", "s_min_y", "s_max_x", "s_max_y", projected=False).alias("g"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            polys = [wkb.polygons(bytes(g)) for g in pdf["g"]]
            yield pd.DataFrame({"id": pdf["shape_id"], "square_degrees": [round(overlay.area(p)) for p in polys], "points": [len(p[0][0]) for p in polys]})

    return b.mapInPandas(run, "id int, square_degrees long, points int")


def _of_lines(spark, d, measure, *names):
    """Whole numbers of every way's line: measure takes how many points lines have, and the points of some thousand lines."""
    import numpy as np
    import pyarrow as pa

    from tessella.kernels import batches as B

    def run(batches):
        for b in batches:
            ok, n = B.plain_lines(b.column(1))
            if not ok.all():
                raise ValueError("not a line")
            for some in B.few(n, 20000):
                made = measure(n[some], B.line_points(b.column(1), np.arange(len(n))[some], n)[1])
                yield pa.RecordBatch.from_arrays([b.column(0)[some], *[pa.array(v.astype(np.int32)) for v in made]], names=["id", *names])

    return _way_lines(spark, d).mapInArrow(run, ", ".join(["id long", *[f"{n} int" for n in names]]))


@query()
def line_coverage(spark, d):
    """G1 G2 G3 G4 G5 J20 J21"""
    import numpy as np

    from tessella.kernels import batches as B

    def measure(n, xy):
        tiles = B.covered_by_lines(np.repeat(np.arange(len(n)), n), xy, 6)
        return np.bincount(tiles[0], minlength=len(n)), B.fill_sizes(*tiles, len(n))

    return _of_lines(spark, d, measure, "n_tiles", "n_filled")


@query()
def line_simplify(spark, d):
    """G10 G12 X10 F17"""
    from tessella.kernels import batches as B
    from tessella.kernels.protobuf import row_sums

    def measure(n, xy):
        return n, row_sums(B.douglas_peucker(n, xy, 20.0), n), row_sums(B.visvalingam(n, xy, 20.0), n), B.pixel_counts(n, xy, (-180, -180, 180, 180))

    return _of_lines(spark, d, measure, "n", "n_dp", "n_vis", "n_pixels")


@query()
def clipped_pieces(spark, d):
    """G6 G7 G8 G9 G25 F8 F9 R11"""
    from tessella.operators.render import pieces

    p = pieces(_boxes_as_features(spark, d), _tile_config())
    return p.groupBy("z", "x", "y", "layer_id").agg(F.count("*").alias("n"), F.min("feature_id").alias("first_id"))


@query()
def encoded_tiles(spark, d):
    """A5 A6 A8 G11 G14 G15 G18 G19 F15 F18 K19 W1"""
    from tessella.plans.build import encoded

    t = encoded(_boxes_as_features(spark, d), _tile_config())
    return t.select("z", "x", "y", F.length("data").alias("n_bytes"), F.sha2("data", 256).alias("digest"))


@query()
def decoded_tiles(spark, d):
    """S30 K13"""
    import pandas as pd

    from tessella.kernels import mvt
    from tessella.plans.build import encoded

    def run(batches):
        for pdf in batches:
            rows = [
                (z, x, y, la.name, la.extent, len(la.features), sum(len(f.geometry) for f in la.features))
                for z, x, y, b in zip(pdf["z"], pdf["x"], pdf["y"], pdf["data"], strict=True) for la in mvt.decode(bytes(b))
            ]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "extent", "n_features", "n_parts"])

    return encoded(_boxes_as_features(spark, d), _tile_config()).mapInPandas(run, "z int, x int, y int, layer string, extent int, n_features int, n_parts int")


@query()
def pmtiles_entries(spark, d):
    """K4 K5 K6 O3"""
    from tessella.plans.build import encoded
    from tessella.sinks.pmtiles import place

    return place(encoded(_boxes_as_features(spark, d), _tile_config()))[0]


@query("""WITH c AS (SELECT o_custkey AS rel, count(*) AS n, CAST((count(*) + 1) // 2 AS INTEGER) AS k FROM orders GROUP BY o_custkey)
SELECT rel, k AS n_ways, CASE WHEN n > 2 THEN 1 ELSE 0 END AS n_rings, 0 AS n_chains, CASE WHEN k = 1 THEN 1 WHEN k % 2 = 1 THEN k - 1 ELSE k END AS n_stitched FROM c""")
def ring_assembly(spark, d):
    """A7 A9 A10 A11 J12"""
    import pandas as pd

    from tessella.kernels import lines as K

    # each customer's orders as an outline of their points, cut in ways of three points that share ends
    o = D.table(spark, d, "orders").select(F.col("o_custkey").alias("rel"), F.struct(F.col("o_orderkey").alias("id"), D.lon_of("o_orderkey").alias("lon"), D.lat_of("o_orderkey").alias("lat")).alias("p"))
    g = o.groupBy("rel").agg(F.sort_array(F.collect_list("p")).alias("p"))

    def run(batches):
        for pdf in batches:
            rows = []
            for rel, pts in zip(pdf["rel"], pdf["p"], strict=True):
                ring = [(q["lon"], q["lat"]) for q in pts]
                ring.append(ring[0])
                ways = [ring[i : i + 3] for i in range(0, len(ring) - 1, 2)]
                ways = [w[::-1] if i % 2 else w for i, w in enumerate(ways)]
                rings, chains = K.assemble_rings(ways)
                rows.append((rel, len(ways), len(rings), len(chains), len(K.stitch(ways))))
            yield pd.DataFrame(rows, columns=["rel", "n_ways", "n_rings", "n_chains", "n_stitched"])

    return g.mapInPandas(run, "rel long, n_ways int, n_rings int, n_chains int, n_stitched int")


@query()
def label_points(spark, d):
    """G20 G21 H8"""
    import pandas as pd

    from tessella.kernels import lines as K
    from tessella.kernels import wkb
    from tessella.plans.build import box_polygon

    def run(batches):
        for pdf in batches:
            rows = []
            for i, g in zip(pdf["shape_id"], pdf["g"], strict=True):
                p = wkb.polygons(bytes(g))
                (a, b), (c, e) = K.label_point(p), K.label_point(p, "centroid")
                rows.append((i, round(a), round(b), round(c, 3), round(e, 3)))
            yield pd.DataFrame(rows, columns=["id", "pole_x", "pole_y", "centre_x", "centre_y"])

    b = D.nation_boxes(spark, d).select("shape_id", box_polygon("s_min_x", "s_min_y", "s_max_x", "s_max_y").alias("g"))
    return b.mapInPandas(run, "id int, pole_x long, pole_y long, centre_x double, centre_y double")


@query("""WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 1000) * 100.0::DOUBLE AS area FROM orders),
z AS (SELECT id, CASE WHEN area > 305.7 * 305.7 THEN 10 WHEN area > 152.9 * 152.9 THEN 11 WHEN area > 76.4 * 76.4 THEN 12 WHEN area > 38.2 * 38.2 THEN 13 ELSE 14 END AS z FROM o)
SELECT 'building' AS layer, z AS fmin, count(*) AS n, 2 * count(*) AS n_attrs FROM z WHERE id % 5 = 0 GROUP BY z
UNION ALL SELECT 'poi_detail', NULL, count(*), 2 * count(*) FROM z WHERE id % 5 = 0 AND id % 7 <> 0 HAVING count(*) > 0
UNION ALL SELECT 'transportation', 12, count(*), 4 * count(*) FROM z WHERE id % 3 = 0 HAVING count(*) > 0
UNION ALL SELECT 'water', z, count(*), count(*) FROM z WHERE id % 7 = 0 GROUP BY z UNION ALL SELECT 'water_name_detail', z, count(*), 2 * count(*) FROM z WHERE id % 7 = 0 GROUP BY z""")
def profile_features(spark, d):
    """P1 P2 P9 P11 L7 M5 M14"""
    o = D.spread(D.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"))
    tags = F.create_map(
        F.lit("highway"), F.when(F.col("o_orderkey") % 3 == 0, "residential").otherwise(""), F.lit("building"), F.when(F.col("o_orderkey") % 5 == 0, "yes").otherwise(""),
        F.lit("name"), F.col("o_orderpriority"), F.lit("natural"), F.when(F.col("o_orderkey") % 7 == 0, "water").otherwise(""),
    )
    rows = o.select(F.col("o_orderkey").alias("id"), tags.alias("tags"), F.lit(True).alias("closed"), (F.col("o_orderkey") % 1000 * 100.0).alias("area"), F.lit(None).cast("double").alias("admin_level"))
    found = rules.apply(rows, rules.schema_ways(F.col("tags")))
    return found.groupBy("layer", "fmin").agg(F.count("*").alias("n"), F.sum(F.size("attrs")).alias("n_attrs"))


_POI_VALUES = ("bench", "bar", "parking", "waste_basket", "post_box", "charging_station", "school", "vending_machine", "hospital", "cafe", "fountain")
_POI_OF = {"bar": (22, "bar"), "parking": (25, "amenity"), "waste_basket": (25, "amenity"), "post_box": (16, "post"), "school": (7, "school"), "hospital": (1, "hospital"), "cafe": (25, "cafe")}


@query(f"""WITH o AS (SELECT o_orderkey AS id, ({list(_POI_VALUES)!r})[CAST(o_orderkey % {len(_POI_VALUES)} + 1 AS INTEGER)] AS v, CASE WHEN o_orderkey % 3 = 0 THEN 'common' ELSE 'park' END AS l FROM orders),
a AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {r}, '{c}')" for k, (r, c) in _POI_OF.items())}) t(v, rank, class))
SELECT id, CASE WHEN a.v IS NOT NULL THEN a.rank WHEN l = 'park' THEN 13 END AS rank, CASE WHEN a.v IS NOT NULL THEN a.class WHEN l = 'park' THEN 'park' END AS class,
 CASE WHEN a.v IS NOT NULL THEN a.v WHEN l = 'park' THEN 'park' END AS subclass FROM o LEFT JOIN a USING (v)""")
def poi_values(spark, d):
    """M7: amenities and leisure that count, with rank and class; others are no point of interest"""
    k = F.col("o_orderkey")
    value = F.element_at(F.array(*[F.lit(v) for v in _POI_VALUES]), (k % len(_POI_VALUES) + 1).cast("int"))
    tags = F.create_map(F.lit("amenity"), value, F.lit("leisure"), F.when(k % 3 == 0, "common").otherwise("park"))
    t = D.table(spark, d, "orders").select(k.alias("id"), tags.alias("tags")).select("id", rules.poi(F.col("tags")).alias("p"))
    return t.select("id", "p.rank", "p.class", "p.subclass")
