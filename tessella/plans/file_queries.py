"""Registered queries over files: each writes its tables in a format, reads them back by the engine's reader, and has SQL over
the tables. Files go to the folder that driver and executors share, a file per task, and only reported files are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella import storage
from tessella.functions import attributes as A
from tessella.kernels import wkb
from tessella.operators import pyramid as T
from tessella.plans import derived as D
from tessella.plans.queries import query
from tessella.sinks import compression, directory, mbtiles, metadata, pmtiles
from tessella.sources import config as C
from tessella.sources import geojson, osm_pbf, shapefile

# OSM PBF: nodes from orders, ways from lineitem, relations from customer

_LON_E7, _LAT_E7 = "CAST(({k} * 7919) % 3600000 * 1000 - 1800000000 AS INTEGER)", "CAST(({k} * 104729) % 1700000 * 1000 - 850000000 AS INTEGER)"


def _e7(key: str) -> tuple[Column, Column]:
    return tuple(F.expr(x.format(k=key)) for x in (_LON_E7, _LAT_E7))


def _objects(spark, d) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    lon, lat = _e7("o_orderkey")
    members, tags = "array<struct<type:int,ref:long,role:string>>", "map<string,string>"
    o = D.table(spark, d, "orders")
    nodes = o.select(
        F.lit(0).alias("kind"), F.col("o_orderkey").alias("id"), lat.alias("lat_e7"), lon.alias("lon_e7"), none("array<long>").alias("refs"),
        F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("tags"), none(members).alias("members"),
    )
    ways = D.ways(spark, d).select(F.lit(1), "id", none("int"), none("int"), "refs", F.create_map(F.lit("lines"), F.size("refs").cast("string")), none(members))
    rels = D.relations(spark, d).select(
        F.lit(2), "id", none("int"), none("int"), none("array<long>"), F.col("tags").cast(tags), F.transform("members", lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref"), m["role"].alias("role")))
    )
    return nodes.union(ways).union(rels).repartition("kind", "id")


def _written(spark, d, **options) -> str:
    return ",".join(osm_pbf.write_parts(_objects(spark, d), storage.new_folder(spark, "pbf"), per_block=500, **options))


@query(f"""SELECT o_orderkey AS id, {_LAT_E7.format(k="o_orderkey")} AS lat_e7, {_LON_E7.format(k="o_orderkey")} AS lon_e7, o_orderstatus AS status, o_orderpriority AS priority FROM orders""")
def pbf_nodes(spark, d):
    """S1 S3 S5 S6 S10"""
    n = osm_pbf.read(spark, _written(spark, d), "node")
    return n.select("id", "lat_e7", "lon_e7", F.col("tags")["status"].alias("status"), F.col("tags")["priority"].alias("priority"))


@query(f"""SELECT o_orderkey AS id, {_LAT_E7.format(k="o_orderkey")} AS lat_e7, {_LON_E7.format(k="o_orderkey")} AS lon_e7, o_orderstatus AS status FROM orders""")
def pbf_plain_nodes(spark, d):
    """Nodes one by one instead of dense, blobs stored raw"""
    n = osm_pbf.read(spark, _written(spark, d, dense=False, raw=True), "node")
    return n.select("id", "lat_e7", "lon_e7", F.col("tags")["status"].alias("status"))


@query(f"""WITH {D.REFS} SELECT id, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY pos) AS refs, CAST(count(*) AS VARCHAR) AS lines FROM refs GROUP BY id""")
def pbf_ways(spark, d):
    """S8"""
    w = osm_pbf.read(spark, _written(spark, d), "way")
    return w.select("id", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("refs"), F.col("tags")["lines"].alias("lines"))


@query("""SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS admin_level, count(*) AS n, string_agg(o_orderkey || ' ' || o_orderpriority, ',' ORDER BY o_orderkey) AS members
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def pbf_relations(spark, d):
    """S9"""
    r = osm_pbf.read(spark, _written(spark, d), "relation")
    listed = F.array_join(F.transform("members", lambda m: F.concat_ws(" ", m["ref"].cast("string"), m["role"])), ",")
    return r.select("id", F.col("tags")["admin_level"].alias("admin_level"), F.size("members").cast("long").alias("n"), listed.alias("members"))


@query("""SELECT 'node' AS kind, count(*) AS n, sum(o_orderkey) AS ids FROM orders UNION ALL SELECT 'way', count(DISTINCT l_orderkey), sum(DISTINCT l_orderkey) FROM lineitem
UNION ALL SELECT 'relation', count(DISTINCT o_custkey), sum(DISTINCT o_custkey) FROM orders JOIN customer ON o_custkey = c_custkey""")
def pbf_blocks(spark, d):
    """Each kind's blocks are found by binary search in sorted files; together they hold every object once"""
    path, out = _written(spark, d), None
    for kind in osm_pbf.KINDS:
        n = osm_pbf.read(spark, path, kind).agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(kind).alias("kind"), "n", "ids")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT -180.0::DOUBLE AS min_lon, -85.0511::DOUBLE AS min_lat, 180.0::DOUBLE AS max_lon, 85.0511::DOUBLE AS max_lat, true AS sorted, false AS located")
def pbf_headers(spark, d):
    """Boxes and features of all headers"""
    paths = _written(spark, d, bbox=(-180.0, -85.0511, 180.0, 85.0511)).split(",")
    heads = [osm_pbf.read_header(p) for p in paths]
    rows = [(*h.bbox, osm_pbf.SORTED in h.features, osm_pbf.LOCATIONS in h.features) for h in heads]
    h = spark.createDataFrame(rows, "min_lon double, min_lat double, max_lon double, max_lat double, sorted boolean, located boolean")
    return h.agg(*[f(c).alias(c) for f, c in ((F.min, "min_lon"), (F.min, "min_lat"), (F.max, "max_lon"), (F.max, "max_lat"), (F.bool_and, "sorted"), (F.bool_or, "located"))])


# shapefiles

#: Records from which a task begins another file: it holds a file's records until they are written.
RECORDS = 100000


def _shape_parts(rows: DataFrame, folder: str, kind: int, columns: list[tuple[str, str, int, int]]) -> list[str]:
    """Shapefiles of some RECORDS of each partition of rows (shape: JSON of its points or parts, values: its texts); their paths."""
    import json

    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        shapes, texts, n = [], [], 0
        task = TaskContext.get()

        def written():
            base = f"{folder}/part-{task.partitionId()}-{task.taskAttemptId()}-{n}"
            shapefile.write(base, kind, shapes, columns, texts)
            return pa.RecordBatch.from_arrays([pa.array([base + ".shp"])], names=["path"])

        for b in batches:
            shapes += [json.loads(s) for s in b.column(0).to_pylist()]
            texts += b.column(1).to_pylist()
            if len(shapes) >= RECORDS:
                yield written()
                shapes, texts, n = [], [], n + 1
        if shapes:
            yield written()

    return sorted(r.path for r in rows.select("shape", "values").mapInArrow(run, "path string").collect())


@query(f"""SELECT o_orderkey AS id, CAST(round(({D.LON.format(k="o_orderkey")}) * 10000) AS BIGINT) AS lon_e4, CAST(round(({D.LAT.format(k="o_orderkey")}) * 10000) AS BIGINT) AS lat_e4,
 o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END AS urgent, 'cents=2,id=1,status=0,urgent=3' AS types
FROM orders WHERE {D.LON.format(k="o_orderkey")} > -30.25005 AND {D.LON.format(k="o_orderkey")} < 99.75005 AND {D.LAT.format(k="o_orderkey")} > -20.70005 AND {D.LAT.format(k="o_orderkey")} < 60.20005""")
def shapefile_points(spark, d):
    """Points and their table, only records within a box"""
    o = D.table(spark, d, "orders")
    money = F.format_string("%.2f", "o_totalprice")
    rows = o.select(
        F.to_json(F.array(D.lon_of("o_orderkey"), D.lat_of("o_orderkey"))).alias("shape"),
        F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", money, F.when(F.col("o_orderpriority") == "1-URGENT", "T").otherwise("F")).alias("values"),
    )
    paths = _shape_parts(rows, storage.new_folder(spark, "shp"), 1, [("id", "N", 12, 0), ("status", "C", 1, 0), ("cents", "N", 16, 2), ("urgent", "L", 1, 0)])
    found = shapefile.read(spark, ",".join(paths), (-30.25005, -20.70005, 99.75005, 60.20005))
    p, e4 = F.col("properties"), lambda at: F.round(_double("geom", at) * 10000).cast("long")
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return found.select(
        p["id"].cast("long").alias("id"), e4(0).alias("lon_e4"), e4(1).alias("lat_e4"), p["status"].alias("status"),
        F.round(p["cents"].cast("double") * 100).cast("long").alias("cents"), p["urgent"].alias("urgent"), kinds.alias("types"),
    )


def _double(column: str, k: int) -> Column:
    """A point's coordinate k in WKB."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def run(s):
        return s.map(lambda b: wkb.load(bytes(b))[1][k])

    return run(column)


def _measured(rows: DataFrame, *keep: str) -> DataFrame:
    """keep, parts, points and area (0 unless an area) of rows with geom (WKB)."""
    import pyarrow as pa

    from tessella.kernels import overlay

    def measure(data):
        kind, g = wkb.load(bytes(data))
        if kind in (wkb.POLYGON, wkb.MULTIPOLYGON):
            polys = [g] if kind == wkb.POLYGON else g
            return sum(len(p) for p in polys), sum(len(r) for p in polys for r in p), round(overlay.area(polys))
        if kind in (wkb.LINE, wkb.MULTILINE):
            ls = [g] if kind == wkb.LINE else g
            return len(ls), sum(map(len, ls)), 0
        return 1, 1, 0

    def run(batches):
        for b in batches:
            found = [measure(x) for x in b.column(len(keep)).to_pylist()]
            made = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=[*keep, "parts", "points", "area"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "geom").mapInArrow(run, f"{kinds}, parts long, points long, area long")


def _box_shapes(spark, d) -> DataFrame:
    """Nation boxes with JSON of a clockwise outer ring, a hole 10 degrees within it, and their corners."""
    b = D.nation_boxes(spark, d)
    ring = lambda *p: F.array(*[F.array(x, y) for x, y in p])
    w, s, e, n = (F.col(c) for c in ("s_min_x", "s_min_y", "s_max_x", "s_max_y"))
    return b.select(
        "shape_id", "name", ring((w, s), (w, n), (e, n), (e, s), (w, s)).alias("outer"), ring((w + 10, s + 10), (e - 10, s + 10), (e - 10, n - 10), (w + 10, n - 10), (w + 10, s + 10)).alias("hole"),
        ring((w, s), (e, s), (e, n)).alias("walls"), ring((w, s), (w, n)).alias("side"),
    )


@query(f"""WITH {D.BOXES} SELECT 'area' AS shape, name, 2 AS parts, 10 AS points, CAST(round((x1 - x0) * (y1 - y0) - (x1 - x0 - 20) * (y1 - y0 - 20)) AS BIGINT) AS area FROM boxes
UNION ALL SELECT 'line', name, 1, 3, 0 FROM boxes UNION ALL SELECT 'line', name, 1, 2, 0 FROM boxes UNION ALL SELECT 'point', name, 1, 1, 0 FROM boxes, range(3) t(i)""")
def shapefile_shapes(spark, d):
    """An area with a hole, a line of two parts, three points, of each nation"""
    b, out = _box_shapes(spark, d), None
    for name, kind, shape in (("area", 5, F.array("outer", "hole")), ("line", 3, F.array("walls", "side")), ("point", 8, F.array("walls"))):
        rows = b.select(F.to_json(shape).alias("shape"), F.array("name").alias("values"))
        paths = _shape_parts(rows, storage.new_folder(spark, "shp"), kind, [("name", "C", 40, 0)])
        found = _measured(shapefile.read(spark, ",".join(paths)).select(F.lit(name).alias("shape"), F.col("properties")["name"].alias("name"), "geom"), "shape", "name")
        out = found if out is None else out.unionByName(found)
    return out.select("shape", "name", F.col("parts").cast("int").alias("parts"), F.col("points").cast("int").alias("points"), "area")


@query("SELECT n_name AS name, 'name=' || n_name AS properties FROM nation")
def shapefile_columns(spark, d):
    """only the columns that are asked for"""
    b = _box_shapes(spark, d)
    rows = b.select(F.to_json(F.array("outer")).alias("shape"), F.array(F.col("shape_id").cast("string"), "name").alias("values"))
    paths = _shape_parts(rows, storage.new_folder(spark, "shp"), 5, [("id", "N", 8, 0), ("name", "C", 40, 0)])
    found = shapefile.read(spark, ",".join(paths), columns=["name"])
    listed = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select(F.col("properties")["name"].alias("name"), listed.alias("properties"))


# GeoJSON


def _feature(geometry: Column, properties: Column, **more: Column) -> Column:
    """JSON text of a feature."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), *[v.alias(k) for k, v in more.items()], geometry.alias("geometry"), properties.alias("properties")))


def _geometry(kind: str, coordinates: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))


_POINT_SQL = f"""SELECT CAST(o_orderkey AS VARCHAR) AS feature_id, CAST(round(({D.LON.format(k="o_orderkey")}) * 10000) AS BIGINT) AS lon_e4, CAST(round(({D.LAT.format(k="o_orderkey")}) * 10000) AS BIGINT) AS lat_e4,
 o_orderstatus AS status, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END AS urgent,
 '{{"customer":' || o_custkey || '}}' AS nested, 'cents=1,nested=0,status=0,urgent=2' AS types FROM orders"""


def _order_points(spark, d) -> DataFrame:
    o = D.table(spark, d, "orders")
    props = F.struct(
        F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).alias("cents"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.struct(F.col("o_custkey").alias("customer")).alias("nested"), F.lit(None).cast("string").alias("nothing"),
    )
    return o.select(F.col("o_orderkey").alias("id"), _feature(_geometry("Point", F.array(D.lon_of("o_orderkey"), D.lat_of("o_orderkey"))), props, id=F.col("o_orderkey")).alias("value"))


def _points_read(spark, path: str) -> DataFrame:
    p, e4 = F.col("properties"), lambda at: F.round(_double("geom", at) * 10000).cast("long")
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return geojson.read(spark, path).select(
        "feature_id", e4(0).alias("lon_e4"), e4(1).alias("lat_e4"), p["status"].alias("status"), p["cents"].cast("double").cast("long").alias("cents"), p["urgent"].alias("urgent"),
        p["nested"].alias("nested"), kinds.alias("types"),
    )


@query(_POINT_SQL)
def geojson_lines(spark, d):
    """A feature a line"""
    folder = storage.new_folder(spark, "geojson") + ".geojsonl"
    _order_points(spark, d).select("value").write.text(folder)
    return _points_read(spark, folder)


@query(_POINT_SQL)
def geojson_collections(spark, d):
    """Collections of a thousand features, one in each other collection nested"""
    folder = storage.new_folder(spark, "geojson")
    listed = _order_points(spark, d).groupBy(F.floor(F.col("id") / 1000).alias("g")).agg(F.array_join(F.collect_list("value"), ",").alias("v"))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), "v", F.lit("]}"))
    nested = F.concat(F.lit('{"type":"FeatureCollection","features":['), whole, F.lit("]}"))
    listed.select(F.when(F.col("g") % 2 == 0, whole).otherwise(nested).alias("value")).write.text(folder)
    return _points_read(spark, folder)


@query(f"""WITH {D.BOXES}, a AS (SELECT name, (x1 - x0) * (y1 - y0) AS whole, (x1 - x0 - 20) * (y1 - y0 - 20) AS hole FROM boxes)
SELECT name, 'LineString' AS shape, 1 AS parts, 3 AS points, 0 AS area FROM a UNION ALL SELECT name, 'MultiLineString', 2, 5, 0 FROM a UNION ALL SELECT name, 'MultiPoint', 1, 1, 0 FROM a, range(3) t(i)
UNION ALL SELECT name, 'Polygon', 2, 10, CAST(round(whole - hole) AS BIGINT) FROM a UNION ALL SELECT name, 'MultiPolygon', 2, 10, CAST(round(whole + hole) AS BIGINT) FROM a""")
def geojson_shapes(spark, d):
    """Every geometry that is read"""
    b = _box_shapes(spark, d)
    shapes = {
        "LineString": F.col("walls"), "MultiLineString": F.array("walls", "side"), "MultiPoint": F.col("walls"), "Polygon": F.array("outer", "hole"),
        "MultiPolygon": F.array(F.array("outer"), F.array("hole")),
    }
    folder, out = storage.new_folder(spark, "geojson"), None
    for kind, c in shapes.items():
        path = f"{folder}/{kind}.jsonl"
        b.select(_feature(_geometry(kind, c), F.struct("name", F.lit(kind).alias("shape")))).write.text(path)
        found = geojson.read(spark, path).select(F.col("properties")["name"].alias("name"), F.col("properties")["shape"].alias("shape"), "geom")
        out = found if out is None else out.unionByName(found)
    found = _measured(out, "name", "shape")
    # a hole that runs the other way counts as its own area when it stands as an outer ring
    return found.select("name", "shape", F.col("parts").cast("int").alias("parts"), F.col("points").cast("int").alias("points"), F.abs("area").alias("area"))


@query(f"""WITH {D.BOXES} SELECT name, 1 AS parts, 5 AS points, CAST(round((x1 - x0) * (y1 - y0)) AS BIGINT) AS area FROM boxes""")
def geojson_debug(spark, d):
    """The debugging writer's collection, read again"""
    from tessella.plans.build import box_polygon

    b = D.nation_boxes(spark, d).select(box_polygon("s_min_x", "s_min_y", "s_max_x", "s_max_y", projected=False).alias("geom"), F.create_map(F.lit("name"), "name").alias("properties"))
    path = storage.new_folder(spark, "debug") + ".json"
    geojson.write(b, path)
    found = _measured(geojson.read(spark, path).select(F.col("properties")["name"].alias("name"), "geom"), "name")
    return found.select("name", F.col("parts").cast("int").alias("parts"), F.col("points").cast("int").alias("points"), F.abs("area").alias("area"))


@query("SELECT o_orderkey AS id FROM orders")
def newline_chunks(spark, d):
    """Each file cut at newlines into ranges that tasks read on their own"""
    import json

    import pyarrow as pa

    folder = storage.new_folder(spark, "lines")
    _order_points(spark, d).select("value").write.text(folder)
    store, place = storage.filesystem(folder)
    from pyarrow import fs

    files = [f.path for f in store.get_file_info(fs.FileSelector(place)) if f.base_name.startswith("part-")]
    head = folder[: len(folder) - len(place)] if "://" in folder else ""
    ranges = [(head + f, a, n) for f in files for a, n in C.newline_chunks(head + f, 4)]

    def run(batches):
        for b in batches:
            found = [json.loads(x)["id"] for p, a, n in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in C.chunk(p, a, n).splitlines()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["id"])

    return spark.createDataFrame(ranges, "path string, at long, n long").repartition(max(1, len(ranges))).mapInArrow(run, "id long")


# tile containers: a tile's content is the number of its nodes, as text

_COUNTS = f"""{D.NODES}, t AS (SELECT {D.tile(6)} FROM nodes), z AS (SELECT unnest(range(0, 7)) AS z),
c AS (SELECT CAST(z AS INTEGER) AS z, x >> CAST(6 - z AS INTEGER) AS x, y >> CAST(6 - z AS INTEGER) AS y, count(*) AS n FROM t, z GROUP BY ALL)"""


def _count_tiles(spark, d, plus: int = 0) -> DataFrame:
    """(z, x, y, data) of zooms 0 to 6."""
    t = T.roll_up(T.index_points(D.nodes(spark, d), 6).select("x", "y"), 6, 0, 6).groupBy("z", "x", "y").agg(F.count("*").alias("n"))
    return t.select("z", "x", "y", F.encode((F.col("n") + plus).cast("string"), "UTF-8").alias("data"))


def _numbers(tiles: DataFrame) -> DataFrame:
    return tiles.select("z", "x", "y", F.decode("data", "UTF-8").cast("long").alias("n"))


@query(f"WITH {_COUNTS} SELECT z, x, y, n FROM c")
def mbtiles_tiles(spark, d):
    """Gzipped tiles through a file, rows counted from the south"""
    path = storage.new_folder(spark, "tiles") + ".mbtiles"
    packed = _count_tiles(spark, d).select("z", "x", "y", compression.gzipped("data").alias("data"))
    mbtiles.write(packed, path, {})
    return _numbers(mbtiles.read(spark, path).select("z", "x", "y", compression.plain("data").alias("data")))


@query(f"WITH {_COUNTS} SELECT z, x, y, CASE WHEN z < 4 THEN n + 7 ELSE n END AS n FROM c")
def mbtiles_merged(spark, d):
    """Tiles written again into an existing file replace their like, the others stay"""
    path = storage.new_folder(spark, "tiles") + ".mbtiles"
    mbtiles.write(_count_tiles(spark, d), path, {})
    mbtiles.write(_count_tiles(spark, d, 7).where("z < 4"), path, {}, merge=True)
    return _numbers(mbtiles.read(spark, path))


_SETTINGS = {
    "minzoom": 0, "maxzoom": 6, "basezoom": 6, "include_ids": False, "name": "counts", "version": "3", "description": "node counts", "compress": "gzip",
    "bounding_box": [-180.0, -85.0, 180.0, 85.0], "metadata": {"attribution": "none"}, "filemetadata": {"scheme": "xyz"},
}
_CONFIG = {
    "settings": _SETTINGS,
    "layers": {
        "poi": {"minzoom": 2, "maxzoom": 6, "feature_limit": 9, "simplify_below": 4},
        "poi_detail": {"minzoom": 5, "maxzoom": 6, "write_to": "poi"},
        "land": {"minzoom": 0, "maxzoom": 6, "source": "land.shp", "source_columns": ["name"], "simplify_algorithm": "visvalingam"},
    },
}


def _fields(spark, d) -> DataFrame:
    o = D.table(spark, d, "orders")
    return A.layer_fields(o.select(F.lit("poi").alias("layer"), A.attribute_set(A.attribute("status", F.col("o_orderstatus")), A.attribute_numeric("total", F.col("o_totalprice"))).alias("attrs")))


_LAYERS_JSON = (
    '[{"id": "poi", "description": "", "minzoom": 2, "maxzoom": 6, "fields": {"status": "String", "total": "Number"}}, '
    '{"id": "land", "description": "", "minzoom": 0, "maxzoom": 6, "fields": {}}]'
)


@query(f"""SELECT * FROM (VALUES ('attribution', 'none'), ('bounds', '-180.000000,-85.000000,180.000000,85.000000'), ('center', '0.000000,0.000000,3'), ('description', 'node counts'), ('format', 'pbf'),
 ('json', '{{"vector_layers": {_LAYERS_JSON}}}'), ('maxzoom', '6'), ('minzoom', '0'), ('name', 'counts'), ('type', 'baselayer'), ('version', '3'), ('parsed bounds', '-180.0 -85.0 180.0 85.0')) v(name, value)""")
def mbtiles_metadata(spark, d):
    """K2 K3 K14 S25"""
    config = C.parse(_CONFIG)
    path = storage.new_folder(spark, "tiles") + ".mbtiles"
    mbtiles.write(_count_tiles(spark, d).where("z = 0"), path, metadata.for_mbtiles(config, config.bounding_box, metadata.vector_layers(config, _fields(spark, d))))
    rows = [*mbtiles.metadata(path).items(), ("parsed bounds", " ".join(map(str, mbtiles.bounds(path))))]
    return spark.createDataFrame(rows, "name string, value string")


@query(f"WITH {_COUNTS} SELECT z, x, y, n FROM c")
def pmtiles_tiles(spark, d):
    """K4 K5 K6 O3: contents stored once, runs of equal tiles one entry, read by range"""
    path = storage.new_folder(spark, "tiles") + ".pmtiles"
    pmtiles.write(_count_tiles(spark, d), path, {}, (-180.0, -85.0, 180.0, 85.0), (0, 6))
    return _numbers(pmtiles.read(spark, path))


@query(f"""WITH {_COUNTS} SELECT (SELECT count(*) FROM c) AS tiles, (SELECT count(DISTINCT n) FROM c) AS contents, 0 AS minzoom, 6 AS maxzoom, -1800000000 AS west_e7, 850000000 AS north_e7,
 'counts' AS name, 'none' AS attribution, 'poi,land' AS layers""")
def pmtiles_header(spark, d):
    """K4 K7 K8: counts, zooms and bounds of the header, and the metadata"""
    config = C.parse(_CONFIG)
    path = storage.new_folder(spark, "tiles") + ".pmtiles"
    pmtiles.write(_count_tiles(spark, d), path, metadata.for_pmtiles(config, metadata.vector_layers(config, _fields(spark, d))), config.bounding_box, (0, 6))
    r = pmtiles.Reader(path)
    m = r.metadata()
    row = (r.counts[0], r.counts[2], *r.zooms, round(r.bounds[0] * 1e7), round(r.bounds[3] * 1e7), m["name"], m["attribution"], ",".join(x["id"] for x in m["vector_layers"]))
    return spark.createDataFrame([row], "tiles long, contents long, minzoom int, maxzoom int, west_e7 int, north_e7 int, name string, attribution string, layers string")


@query(f"WITH {_COUNTS} SELECT z, x, y, n FROM c")
def directory_tiles(spark, d):
    """K9: a file a tile"""
    folder = storage.new_folder(spark, "tiles")
    directory.write(_count_tiles(spark, d), folder, {})
    return _numbers(directory.read(spark, folder))


@query("SELECT 'counts' AS name, 'xyz' AS scheme, 0 AS minzoom, 6 AS maxzoom, 'poi,land' AS layers, '-180.0 -85.0 180.0 85.0' AS bounds")
def directory_metadata(spark, d):
    """K10"""
    import json

    config = C.parse(_CONFIG)
    folder = storage.new_folder(spark, "tiles")
    directory.write(_count_tiles(spark, d).where("z = 0"), folder, metadata.for_directory(config, config.bounding_box, metadata.vector_layers(config, _fields(spark, d))))
    with storage.open_input(f"{folder}/metadata.json") as f:
        m = json.loads(f.read())
    row = (m["name"], m["scheme"], m["minzoom"], m["maxzoom"], ",".join(x["id"] for x in m["vector_layers"]), " ".join(map(str, m["bounds"])))
    return spark.createDataFrame([row], "name string, scheme string, minzoom int, maxzoom int, layers string, bounds string")


# configuration


@query("""SELECT * FROM (VALUES ('poi', 2, 6, 'poi', 9, 7, false, 4, 0, 0, ''), ('poi_detail', 5, 6, 'poi', 0, 7, true, 0, 0, 1, ''), ('land', 0, 6, 'land', 0, 7, true, 0, 1, 0, 'land.shp'))
 v(name, minzoom, maxzoom, out_layer, feature_limit, feature_limit_below, z_order_ascending, simplify_below, group_pos, sub_pos, source)""")
def config_layers(spark, d):
    """Settings of the layers with their defaults"""
    return C.layers_frame(spark, C.parse(_CONFIG)).select(
        "name", "minzoom", "maxzoom", "out_layer", "feature_limit", "feature_limit_below", "z_order_ascending", "simplify_below", "group_pos", "sub_pos", "source"
    )


@query("""SELECT * FROM (VALUES ('--input a.pbf --output b.mbtiles', 'mbtiles', 'a.pbf', false, ''), ('a.pbf b.pbf out.pmtiles', 'pmtiles', 'a.pbf,b.pbf', false, ''), ('--output tiles a.pbf', 'directory', 'a.pbf', false, ''),
 ('a.pbf b.sqlite --merge', 'mbtiles', 'a.pbf', true, ''), ('--output t --bbox 1,2,3,4.5', 'directory', '', false, '1.0 2.0 3.0 4.5'), ('a.pbf t --merge', 'error', '', false, ''),
 ('', 'error', '', false, ''), ('a.pbf t --bbox 3,2,1,4', 'error', '', false, ''), ('a.pbf t --bbox 1,2,3', 'error', '', false, '')) v(line, mode, inputs, merge, bbox)""")
def command_lines(spark, d):
    """Options as they are read, and what is refused"""
    import contextlib
    import io

    lines = [
        "--input a.pbf --output b.mbtiles", "a.pbf b.pbf out.pmtiles", "--output tiles a.pbf", "a.pbf b.sqlite --merge", "--output t --bbox 1,2,3,4.5", "a.pbf t --merge", "",
        "a.pbf t --bbox 3,2,1,4", "a.pbf t --bbox 1,2,3",
    ]
    rows = []
    for line in lines:
        with contextlib.redirect_stderr(io.StringIO()):
            try:
                o = C.options(line.split())
                rows.append((line, o.mode, ",".join(o.input), o.merge, " ".join(map(str, o.bbox)) if o.bbox else ""))
            except SystemExit:
                rows.append((line, "error", "", False, ""))
    return spark.createDataFrame(rows, "line string, mode string, inputs string, merge boolean, bbox string")
