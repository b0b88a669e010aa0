"""Registered queries of the geometry kernels on shapes whose results have closed forms: points, boxes, segments, zigzags.

The shapes come from the tables as in derived.py; the SQL computes the same by comparisons and arithmetic on their coordinates.
"""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import attributes as A
from tessella.kernels import lines as K
from tessella.kernels import mvt, overlay, wkb
from tessella.operators import render
from tessella.operators import relations as R
from tessella.plans import derived as D
from tessella.plans.build import box_polygon, encoded, point_geometry
from tessella.plans.queries import query
from tessella.sources.config import parse

HIGH = 5
#: Rows of a batch that a query makes.
ROWS = 1 << 15
_CAST = "CAST({} AS INTEGER)"


def _config(**layers):
    settings = {"minzoom": 0, "maxzoom": HIGH, "basezoom": HIGH, "include_ids": True, "name": "q", "version": "1", "description": "", "compress": "gzip"}
    return parse({"settings": settings, "layers": layers})


def _points(spark, d, layer: str = "poi") -> DataFrame:
    return D.nodes(spark, d).select(
        (F.col("id") * 4).alias("feature_id"), F.col("id").alias("osm_id"), F.lit(0).alias("source_pos"), F.lit(layer).alias("layer"), F.lit(0).alias("geom_type"),
        point_geometry("lon", "latp").alias("geom"), A.attribute_set(A.attribute("status", F.col("tags")["status"])).alias("attrs"), (F.col("id") % 7).cast("int").alias("fmin"), F.lit(0).alias("z_order"),
    )


def _mapped(rows: DataFrame, fn, schema: str) -> DataFrame:
    """Rows made from each row (as a tuple) by fn."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        def rows_of(b):
            large = pa.types.is_binary(b.schema.types[-1])  # bytes may be large, so they are not all copied at once
            rest = [c.to_pylist() for c in b.columns[: len(b.columns) - large]]
            last = (x.as_py() for x in b.columns[-1])
            return zip(*rest, last, strict=True) if large else zip(*rest, strict=True)

        for b in batches:
            found = (r for row in rows_of(b) for r in fn(*row))
            while out := list(islice(found, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


# points: a tile shows those in its box grown by a two-hundredth

_ZOOMS = f"zooms AS (SELECT CAST(z AS INTEGER) AS z, CAST(pow(2, z) AS INTEGER) AS m, 360 / pow(2, z) AS s FROM (SELECT unnest(range(0, {HIGH + 1})) AS z))"
_NEAR = "(SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)"
_SHOWN = f"""{D.NODES}, {_ZOOMS}, own AS (SELECT id, lon, latp, status, z, m, s, {_CAST.format("floor((lon + 180) / s)")} AS fx, {_CAST.format("floor((180 - latp) / s)")} AS fy FROM nodes, zooms WHERE z >= id % 7),
cell AS (SELECT *, fx + i AS x, fy + j AS y FROM own, {_NEAR}),
box AS (SELECT *, x * s - 180 AS x0, 180 - (y + 1) * s AS y0, (x + 1) * s - 180 AS x1, 180 - y * s AS y1 FROM cell WHERE x >= 0 AND y >= 0 AND x < m AND y < m),
shown AS (SELECT *, {_CAST.format("floor((lon - x0) / ((x1 - x0) / 4096))")} AS px, {_CAST.format("floor((y1 - latp) / ((y1 - y0) / 4096))")} AS py FROM box
 WHERE lon >= x0 - (x1 - x0) * 0.005::DOUBLE AND lon <= x1 + (x1 - x0) * 0.005::DOUBLE AND latp >= y0 - (y1 - y0) * 0.005::DOUBLE AND latp <= y1 + (y1 - y0) * 0.005::DOUBLE)"""


@query(f"WITH {_SHOWN} SELECT z, x, y, id, px, py, status FROM shown")
def decoded_points(spark, d):
    """Points through tiles, one feature each"""
    t = encoded(_points(spark, d), _config(poi={"minzoom": 0, "maxzoom": HIGH, "combine_points": False}))

    def rows(z, x, y, data):
        for la in mvt.layers(data):
            for _, i, props, drawn in la.features():
                one = mvt.single_point(drawn)
                for p in [one] if one else zip(*(v.tolist() for v in mvt.read_points(drawn)), strict=True):
                    yield z, x, y, i, *p, props["status"]

    return _mapped(t.select("z", "x", "y", "data"), rows, "z int, x int, y int, id long, px int, py int, status string")


@query(f"WITH {_SHOWN} SELECT z, x, y, status, count(*) AS n, CAST(sum(px) AS BIGINT) AS sum_px, CAST(sum(py) AS BIGINT) AS sum_py, min(id) AS id FROM shown GROUP BY ALL")
def decoded_multipoints(spark, d):
    """Points of equal attributes as one feature"""
    t = encoded(_points(spark, d), _config(poi={"minzoom": 0, "maxzoom": HIGH}))

    def rows(z, x, y, data):
        for la in mvt.layers(data):
            for _, i, props, drawn in la.features():
                px, py = mvt.read_points(drawn)
                yield z, x, y, props["status"], len(px), int(px.sum()), int(py.sum()), i

    found = _mapped(t.select("z", "x", "y", "data"), rows, "z int, x int, y int, status string, n long, sum_px long, sum_py long, id long")
    return found


@query(f"""WITH {_SHOWN}, sides AS (SELECT z, x, y, 'poi' AS layer, count(*) AS n FROM shown GROUP BY ALL UNION ALL
SELECT z, x, y, 'more', count(*) FROM shown WHERE status = 'F' GROUP BY ALL UNION ALL SELECT z, x, y, 'poi', count(*) FROM shown WHERE status = 'F' GROUP BY ALL)
SELECT z, x, y, layer, CAST(sum(n) AS BIGINT) AS n FROM sides GROUP BY ALL""")
def merged_layers(spark, d):
    """Tiles of two runs as one set, layer by layer, by the tiles' bytes"""
    one = {"minzoom": 0, "maxzoom": HIGH, "combine_points": False}
    few = lambda layer: _points(spark, d, layer).where(F.col("attrs")[0]["s"] == "F")
    old = encoded(_points(spark, d), _config(poi=one))
    new = encoded(few("poi").unionByName(few("more")), _config(poi=one, more=one))

    def rows(z, x, y, data):
        return [(z, x, y, la.name, sum(mvt.n_paths(kind, drawn) for kind, _, _, drawn in la.features())) for la in mvt.layers(data)]

    return _mapped(render.merge(old, new).select("z", "x", "y", "data"), rows, "z int, x int, y int, layer string, n long")


# boxes: what a tile shows of one is a box again

_LATP = "degrees(ln(tan(radians({} + 90) / 2)))"
_PBOXES = f"{D.BOXES}, pboxes AS (SELECT shape_id AS id, name, x0 AS a, {_LATP.format('y0')} AS b, x1 AS c, {_LATP.format('y1')} AS e FROM boxes)"
_GRID = "grid AS (SELECT z, x, y, s, x * s - 180 AS x0, 180 - (y + 1) * s AS y0, (x + 1) * s - 180 AS x1, 180 - y * s AS y1 FROM zooms, (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS x), (SELECT CAST(unnest(range(0, 32)) AS INTEGER) AS y) WHERE x < m AND y < m)"


def _boxes(spark, d) -> DataFrame:
    b = D.nation_boxes(spark, d)
    return b.select(
        F.col("shape_id").cast("long").alias("feature_id"), F.col("shape_id").cast("long").alias("osm_id"), F.lit(1).alias("source_pos"), F.lit("land").alias("layer"), F.lit(3).alias("geom_type"),
        box_polygon("s_min_x", "s_min_y", "s_max_x", "s_max_y").alias("geom"), A.attribute_set(A.attribute("name", F.col("name"))).alias("attrs"), F.lit(0).alias("fmin"), F.lit(0).alias("z_order"),
    )


@query(f"""WITH {_ZOOMS}, {_PBOXES}, {_GRID}, cut AS (SELECT z, x, y, id, least(c, x1 + s * 0.005::DOUBLE) - greatest(a, x0 - s * 0.005::DOUBLE) AS w, least(e, y1 + s * 0.005::DOUBLE) - greatest(b, y0 - s * 0.005::DOUBLE) AS h FROM pboxes, grid)
SELECT z, x, y, CAST(id AS BIGINT) AS id, CAST(round(w * h * 1000) AS BIGINT) AS area FROM cut WHERE w > 1e-9 AND h > 1e-9""")
def clipped_areas(spark, d):
    """Areas walked down the pyramid, each part clipped from its parent's"""
    p = render.pieces(_boxes(spark, d), _config(land={"minzoom": 0, "maxzoom": HIGH}))

    def rows(z, x, y, i, data):
        area = overlay.area(wkb.polygons(data))
        return [(z, x, y, i, round(area * 1000))] if area > 1e-12 else []

    return _mapped(p.select("z", "x", "y", "feature_id", "geom"), rows, "z int, x int, y int, id long, area long")


@query(f"""WITH {_PBOXES} SELECT CAST(id AS BIGINT) AS id, CAST((floor((c + 180) / 5.625) - floor((a + 180) / 5.625) + 1) * (floor((180 - b) / 5.625) - floor((180 - e) / 5.625) + 1) AS BIGINT) AS n_tiles FROM pboxes""")
def area_tiles(spark, d):
    """Tiles of zoom 6 that an area covers, its outline and what it fills"""
    return _mapped(_boxes(spark, d).select("feature_id", "geom"), lambda i, g: [(i, len(K.covered_by_area(wkb.polygons(g), 6)))], "id long, n_tiles long")


@query(f"""WITH {_PBOXES}, p AS (SELECT *, c - a AS w, e - b AS h, greatest(0, (c - a) * 0.75::DOUBLE) * greatest(0, (e - b) * 0.5::DOUBLE) AS common FROM pboxes)
SELECT CAST(id AS BIGINT) AS id, CAST(round((2 * w * h - common) * 100) AS BIGINT) AS either, CAST(round(common * 100) AS BIGINT) AS both, CAST(round((w * h - common) * 100) AS BIGINT) AS first_only,
 CAST(round(2 * (w * h - common) * 100) AS BIGINT) AS one_only FROM p""")
def overlay_areas(spark, d):
    """Union, intersection, difference and symmetric difference of each area with itself moved by a quarter and a half"""

    def rows(i, g):
        a = wkb.polygons(g)
        ring = a[0][0]
        dx, dy = (max(p[k] for p in ring) - min(p[k] for p in ring) for k in (0, 1))
        b = [[[(x + dx / 4, y + dy / 2) for x, y in ring]]]
        return [(i, *(round(overlay.area(overlay.overlay(a, b, op)) * 100) for op in ("or", "and", "minus", "xor")))]

    return _mapped(_boxes(spark, d).select("feature_id", "geom"), rows, "id long, either long, both long, first_only long, one_only long")


@query(f"""WITH {_PBOXES} SELECT CAST(id AS BIGINT) AS id, CAST(round((c - a) * (e - b) / 2 * 100) AS BIGINT) AS valid, CAST(2 AS BIGINT) AS parts FROM pboxes""")
def valid_bow_ties(spark, d):
    """An outline that crosses itself becomes two triangles of half the box's area"""

    def rows(i, g):
        ring = wkb.polygons(g)[0][0]
        w, e = min(p[0] for p in ring), max(p[0] for p in ring)
        s, n = min(p[1] for p in ring), max(p[1] for p in ring)
        found = overlay.make_valid([[[(w, s), (e, n), (e, s), (w, n), (w, s)]]])
        return [(i, round(sum(abs(overlay.area([p])) for p in found) * 100), len(found))]

    return _mapped(_boxes(spark, d).select("feature_id", "geom"), rows, "id long, valid long, parts long")


@query(f"""WITH {_PBOXES} SELECT CAST(id AS BIGINT) AS id, CAST(round((a + c) / 2 * 1000) AS BIGINT) AS centre_x, CAST(round((b + e) / 2 * 1000) AS BIGINT) AS centre_y, CAST(round(least(c - a, e - b) / 2) AS BIGINT) AS clearance FROM pboxes""")
def label_clearance(spark, d):
    """The centre of area, and how far from the edges the label's point lies: half the lesser side"""

    def rows(i, g):
        p = wkb.polygons(g)
        (x, y), at = K.label_point(p, "centroid"), K.label_point(p)
        return [(i, round(x * 1000), round(y * 1000), round(K._edge_distance(*at, p[0])))]

    return _mapped(_boxes(spark, d).select("feature_id", "geom"), rows, "id long, centre_x long, centre_y long, clearance long")


# segments: the first two references of each way

_SEGMENTS = f"""{D.REFS}, {_ZOOMS}, ends AS (SELECT r.id, max(CASE WHEN pos = 0 THEN ref END) AS p, max(CASE WHEN pos = 1 THEN ref END) AS q FROM refs r GROUP BY r.id),
seg AS (SELECT id, {D.LON.format(k="p")} AS ax, {_LATP.format(D.LAT.format(k="p").join("()"))} AS ay, {D.LON.format(k="q")} AS bx, {_LATP.format(D.LAT.format(k="q").join("()"))} AS by_ FROM ends WHERE q IS NOT NULL AND p <> q)"""


def _segments(spark, d) -> DataFrame:
    """id and geom: a line of two points in lon/latp."""
    w = D.ways(spark, d).where("size(refs) > 1 AND refs[0] <> refs[1]").select("id", F.slice("refs", 1, 2).alias("refs"))
    from tessella.plans.build import line_of

    return line_of(R.way_coordinates(w, D.part_nodes(spark, d)))


@query(f"""WITH {_SEGMENTS}, c AS (SELECT id, (ax + 180) / 5.625 AS x0, (180 - ay) / 5.625 AS y0, (bx + 180) / 5.625 AS x1, (180 - by_) / 5.625 AS y1 FROM seg),
g AS (SELECT *, unnest(range(CAST(floor(least(x0, x1)) AS BIGINT), CAST(floor(greatest(x0, x1)) AS BIGINT) + 1)) AS x FROM c),
h AS (SELECT *, unnest(range(CAST(floor(least(y0, y1)) AS BIGINT), CAST(floor(greatest(y0, y1)) AS BIGINT) + 1)) AS y FROM g),
t AS (SELECT id, greatest(0, CASE WHEN x1 = x0 THEN 0 ELSE least((x - x0) / (x1 - x0), (x + 1 - x0) / (x1 - x0)) END, CASE WHEN y1 = y0 THEN 0 ELSE least((y - y0) / (y1 - y0), (y + 1 - y0) / (y1 - y0)) END) AS t0,
 least(1, CASE WHEN x1 = x0 THEN 1 ELSE greatest((x - x0) / (x1 - x0), (x + 1 - x0) / (x1 - x0)) END, CASE WHEN y1 = y0 THEN 1 ELSE greatest((y - y0) / (y1 - y0), (y + 1 - y0) / (y1 - y0)) END) AS t1 FROM h)
SELECT id, count(*) AS n_tiles FROM t WHERE t0 < t1 GROUP BY id""")
def segment_tiles(spark, d):
    """Tiles of zoom 6 that a segment passes"""
    return _mapped(_segments(spark, d), lambda i, g: [(i, len(K.covered_by_line(wkb.lines(g)[0], 6, touched=False)))], "id long, n_tiles long")


@query(f"""WITH {_SEGMENTS}, {_GRID}, b AS (SELECT id, z, x, y, ax, ay, bx - ax AS dx, by_ - ay AS dy, x0 - s * 0.005::DOUBLE AS l, x1 + s * 0.005::DOUBLE AS r, y0 - s * 0.005::DOUBLE AS lo, y1 + s * 0.005::DOUBLE AS hi FROM seg, grid WHERE z <= 3),
t AS (SELECT *, greatest(0, CASE WHEN dx = 0 THEN 0 ELSE least((l - ax) / dx, (r - ax) / dx) END, CASE WHEN dy = 0 THEN 0 ELSE least((lo - ay) / dy, (hi - ay) / dy) END) AS t0,
 least(1, CASE WHEN dx = 0 THEN 1 ELSE greatest((l - ax) / dx, (r - ax) / dx) END, CASE WHEN dy = 0 THEN 1 ELSE greatest((lo - ay) / dy, (hi - ay) / dy) END) AS t1 FROM b
 WHERE (dx <> 0 OR ax BETWEEN l AND r) AND (dy <> 0 OR ay BETWEEN lo AND hi))
SELECT id, z, x, y, CAST(round((t1 - t0) * sqrt(dx * dx + dy * dy) * 1000) AS BIGINT) AS length FROM t WHERE (t1 - t0) * sqrt(dx * dx + dy * dy) > 1e-6""")
def clipped_lines(spark, d):
    """Lines clipped to each tile's grown box"""
    f = _segments(spark, d).select(
        F.col("id").alias("feature_id"), F.col("id").alias("osm_id"), F.lit(0).alias("source_pos"), F.lit("line").alias("layer"), F.lit(1).alias("geom_type"), "geom",
        A.attribute_set(A.attribute("kind", F.lit("way"))).alias("attrs"), F.lit(0).alias("fmin"), F.lit(0).alias("z_order"),
    )
    p = render.pieces(f, _config(line={"minzoom": 0, "maxzoom": 3}))

    def rows(i, z, x, y, g):
        n = sum(((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2) ** 0.5 for line in wkb.lines(g) for p, q in zip(line, line[1:], strict=False))
        return [(i, z, x, y, round(n * 1000))] if n > 1e-6 else []

    return _mapped(p.select("feature_id", "z", "x", "y", "geom"), rows, "id long, z int, x int, y int, length long")


@query("SELECT o_orderkey AS id, CAST(4 + o_orderkey % 9 AS BIGINT) AS n, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 4 + o_orderkey % 9 END AS BIGINT) AS n_dp, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 4 + o_orderkey % 9 END AS BIGINT) AS n_vis FROM orders")
def zigzag_simplified(spark, d):
    """Zigzags; those of a quarter of the distance fall to their ends, those of ten times it stay"""

    def rows(i):
        n, a = 4 + i % 9, 10.0 if i % 2 else 0.25
        line = [(float(k), a * (k % 2)) for k in range(n)]
        return [(i, n, len(K.simplify_line(line, 1.0)), len(K.simplify_line(line, 1.0, "visvalingam")))]

    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return _mapped(o, rows, "id long, n long, n_dp long, n_vis long")


@query("SELECT o_orderkey AS id, CAST(1 AS BIGINT) AS n_lines, CAST(3 + o_orderkey % 5 AS BIGINT) AS n_points FROM orders")
def stitched_chains(spark, d):
    """Segments that follow one another, in any order, become one line"""

    def rows(i):
        n = 2 + i % 5
        ways = [[(float(k), float(i % 7)), (float(k + 1), float(i % 7))] for k in range(n)]
        joined = K.stitch([ways[k] for k in sorted(range(n), key=lambda k: (k * 3 + i) % n if n % 3 else k)])
        return [(i, len(joined), sum(map(len, joined)))]

    return _mapped(D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), rows, "id long, n_lines long, n_points long")
