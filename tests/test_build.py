import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import attributes as A
from tessella.functions import tags as G
from tessella.kernels import mvt, overlay, wkb
from tessella.operators import relations as R
from tessella.operators import render
from tessella.plans import build, rules
from tessella.sinks import compression, directory, mbtiles, pmtiles
from tessella.sources import config as C
from tessella.sources import geojson, osm_pbf, shapefile

LAYERS = {
    "place": {"minzoom": 0, "maxzoom": 14}, "poi": {"minzoom": 12, "maxzoom": 14}, "transportation": {"minzoom": 4, "maxzoom": 14, "simplify_below": 13, "simplify_level": 0.0001, "combine_lines_below": 14},
    "transportation_name": {"minzoom": 8, "maxzoom": 14}, "waterway": {"minzoom": 8, "maxzoom": 14}, "water": {"minzoom": 6, "maxzoom": 14, "simplify_below": 12, "simplify_level": 0.0001, "combine_polygons_below": 14},
    "building": {"minzoom": 13, "maxzoom": 14, "write_to": "water"},
}
SETTINGS = {"minzoom": 8, "maxzoom": 14, "basezoom": 14, "include_ids": True, "name": "t", "version": "1", "description": "d", "compress": "gzip"}


def conf(layers=LAYERS, **more):
    return C.parse({"settings": SETTINGS | more, "layers": layers})


def at(lon, lat):
    return int(lat * 1e7), int(lon * 1e7)


NODES = [
    (1, *at(7.40, 43.70), {"place": "city", "name": "Mona"}), (2, *at(7.41, 43.70), {"amenity": "cafe", "name": "Bar"}), (3, *at(7.40, 43.70), {}),
    (4, *at(7.42, 43.70), {}), (5, *at(7.42, 43.72), {}), (6, *at(7.40, 43.72), {}), (7, *at(7.43, 43.71), {}), (8, *at(7.405, 43.705), {}), (9, *at(7.410, 43.705), {}),
    (10, *at(7.410, 43.710), {}), (11, *at(7.405, 43.710), {}), (11386679771, *at(7.45, 43.71), {}),
]
WAYS = [
    (100, [3, 4, 5, 6, 3], None, {"natural": "water"}), (101, [3, 4], None, {"highway": "residential", "name": "Rue"}), (102, [4, 7, 11386679771], None, {"highway": "residential", "name": "Rue"}),
    (103, [8, 9, 10, 11, 8], None, {}), (104, [3, 4, 5], None, {}), (105, [5, 6, 3], None, {}), (106, [999], None, {"highway": "path"}),
]
RELATIONS = [(200, {"type": "multipolygon", "natural": "water", "water": "river"}, [(1, 104, "outer"), (1, 105, "outer"), (1, 103, "inner")])]


@pytest.fixture(scope="module")
def pbf(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pbf") / "x.pbf")
    osm_pbf.write(path, NODES, WAYS, RELATIONS, (7.39, 43.69, 7.46, 43.73), per_block=4)
    return path


@pytest.mark.parametrize("kwargs", [{}, {"raw": True}, {"dense": False, "features": ()}])
def test_pbf_round_trip(spark, tmp_path, kwargs):
    path = str(tmp_path / "x.pbf")
    osm_pbf.write(path, NODES, WAYS, RELATIONS, (7.39, 43.69, 7.46, 43.73), per_block=4, **kwargs)
    h = osm_pbf.read_header(path)
    assert h.bbox == pytest.approx((7.39, 43.69, 7.46, 43.73)) and osm_pbf.has_feature(path, osm_pbf.SORTED) == ("features" not in kwargs)
    assert sorted((r.id, r.lat_e7, r.lon_e7, r.tags) for r in osm_pbf.read(spark, path, "node").collect()) == sorted(NODES, key=lambda r: r[0])
    assert sorted((r.id, r.refs, r.coords, r.tags) for r in osm_pbf.read(spark, path, "way").collect()) == WAYS
    (rel,) = osm_pbf.read(spark, path, "relation").collect()
    assert rel.tags == RELATIONS[0][1] and [(m.type, m.ref, m.role) for m in rel.members] == RELATIONS[0][2]


def test_pbf_prunes_blocks(pbf):
    assert len(osm_pbf.blocks_of(pbf, "node")) < len([b for b in osm_pbf.blobs(pbf) if b.kind == "OSMData"])


def test_pbf_locations_on_ways(spark, tmp_path):
    path = str(tmp_path / "x.pbf")
    osm_pbf.write(path, [], [(1, [5, 6], [(10, 20), (30, 40)], {})], features=(osm_pbf.LOCATIONS,))
    (w,) = osm_pbf.read(spark, path, "way").collect()
    assert [(c.lat_e7, c.lon_e7) for c in w.coords] == [(10, 20), (30, 40)]


def layer(tiles, z, x, y, name):
    data = {(r.z, r.x, r.y): bytes(r.data) for r in tiles}[z, x, y]
    return {la.name: la for la in mvt.decode(data)}.get(name)


def test_build(spark, pbf, tmp_path):
    c = conf()
    found = build.features(spark, c, rules.SIMPLE, [pbf])
    kinds = {(r.layer, r.geom_type) for r in found.collect()}
    assert kinds == {("place", 0), ("poi", 0), ("transportation", 1), ("transportation_name", 1), ("water", 3)}
    tiles = build.encoded(found, c).collect()
    x, y = 133, 93
    assert {r.z for r in tiles} == set(range(8, 15))
    low = [r for r in tiles if r.z == 8]
    assert [(r.x, r.y) for r in low] == [(x, y)]
    roads = layer(tiles, 8, x, y, "transportation")
    assert len(roads.features) == 1 and roads.features[0].properties == {"class": "minor"}  # combined
    water = layer(tiles, 8, x, y, "water")
    assert {f.properties["class"] for f in water.features} == {"lake", "river"}
    assert layer(tiles, 8, x, y, "place").features[0].properties == {"class": "city", "name:latin": "Mona", "rank": 4}
    assert layer(tiles, 8, x, y, "poi") is None
    river = [p for r in found.where("layer = 'water'").collect() for p in wkb.polygons(r.geom) if len(p) == 2]
    assert len(river) == 1  # the relation's hole
    for out in ("a.mbtiles", "a.pmtiles", "tiles"):
        build.run(spark, c, rules.SIMPLE, [pbf], str(tmp_path / out))
    want = {(r.z, r.x, r.y): bytes(r.data) for r in tiles}
    assert mbtiles.tile(str(tmp_path / "a.mbtiles"), 8, x, y) == want[8, x, y]
    assert {(r.z, r.x, r.y) for r in mbtiles.read(spark, str(tmp_path / "a.mbtiles")).collect()} == set(want)
    reader = pmtiles.Reader(str(tmp_path / "a.pmtiles"))
    assert all(reader.tile(*k) == v for k, v in want.items()) and reader.tile(8, 0, 0) is None and reader.counts[0] == len(want)
    assert compression.decompress(directory.tile(str(tmp_path / "tiles"), 8, x, y)) == want[8, x, y]
    meta = json.loads(mbtiles.metadata(str(tmp_path / "a.mbtiles"))["json"])["vector_layers"]
    assert {m["id"] for m in meta} == {"place", "poi", "transportation", "transportation_name", "waterway", "water"}
    assert next(m for m in meta if m["id"] == "place")["fields"] == {"class": "String", "name:latin": "String", "rank": "Number"}
    assert reader.metadata()["vector_layers"] == meta
    assert os.path.exists(tmp_path / "tiles/metadata.json") and len(mbtiles.bounds(str(tmp_path / "a.mbtiles"))) == 4
    build.run(spark, c, rules.SIMPLE, [pbf], str(tmp_path / "a.mbtiles"), merge=True)  # features are there twice now
    merged = {la.name: la for la in mvt.decode(mbtiles.tile(str(tmp_path / "a.mbtiles"), 8, x, y))}
    assert len(merged["water"].features) == 2 * len(water.features)


def test_missing_nodes(spark, pbf):
    nodes = build.degrees(osm_pbf.read(spark, pbf, "node"))
    ways = osm_pbf.read(spark, pbf, "way").select("id", "refs", "tags")
    assert 106 not in [r.id for r in R.way_coordinates(ways, nodes).collect()]
    with pytest.raises(Exception, match="missing node 999"):
        R.way_coordinates(ways, nodes, skip_integrity=False).collect()


def test_schema_profile(spark):
    rows = [
        (1, {"highway": "motorway_link", "name": "A", "ref": "M1", "surface": "asphalt", "oneway": "yes"}, False, 0.0, None), (2, {"building": "yes", "height": "12"}, True, 900.0, None),
        (3, {"natural": "water", "name": "Lake"}, True, 9e6, None), (4, {"boundary": "administrative", "admin_level": "4"}, False, 0.0, 2.0), (5, {"disused": "yes", "highway": "primary"}, False, 0.0, None),
        (6, {"landuse": "forest"}, True, 5e5, None), (7, {"waterway": "river", "name": "R"}, False, 0.0, None), (8, {"railway": "rail", "usage": "main"}, False, 0.0, None),
        (9, {"amenity": "school", "name": "S"}, True, 100.0, None), (10, {"highway": "proposed"}, False, 0.0, None), (11, {"natural": "water", "covered": "yes", "landuse": "forest"}, True, 9.0, None),
    ]
    df = spark.createDataFrame(rows, "id long, tags map<string,string>, closed boolean, area double, admin_level double")
    out = {}
    for r in rules.apply(df, rules.schema_ways(F.col("tags"))).collect():
        out.setdefault(r.id, {})[r.layer] = r
    props = lambda i, layer: {a.key: a.s if a.s is not None else a.d for a in out[i][layer].attrs}
    assert out.keys() == {1, 2, 3, 4, 6, 7, 8, 9}
    road = props(1, "transportation")
    assert road["class"] == "motorway" and road["ramp"] == 1 and road["surface"] == "paved" and out[1]["transportation"].fmin == 9 and out[1]["transportation"].z_order == 30
    assert props(1, "transportation_name")["ref_length"] == 2 and out[1]["transportation_name"].fmin == 7
    assert props(2, "building") == {"render_height": 12.0, "render_min_height": 0.0} and out[2]["building"].fmin == 14
    assert set(out[3]) == {"water", "water_name_detail"} and out[3]["water"].fmin == 7
    assert props(4, "boundary")["admin_level"] == 2 and out[4]["boundary"].fmin == 0
    assert props(6, "landcover") == {"class": "wood", "subclass": "forest"} and out[6]["landcover"].geometry == "area"
    assert set(out[7]) == {"waterway", "water_name"} and out[8]["transportation"].fmin == 8
    assert out[9].keys() == {"landuse", "poi_detail"} and props(9, "poi_detail")["class"] == "school"


def test_schema_nodes(spark):
    rows = [(1, {"place": "town", "population": "9000", "name": "T", "amenity": "bar"}), (2, {"natural": "peak", "ele": "100.7", "name": "P"}), (3, {"aeroway": "aerodrome", "aerodrome": "public", "iata": "XX"}), (4, {"amenity": "hospital"}), (5, {"addr:housenumber": "7"})]
    df = spark.createDataFrame(rows, "id long, tags map<string,string>")
    got = {(r.id, r.layer): {a.key: a.s if a.s is not None else a.d for a in r.attrs} | {"fmin": r.fmin} for r in rules.apply(df, rules.schema_nodes(F.col("tags"))).collect()}
    assert got.keys() == {(1, "place"), (2, "mountain_peak"), (3, "aerodrome_label"), (4, "poi"), (5, "housenumber")}  # a place ends the rules
    assert got[1, "place"] == {"class": "town", "name:latin": "T", "fmin": 7, "rank": 10.0}
    assert got[2, "mountain_peak"]["ele"] == 100 and got[2, "mountain_peak"]["ele_ft"] == 328
    assert got[3, "aerodrome_label"]["class"] == "public" and got[4, "poi"]["rank"] == 1


def test_tag_filters(spark):
    df = spark.createDataFrame([(1, {"foo": "bar"}), (2, {"foo": "baz"}), (3, {"other": "x"}), (4, {}), (5, {"foo": "bar", "other": "x"})], "id int, tags map<string,string>")
    ids = lambda f: [r.id for r in df.where(G.significant(F.col("tags"), f)).collect()]
    assert ids(["foo"]) == [1, 2, 5] and ids(["foo=bar"]) == [1, 5] and ids(["~foo"]) == [3, 5] and ids(["~foo=bar"]) == [2, 3, 5]
    assert ids(None) == [1, 2, 3, 4, 5] and ids([]) == []
    with pytest.raises(ValueError):
        ids(["foo", "~bar"])


def test_attributes(spark):
    one = spark.range(1).select(A.attribute_set(A.attribute("k", F.lit("a")), A.attribute_integer("n", F.lit(5), 10), A.attribute("k", F.lit("b")), A.attribute("e", F.lit("")), A.attribute("z", F.lit(None))).alias("a"))
    assert [(a.key, a.s, a.d, a.minzoom) for a in one.first().a] == [("k", "b", None, 0), ("n", None, 5.0, 10)]
    assert [a.key for a in one.select(A.shown(F.col("a"), 9).alias("a")).first().a] == ["k"]
    f = spark.createDataFrame([("l", "a", 0), ("l", "b", 3)], "layer string, key string, vtype int")
    layers = spark.createDataFrame([("l", 0, 9, ""), ("s", 0, 9, "l")], "name string, minzoom int, maxzoom int, write_to string")
    assert [(r.id, json.loads(r.fields)) for r in A.vector_layers(f, layers).collect()] == [("l", {"a": "String", "b": "Number"})]


def test_ancestors_with_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "child long, parent long")
    assert {(r.id, r.ancestor) for r in R.ancestors(e).collect()} == {(1, 2), (1, 3), (2, 3), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3)}


def test_ancestor_and_label_tags(spark):
    kind = "id long, tags map<string,string>, members array<struct<seq:int,type:int,ref:long,role:string>>"
    rels = spark.createDataFrame([(1, {"n": "a"}, [(0, 0, 50, "label")]), (2, {"n": "b", "iso": "XX"}, [(0, 2, 1, ""), (1, 0, 50, "label"), (2, 0, 51, "x")]), (3, {"n": "c"}, [(0, 2, 2, "")])], kind)
    got = {r.id: [(a.id, a.tags["n"]) for a in r.ancestors or []] for r in R.with_ancestors(rels).collect()}
    assert got == {1: [(2, "b"), (3, "c")], 2: [(3, "c")], 3: []}
    nodes = spark.createDataFrame([(50, {"place": "country"}), (51, {"place": "country"}), (52, {"iso": "YY"})], "id long, tags map<string,string>")
    assert {r.id: r.tags.get("iso") for r in R.label_tags(nodes, rels, "iso").collect()} == {50: "XX", 51: None, 52: "YY"}


def test_config():
    c = conf()
    assert c.groups() == [["place"], ["poi"], ["transportation"], ["transportation_name"], ["waterway"], ["water", "building"]]
    assert c.layers[0].z_order_ascending and c.layers[0].feature_limit_below == 15 and c.layers[0].combine_points and c.index_zoom == 14
    limited = conf({"a": {"minzoom": 0, "maxzoom": 9, "feature_limit": 5}})
    assert not limited.layers[0].z_order_ascending
    for bad in ({"layers": {"a": {"minzoom": 0, "maxzoom": 1, "write_to": "b"}}}, {"layers": {"a": {"minzoom": 0, "maxzoom": 1, "source": "x.shp"}}}):
        with pytest.raises(ValueError):
            conf(**bad)
    with pytest.raises(ValueError):
        conf(maxzoom=15)
    with pytest.raises(ValueError):
        conf(compress="lz4")
    assert C.parse_box("1,2,3,4") == (1, 2, 3, 4)
    for bad in ("1,2,3", "3,2,1,4"):
        with pytest.raises(ValueError):
            C.parse_box(bad)


@pytest.mark.parametrize(
    "argv, mode, inputs",
    [(["a.pbf", "o.mbtiles"], "mbtiles", ["a.pbf"]), (["--input", "a.pbf", "--output", "o.pmtiles"], "pmtiles", ["a.pbf"]), (["a.pbf", "b.pbf", "--output", "dir"], "directory", ["a.pbf", "b.pbf"]), (["--output", "o.sqlite", "--merge", "--fast", "--threads", "3"], "mbtiles", [])],
)
def test_options(argv, mode, inputs):
    o = C.options(argv)
    assert o.mode == mode and o.input == inputs


@pytest.mark.parametrize("argv", [[], ["--output", "dir", "--merge"], ["o.mbtiles", "--bbox", "1,2"]])
def test_bad_options(argv):
    with pytest.raises(SystemExit):
        C.options(argv)


GEO = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "id": 1, "geometry": {"type": "Point", "coordinates": [7.41, 43.71]}, "properties": {"name": "p", "n": 3, "ok": True, "deep": {"a": [1]}, "gone": None}},
        {"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": [[7.41, 43.71], [8, 44]]}, "properties": {}},
        {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[7, 43], [8, 44]]}, "properties": {"name": "l"}}]},
        {"type": "Feature", "geometry": {"type": "MultiLineString", "coordinates": [[[7, 43], [8, 44]]]}, "properties": None},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[7, 43], [8, 43], [8, 44], [7, 44], [7, 43]]]}, "properties": {"name": "box"}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[7, 43], [8, 43], [8, 44], [7, 43]]]]}, "properties": {}},
        {"type": "Feature", "geometry": None, "properties": {}},
    ],
}


def test_geojson(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(GEO, indent=1))
    rows = geojson.read(spark, str(tmp_path / "a.geojson")).collect()
    assert [r.geom_type for r in rows] == [1, 1, 1, 5, 5, 6, 6]
    assert rows[0].properties == {"name": "p", "n": "3.0", "ok": "true", "deep": '{"a":[1]}'} and rows[0].types == {"name": 0, "n": 1, "ok": 2, "deep": 0}
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(f) for f in GEO["features"][:2]) + "\n")
    assert geojson.read(spark, str(tmp_path / "b.jsonl"), ["name"]).count() == 3
    with pytest.raises(ValueError):
        list(geojson.features({"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": []}}))
    geojson.write(geojson.read(spark, str(tmp_path / "a.geojson")), str(tmp_path / "c.geojson"))
    assert len(json.loads((tmp_path / "c.geojson").read_text())["features"]) == 7
    assert list(geojson.documents('{"a":1}\n\x1e{"b":2}')) == [{"a": 1}, {"b": 2}]


def test_shapefile(spark, tmp_path):
    cols = [("name", "C", 8, 0), ("n", "N", 6, 0), ("d", "N", 8, 2), ("ok", "L", 1, 0)]
    outer = [(7, 43), (7, 44), (8, 44), (8, 43), (7, 43)]
    hole = [(7.2, 43.2), (7.4, 43.2), (7.4, 43.4), (7.2, 43.2)]
    base = str(tmp_path / "s")
    shapefile.write(base, 5, [[outer, hole], [[(100, 10), (100, 11), (101, 11), (100, 10)]]], cols, [["a", "1", "2.50", "T"], ["b", "2", "3.50", "F"]])
    rows = shapefile.read(spark, base + ".shp", (6, 42, 9, 45)).collect()
    assert len(rows) == 1 and rows[0].properties == {"name": "a", "n": "1", "d": "2.50", "ok": "true"} and rows[0].types == {"name": 0, "n": 1, "d": 2, "ok": 3}
    assert overlay.area(wkb.polygons(rows[0].geom)) == pytest.approx(1 - 0.02)
    assert shapefile.read(spark, base + ".shp", columns=["n"]).first().properties == {"n": "1"}
    shapefile.write(base, 3, [[[(0, 0), (1, 1)], [(2, 2), (3, 95)]]], cols, [["a", "1", "2.5", "T"]])
    lines = shapefile.read(spark, base + ".shp").collect()
    assert [wkb.load(r.geom)[1] for r in lines] == [[(0, 0), (1, 1)], [(2, 2), (3, 85.0511)]]
    shapefile.write(base, 1, [(1.0, 2.0), (50.0, 2.0)], cols, [["a", "1", "2.5", "T"], ["b", "", "", "F"]])
    assert shapefile.read(spark, base + ".shp", (0, 0, 9, 9)).count() == 1
    shapefile.write(base, 8, [[[(1.0, 2.0), (2.0, 2.0)]]], cols, [["a", "1", "2.5", "T"]])
    assert shapefile.read(spark, base + ".shp").count() == 2


def test_external_layer(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps(GEO))
    c = C.parse({"settings": SETTINGS | {"bounding_box": [7.2, 43.2, 7.8, 43.8]}, "layers": {"ocean": {"minzoom": 0, "maxzoom": 14, "source": str(tmp_path / "a.geojson"), "source_columns": True}}})
    found = build.features(spark, c, rules.COASTLINE, [])
    rows = found.collect()
    assert {r.geom_type for r in rows} == {0, 2, 3} and all(r.attrs[0].s == "ocean" for r in rows)
    assert max(x for r in rows if r.geom_type == 3 for p in wkb.polygons(r.geom) for x, _ in p[0]) == pytest.approx(7.8)
    assert build.encoded(found, c).where("z = 8").count() >= 1


def test_limits_and_high_resolution(spark):
    attrs = f"array<{A.ATTRIBUTE}>"
    pts = [(i, i, 0, "a", 0, wkb.dump(1, (7.4 + i / 1e4, 43.0)), [], 0, i) for i in range(10)]
    df = spark.createDataFrame(pts, f"feature_id long, osm_id long, source_pos int, layer string, geom_type int, geom binary, attrs {attrs}, fmin int, z_order int")
    c = conf({"a": {"minzoom": 8, "maxzoom": 14, "feature_limit": 3, "feature_limit_below": 10, "combine_points": False}}, high_resolution=True)
    tiles = build.encoded(df, c).collect()
    n = {}
    for r in tiles:
        (la,) = mvt.decode(bytes(r.data))
        assert la.extent == (8192 if r.z == 14 else 4096)
        n[r.z] = n.get(r.z, 0) + len(la.features)
    assert n[8] == n[9] == 3 and n[10] == 10
    assert sorted(f.id for r in tiles if r.z == 8 for f in mvt.decode(bytes(r.data))[0].features) == [7, 8, 9]  # high z_order first
    with pytest.raises(Exception, match="unknown layer"):
        build.encoded(df.withColumn("layer", F.lit("b")), c).collect()


def test_pmtiles_directories():
    rng = random.Random(1)
    entries = [(i * 3 + rng.randrange(3), rng.randrange(1 << 40), rng.randrange(9999), rng.randrange(1, 3)) for i in range(30000)]
    root, leaves = pmtiles.directories(entries)
    assert leaves and len(root) <= pmtiles.ROOT_ROOM - pmtiles.HEADER
    found = [e for h in pmtiles.read_directory(root) for e in pmtiles.read_directory(leaves[h[1] : h[1] + h[2]])]
    assert found == entries
    assert pmtiles.directories(entries[:50])[1] == b""
    assert [pmtiles.tile_id(*t) for t in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0))] == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("mode", compression.MODES)
def test_compression(mode):
    text = b"a random string to be compressed"
    for level in (1, 6, 9):
        assert compression.decompress(compression.compress(text, mode, level), mode) == text


def test_newline_chunks(tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_bytes(b"".join(b'{"n": %d}\n' % i for i in range(100)))
    for n in (1, 3, 7, 1000):
        chunks = C.newline_chunks(str(path), n)
        data = path.read_bytes()
        assert b"".join(data[a : a + k] for a, k in chunks) == data and all(data[a + k - 1 : a + k] == b"\n" for a, k in chunks)


def test_stream_into_store(spark, tmp_path):
    from tessella.streaming import incremental

    attrs = f"array<{A.ATTRIBUTE}>"
    schema = f"feature_id long, osm_id long, source_pos int, layer string, geom_type int, geom binary, attrs {attrs}, fmin int, z_order int"
    c = conf({"a": {"minzoom": 8, "maxzoom": 9}})
    for i in range(2):
        rows = [(i, i, 0, "a", 0, wkb.dump(1, (7.4 + i / 10, 43.0)), [], 0, 0)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.start(stream, str(tmp_path / "store"), c, str(tmp_path / "cp"), availableNow=True)
    q.awaitTermination()
    assert len(incremental.versions(spark, str(tmp_path / "store"))) == 2
    tiles = incremental.current(spark, str(tmp_path / "store")).where("z = 8").collect()
    assert sum(len(f.geometry) for r in tiles for la in mvt.decode(bytes(r.data)) for f in la.features) == 2


def test_spatial_predicates(spark):
    from tessella.operators import spatial as S

    def rows(shapes, names):
        out = []
        for i, (p, n) in enumerate(zip(shapes, names, strict=True)):
            xs, ys = [q[0] for q in p[0]], [q[1] for q in p[0]]
            out.append((i, n, wkb.dump(3, p), float(min(xs)), float(min(ys)), float(max(xs)), float(max(ys))))
        return out

    tri = [[(0, 0), (4, 0), (0, 4), (0, 0)]]
    sq = lambda x, y, s: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]
    shapes = spark.createDataFrame(rows([tri], ["t"]), "shape_id int, name string, s_geom binary, s_min_x double, s_min_y double, s_max_x double, s_max_y double")
    objects = spark.createDataFrame(rows([sq(0.5, 0.5, 1), sq(3, 3, 1), sq(1, 1, 2)], "abc"), "id int, n string, geom binary, min_x double, min_y double, max_x double, max_y double")
    both = S.candidates(objects, shapes, 1.0)
    assert sorted(r.id for r in both.collect()) == [0, 1, 2]
    exact = both.select("id", S.exact_polygons("intersects")("geom", "s_geom").alias("i"), S.exact_polygons("covered_by")("geom", "s_geom").alias("c"), S.exact_polygons("area")("geom", "s_geom").alias("a"))
    assert {r.id: (r.i, r.c, round(r.a, 6)) for r in exact.collect()} == {0: (1, 1, 1.0), 1: (0, 0, 0.0), 2: (1, 0, 2.0)}
    assert {r.id: round(r.area, 6) for r in S.area_intersecting(objects, shapes, 1.0, S.exact_polygons("area")("geom", "s_geom")).collect()}[2] == 2.0
