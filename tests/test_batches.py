"""Kernels over many shapes at once against those of one shape, and layers that are written and read a feature at a time."""

import numpy as np
import pyarrow as pa
import pytest

from tessella.kernels import batches as B
from tessella.kernels import mvt, wkb
from tessella.operators import render


def shapes(n, points):
    r = np.random.default_rng(7)
    return [[tuple(p) for p in r.uniform(-185, 185, (int(k), 2)).tolist()] for k in r.integers(1, points + 1, n)]


@pytest.mark.parametrize("clip", [None, (-20.0, -30.0, 100.0, 50.0)])
def test_pieces_of_many(clip):
    lines = [*shapes(60, 6), [(-90.0, 0.0), (-90.0, 45.0), (-90.0, 0.0), (-45.0, 0.0)], [(1.0, 1.0), (1.0, 1.0)]]
    low, high = np.arange(len(lines)) % 3, np.full(len(lines), 4)
    column = pa.array([wkb.dump(wkb.LINE, line) for line in lines])
    ok, n = B.plain_lines(column)
    assert ok.all()
    got = [(z, i, x, y, g) for z, k, tx, ty, parts in B.line_tiles(*B.line_points(column, np.arange(len(lines)), n), low, high, render.MARGIN, clip)
           for i, x, y, g in zip(k.tolist(), tx.tolist(), ty.tolist(), parts.to_pylist(), strict=True)]
    want = [(z, i, x, y, wkb.dump(wkb.MULTILINE, p)) for i, line in enumerate(lines) for z, x, y, p in render.descend(render.LINE, [line], int(low[i]), 4, clip)]
    assert sorted(got) == sorted(want)
    at = np.array([p for line in lines for p in line])
    low, high = np.arange(len(at)) % 7, np.full(len(at), 5)
    got = [(z, int(i), int(x), int(y)) for z, k, tx, ty in B.point_tiles(at[:, 0], at[:, 1], low, high, render.MARGIN, clip) for i, x, y in zip(k, tx, ty, strict=True)]
    assert sorted(got) == sorted((z, i, x, y) for i, p in enumerate(at.tolist()) for z, x, y, _ in render.descend(render.POINT, [tuple(p)], int(low[i]), 5, clip))


def test_layer_written_a_feature_at_a_time():
    """Many points go through a layer as arrays; they read as those written one by one."""
    r = np.random.default_rng(3)
    x, y = r.integers(-256, 4352, (2, 70000))
    ids, valid = r.integers(-5, 1 << 40, 70000), r.random(70000) < 0.9
    w = mvt.LayerWriter("a")
    w.add_points(x, y, {"k": "v", "n": 300}, ids, valid)
    w.add_multipoint(x, y, {"k": "w"}, 5)
    plain = [mvt.Feature(1, [p], {"k": "v", "n": 300}, i if ok else None) for p, i, ok in zip(zip(x.tolist(), y.tolist(), strict=True), ids.tolist(), valid.tolist(), strict=True)]
    plain.append(mvt.Feature(1, list(zip(x.tolist(), y.tolist(), strict=True)), {"k": "w"}, 5))
    data = w.finish()
    assert data == mvt.encode([mvt.Layer("a", features=plain)])
    (la,) = mvt.layers(data)
    *_, last = la.features()
    px, py = mvt.read_points(last[3])
    assert (px == x).all() and (py == y).all()


def test_merge_numbers_tags_anew():
    one, two = (mvt.encode([mvt.Layer("a", features=[mvt.Feature(1, [(n, n)], {k: v, "both": 1.5}) for n, (k, v) in enumerate(kv)])]) for kv in ([("p", "x"), ("q", "y")], [("q", "y"), ("r", "x")]))
    (la,) = mvt.decode(render.merge_encoded(one, two))
    assert [f.properties for f in la.features] == [{"p": "x", "both": 1.5}, {"q": "y", "both": 1.5}] * 1 + [{"q": "y", "both": 1.5}, {"r": "x", "both": 1.5}]


def test_many_records_of_a_shapefile(tmp_path):
    """Writing takes time in proportion to the records."""
    import time

    from tessella.sources import shapefile

    began, base = time.time(), str(tmp_path / "many")
    shapefile.write(base, 1, [(k / 1000, 1.0) for k in range(150000)], [("id", "N", 8, 0)], [[str(k)] for k in range(150000)])
    assert sum(1 for _ in shapefile.records(base + ".shp")) == 150000
    assert time.time() - began < 15


def test_features_of_a_long_collection():
    """A collection is read piece by piece, whatever stands before its features, nested or not."""
    import io
    import json

    from tessella.sources import geojson

    made = [{"type": "Feature", "id": k, "geometry": {"type": "Point", "coordinates": [k / 7, 1.5]}, "properties": {"name": "\u00fc\u4e00" * 5, "n": k}} for k in range(300)]
    nested = {"name": "x", "features": [{"type": "FeatureCollection", "features": made[:100]}, *made[100:200]], "type": "FeatureCollection"}
    for indent, separators in ((None, (",", ":")), (2, None)):
        text = "\x1e".join(json.dumps(d, indent=indent, separators=separators, ensure_ascii=False) for d in (nested, made[200], {"type": "FeatureCollection", "features": made[201:]}))
        want = [r for d in geojson.documents(text) for r in geojson.features(d)]
        for piece in (1, 7, 1 << 20):
            assert list(geojson.Stream(io.BytesIO(text.encode()), None, piece)) == want and len(want) == 300


def test_attributes_are_made_once(spark):
    """The last write of a key stands, and the list of attributes stands once in the expression, not in its lambdas too."""
    from pyspark.sql import functions as F

    from tessella.functions import attributes as A

    made = A.attribute_set(A.attribute("k", F.col("v")), A.attribute("e", F.lit("")), A.attribute_integer("n", F.lit(2), 3), A.attribute("k", F.lit("marked")), F.lit(None).cast(A.ATTRIBUTE))
    rows = spark.range(1).select(F.lit("a").alias("v")).select(made.alias("a"))
    assert [(x.key, x.s, x.d, x.minzoom) for x in rows.first().a] == [("k", "marked", None, 0), ("n", None, 2.0, 3)]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("marked") == 1
