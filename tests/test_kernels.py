import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.kernels import lines as K
from tessella.kernels import mvt, overlay, protobuf, wkb
from tessella.operators import render


def square(x, y, s):
    return [[(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]]


def blob(rng, n):
    c = (rng.uniform(-2, 2), rng.uniform(-2, 2))
    ring = [(c[0] + rng.uniform(0.5, 3) * math.cos(a), c[1] + rng.uniform(0.5, 3) * math.sin(a)) for a in sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))]
    return overlay.make_valid([[[*ring, ring[0]]]])


def test_overlay_areas_add_up():
    rng = random.Random(2)
    for _ in range(120):
        p, q = blob(rng, rng.randint(3, 9)), blob(rng, rng.randint(3, 9))
        a, b = overlay.area(p), overlay.area(q)
        u, i, m, x = (overlay.area(overlay.overlay(p, q, op)) for op in ("or", "and", "minus", "xor"))
        assert a + b == pytest.approx(u + i, abs=1e-6)
        assert m == pytest.approx(a - i, abs=1e-6)
        assert x == pytest.approx(u - i, abs=1e-6)


def test_overlay_shapes():
    assert overlay.overlay([square(0, 0, 2)], [square(2, 0, 2)], "or") == [[[(0, 2), (0, 0), (4, 0), (4, 2), (0, 2)]]]
    bow_tie = [[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]]
    assert overlay.area(overlay.make_valid(bow_tie)) == pytest.approx(2) and len(overlay.make_valid(bow_tie)) == 2
    ring = overlay.overlay([square(0, 0, 10)], [square(3, 3, 3)], "minus")
    assert [len(p) for p in ring] == [2] and overlay.area(ring) == pytest.approx(91)
    assert overlay.overlay([square(0, 0, 1)], [square(5, 5, 1)], "and") == []
    parts = [[square(i, 0, 1)] for i in range(6)] + [[square(20, 0, 1)]]
    joined = overlay.union_all(parts)
    assert len(joined) == 2 and overlay.area(joined) == pytest.approx(7)
    assert len(overlay.combine_overlapping([square(0, 0, 2), square(1, 1, 2), square(9, 9, 1)])) == 2
    assert overlay.area(overlay.repair(bow_tie)) == pytest.approx(2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(-170, 170), st.floats(-170, 170)), min_size=1, max_size=6), st.integers(0, 8))
def test_coverage(points, zoom):
    """Sampled points of the line lie in covered tiles, and every covered tile's box meets the line."""
    tiles = K.covered_by_line(points, zoom)
    n = 1 << zoom
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        for k in range(21):
            x, y = x0 + (x1 - x0) * k / 20, y0 + (y1 - y0) * k / 20
            t = (math.floor((x + 180) / 360 * n), math.floor((180 - y) / 360 * n))
            near = {(t[0] + i, t[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
            fx, fy = (x + 180) / 360 * n % 1, (180 - y) / 360 * n % 1
            assert t in tiles or (min(fx, fy, 1 - fx, 1 - fy) < 1e-6 and near & tiles)
    assert K.fill([(0, 1), (0, 4), (2, 2)]) == {(0, 1), (0, 2), (0, 3), (0, 4), (2, 2)}


def test_large_areas_cover_whole_blocks():
    box = render.bounds(3, 2, 2)
    w = (box[2] - box[0]) / 8
    ring = [(box[0] + w / 2, box[1] + w / 2), (box[0] + 3.5 * w, box[1] + w / 2), (box[0] + 3.5 * w, box[1] + 3.5 * w), (box[0] + w / 2, box[1] + 3.5 * w), (box[0] + w / 2, box[1] + w / 2)]
    assert len(K.covered_by_area([[ring]], 6)) == K.LARGE


def test_clip():
    box = (0, 0, 10, 10)
    assert K.clip_line([(-5, 5), (5, 5), (5, 15), (8, 15), (8, 5)], box) == [[(0, 5), (5, 5), (5, 10)], [(8, 10), (8, 5)]]
    assert K.clip_line([(20, 20), (30, 30)], box) == []
    ring = K.clip_ring(square(5, 5, 10)[0], box)
    assert overlay.area_of_ring(ring) == pytest.approx(25)
    rng = random.Random(3)
    for _ in range(50):
        p = [[[(x * 4 + 5, y * 4 + 5) for x, y in r] for r in poly] for poly in blob(rng, 7)]
        want = overlay.area(overlay.overlay(p, [square(0, 0, 10)], "and"))
        assert overlay.area(K.clip_polygons(p, box)) == pytest.approx(want, abs=1e-6)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=2, max_size=20, unique=True), st.integers(1, 6))
def test_simplify_lines(points, d):
    for f in (K.douglas_peucker, K.visvalingam):
        out = f(points, d)
        assert out[0] == points[0] and out[-1] == points[-1]
        it = iter(points)
        assert all(p in it for p in out)  # a subsequence
    kept = K.douglas_peucker(points, d)
    for p in points:
        assert min(_from_segment(p, a, b) for a, b in zip(kept, kept[1:], strict=False)) <= d + 1e-9


def _from_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def test_simplify_rings():
    ring = [(math.cos(a) * 100, math.sin(a) * 100) for a in (2 * math.pi * k / 90 for k in range(90))]
    ring.append(ring[0])
    out = K.simplify_ring(ring, 2.0)
    assert 4 < len(out) < 40 and set(out) <= set(ring) and overlay.area_of_ring(out) > 0.9 * overlay.area_of_ring(ring)
    assert K.simplify_ring(square(0, 0, 1)[0], 10) == []
    house = [(0, 0), (10, 0.1), (20, 0), (20, 10), (11, 10), (11, 10.4), (9, 10.4), (9, 10), (0, 10), (0, 0)]
    out = K.square_ring(house, 1.0)
    assert len(out) < len(house) and abs(overlay.area_of_ring(out)) == pytest.approx(200, rel=0.1)
    assert len(K.simplify_polygons([[ring]], 2.0, "visvalingam")[0][0]) < 60
    assert K.drop_small([square(0, 0, 1), square(5, 5, 4)], 2) == [square(5, 5, 4)]


def test_stitch_and_rings():
    a, b, c = [(0, 0), (1, 0)], [(1, 0), (2, 0)], [(2, 0), (3, 0)]
    assert K.stitch([b, a, c]) == [[(0, 0), (1, 0), (2, 0), (3, 0)]]
    assert len(K.stitch([a, [(2, 0), (1, 0)]])) == 2  # never reversed
    split = [[(0, 0), (4, 0)], [(4, 4), (4, 0)], [(4, 4), (0, 4)], [(0, 0), (0, 4)]]
    rings, chains = K.assemble_rings(split)
    assert len(rings) == 1 and not chains and abs(overlay.area_of_ring(rings[0])) == 16
    hole = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
    far = [(10, 10), (12, 10), (12, 12), (10, 12), (10, 10)]
    polys = K.multipolygon([*split, far], [hole])
    assert sorted(len(p) for p in polys) == [1, 2]
    assert len(K.multiline([[(0, 0), (1, 1)], [(2, 2), (1, 1)]])) == 1


def test_measures():
    assert K.length([(0, 0), (1, 0)]) == pytest.approx(111194.9, rel=1e-5)
    deg = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert K.spherical_area(deg) == pytest.approx(1.2364e10, rel=1e-3) and K.spherical_area(deg[:-1]) == 0
    u = [(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10), (0, 0)]
    assert overlay.contains(u, K.label_point([[u]])) and not overlay.contains(u, K.label_point([[u]], "centroid"))
    assert K.centroid([square(0, 0, 2)]) == pytest.approx((1, 1)) and K.line_centre([(0, 0), (4, 0)]) == (2, 0)
    with pytest.raises(ValueError):
        K.label_point([square(0, 0, 1)], "middle")
    assert K.unspiked([(0, 0), (4, 0), (9, 0), (4, 0), (4, 4), (0, 0)]) == [(0, 0), (4, 0), (4, 4), (0, 0)]
    assert K.quantise([(0, 0), (1e-9, 0), (90, 0)], (0, -180, 180, 0)) == [(0, 0), (2048, 0)]


def test_wkb():
    for kind, g in ((1, (1.5, 2.5)), (2, [(0.0, 0.0), (1.0, 1.0)]), (3, square(0.0, 0.0, 1.0)), (6, [square(0.0, 0.0, 1.0)]), (5, [[(0.0, 0.0), (1.0, 1.0)]]), (4, [(0.0, 1.0)])):
        assert wkb.load(wkb.dump(kind, g)) == (kind, g)
    with pytest.raises(ValueError):
        wkb.load(wkb.dump(1, (0, 0)) + b"x")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=30))
def test_varints(values):
    packed = protobuf.packed_deltas(1, values)
    ((field, _, body),) = list(protobuf.fields(packed))
    assert field == 1 and protobuf.deltas(body).tolist() == values if max(map(abs, values), default=0) < 2**61 else True
    assert [protobuf.unzigzag(protobuf.zigzag(v)) for v in values] == values


def test_mvt_round_trip():
    props = {"s": "v", "i": 3, "neg": -4, "f": mvt.Float32(1.5), "d": 2.25, "b": True}
    poly = [[[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)]]]
    layers = [mvt.Layer("a", 4096, 2, [mvt.Feature(1, [(5, 6), (7, 8)], props, 9), mvt.Feature(2, [[(0, 0), (5, 5), (9, 0)]], {}), mvt.Feature(3, poly, {"s": "v"})]), mvt.Layer("none")]
    (out,) = mvt.decode(mvt.encode(layers))
    assert (out.name, out.extent, out.version) == ("a", 4096, 2)
    assert out.features[0].geometry == [(5, 6), (7, 8)] and out.features[0].properties == props and out.features[0].id == 9
    assert out.features[1].geometry == [[(0, 0), (5, 5), (9, 0)]]
    assert overlay.area(out.features[2].geometry) == 77


def test_pyramid_descent():
    """A shape's tiles at a zoom are the parents of those a zoom deeper; parts stay in their grown tile."""
    rng = random.Random(6)
    shape = [[[(x * 9, y * 9) for x, y in r] for r in p] for p in blob(rng, 8)]
    by = {}
    for z, x, y, part in render.descend(render.POLY, shape, 0, 6):
        by.setdefault(z, {})[x, y] = part
        box = render.grown(render.bounds(z, x, y))
        assert all(box[0] - 1e-9 <= px <= box[2] + 1e-9 and box[1] - 1e-9 <= py <= box[3] + 1e-9 for p in part for r in p for px, py in r)
    for z in range(6):
        assert {(x >> 1, y >> 1) for x, y in by[z + 1]} <= set(by[z])
    assert overlay.area([p for part in by[0].values() for p in part]) == pytest.approx(overlay.area(shape), rel=1e-9)


def test_coverage_of_a_border_point():
    """A segment that ends on a cell's border passes only the cells it enters; a lone point still has its own."""
    line = [(-126.5642, 28.37079332768729), (-11.25, 16.47233896460499)]
    assert len(K.covered_by_line(line, 6)) == 25 and len(K.covered_by_line(line, 6, touched=False)) == 24
    assert K.covered_by_line(line[1:] * 2, 6, touched=False) == {(30, 29)}


def test_merge_encoded():
    one = mvt.encode([mvt.Layer("a", features=[mvt.Feature(1, [(1, 1)], {"k": 1})]), mvt.Layer("old", features=[mvt.Feature(1, [(2, 2)], {})])])
    two = mvt.encode([mvt.Layer("a", features=[mvt.Feature(1, [(3, 3)], {"k": 2})])])
    out = {la.name: la for la in mvt.decode(render.merge_encoded(one, two))}
    assert [f.geometry for f in out["a"].features] == [[(1, 1)], [(3, 3)]] and "old" in out
    assert mvt.decode(render.merge_encoded(b"", two)) == mvt.decode(two)
