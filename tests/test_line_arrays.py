"""Lines of a batch measured together against the kernels of one line."""

import time

import numpy as np
import pyarrow as pa
import pytest

from tessella.kernels import batches as B
from tessella.kernels import lines as K
from tessella.kernels import wkb


def made(n, most, grid=None, seed=3):
    r = np.random.default_rng(seed)
    counts = r.integers(1, most + 1, n)
    xy = r.uniform(-185, 185, (int(counts.sum()), 2))
    if grid:
        xy = np.round(xy / grid) * grid
    again = np.flatnonzero(r.random(len(xy)) < 0.1)
    xy[again] = xy[np.maximum(again - 2, 0)]
    return counts, xy


def each(counts, xy):
    return [[tuple(p) for p in part.tolist()] for part in np.split(xy, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize(("n", "most", "grid"), [(300, 9, None), (300, 6, 5.625), (20, 80, None), (200, 5, 45.0)])
@pytest.mark.parametrize("zoom", [0, 3, 6])
def test_coverage(n, most, grid, zoom):
    counts, xy = made(n, most, grid)
    owner, x, y = B.covered_by_lines(np.repeat(np.arange(n), counts), xy, zoom)
    want = [K.covered_by_line(line, zoom) for line in each(counts, xy)]
    assert list(zip(owner.tolist(), x.tolist(), y.tolist(), strict=True)) == [(i, *t) for i, s in enumerate(want) for t in sorted(s)]
    assert B.fill_sizes(owner, x, y, n).tolist() == [len(K.fill(s)) for s in want]


@pytest.mark.parametrize(("n", "most", "grid"), [(400, 9, None), (300, 33, None), (10, 300, None), (300, 12, 30.0)])
@pytest.mark.parametrize("distance", [0.0, 3.0, 20.0])
def test_simplified(n, most, grid, distance):
    counts, xy = made(n, most, grid)
    split = np.cumsum(counts)[:-1]
    for many, one in ((B.douglas_peucker, K.douglas_peucker), (B.visvalingam, K.visvalingam)):
        got = [[tuple(p) for p in part[k].tolist()] for part, k in zip(np.split(xy, split), np.split(many(counts, xy, distance), split), strict=True)]
        assert got == [one(line, distance) for line in each(counts, xy)]
    box = (-180, -180, 180, 180)
    assert B.pixel_counts(counts, xy, box, 64).tolist() == [len(K.quantise(line, box, 64)) for line in each(counts, xy)]


def test_wkb_of_lines():
    counts, xy = made(50, 7)
    got = B.line_wkb(counts, xy)
    assert got.to_pylist() == [wkb.dump(wkb.LINE, line) for line in each(counts, xy)]
    assert B.line_wkb(counts[:0], xy[:0]).equals(pa.array([], pa.binary()))


def test_time_for_many_lines():
    counts, xy = made(100000, 7)
    began = time.time()
    for some in B.few(counts, 20000):
        to = slice(int(counts[: some.start].sum()), int(counts[: some.stop].sum()))
        n = counts[some]
        B.fill_sizes(*B.covered_by_lines(np.repeat(np.arange(len(n)), n), xy[to], 6), len(n))
        B.douglas_peucker(n, xy[to], 20.0)
        B.visvalingam(n, xy[to], 20.0)
    assert time.time() - began < 8
