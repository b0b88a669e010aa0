"""Points and lines of Arrow batches as numpy arrays: WKB read and written, and parts of tiles found, for many shapes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessella.kernels import lines
from tessella.kernels.protobuf import ranges, row_sums

_POINT, _LINE = (np.frombuffer(b"\x01" + bytes([k, 0, 0, 0]), np.uint8) for k in (1, 2))
_ONE = np.frombuffer(b"\x01\x04\0\0\0\x01\0\0\0\x01\x01\0\0\0", np.uint8)  # a multipoint of one point, before its coordinates


def numbers(column: pa.Array, kind=np.int64) -> np.ndarray:
    """A column's numbers, 0 for null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(kind, copy=False)


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column."""
    column = column.cast(pa.binary()) if column.type != pa.binary() else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive bytes that end at `ends`."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def starts_with(offsets, data, head: np.ndarray, size: int) -> np.ndarray:
    """Which values have at least `size` bytes and begin with `head`."""
    ok = np.diff(offsets) >= size
    at = offsets[:-1][ok]
    ok[ok] = (data[at[:, None] + np.arange(len(head))] == head).all(1) if len(at) else True
    return ok


def single_points(column: pa.Array, multi: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which values are one point, x, y); multi: as a multipoint of one."""
    head = _ONE if multi else _POINT
    offsets, data = binary(column)
    ok = starts_with(offsets, data, head, len(head) + 16) & (np.diff(offsets) == len(head) + 16)
    xy = np.zeros((len(column), 2))
    at = offsets[:-1][ok] + len(head)
    if len(at):
        xy[ok] = np.ascontiguousarray(data[at[:, None] + np.arange(16)]).view("<f8")
    return ok, xy[:, 0], xy[:, 1]


def point_wkb(x: np.ndarray, y: np.ndarray, multi: bool = False) -> pa.Array:
    """Points as WKB; multi: each as a multipoint of one."""
    head = _ONE if multi else _POINT
    out = np.empty((len(x), len(head) + 16), np.uint8)
    out[:, : len(head)] = head
    out[:, len(head) :] = np.ascontiguousarray(np.column_stack([x, y]), "<f8").view(np.uint8).reshape(len(x), 16)
    return binary_array(out.reshape(-1), np.arange(1, len(x) + 1) * out.shape[1])


def plain_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which values are plain lines, how many points each of them has; 0 for others)."""
    offsets, data = binary(column)
    ok = starts_with(offsets, data, _LINE, 9)
    at = offsets[:-1][ok] + 5
    n = np.zeros(len(column), np.int64)
    if len(at):
        n[ok] = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4")[:, 0]
    ok &= np.diff(offsets) == 9 + 16 * n
    return ok, np.where(ok, n, 0)


def line_points(column: pa.Array, which: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in `which`, coordinates) of every point of some plain lines."""
    offsets, data = binary(column)
    count = n[which]
    owner = np.repeat(np.arange(len(which)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[:-1][which][owner] + 9 + 16 * place
    xy = np.ascontiguousarray(data[at[:, None] + np.arange(16)]).view("<f8") if len(at) else np.zeros((0, 2))
    return owner, xy


def _bounds(z, x, y):
    s = 360 / (1 << z)
    return x * s - 180, 180 - (y + 1) * s, (x + 1) * s - 180, 180 - y * s


def _grown(box, margin):
    w, h = (box[2] - box[0]) * margin, (box[3] - box[1]) * margin
    return box[0] - w, box[1] - h, box[2] + w, box[3] + h


def _beyond(box, clip):
    return (box[0] >= clip[2]) | (box[2] <= clip[0]) | (box[1] >= clip[3]) | (box[3] <= clip[1])


def point_tiles(x, y, lowest, highest, margin: float, clip=None) -> Iterator[tuple]:
    """(z, which points, tile x, tile y) of the tiles whose grown box holds each point, at zooms lowest..highest of each."""
    if not len(x):
        return
    for z in range(int(lowest.min()), int(highest.max()) + 1):
        on = np.flatnonzero((lowest <= z) & (z <= highest) & np.isfinite(x) & np.isfinite(y))
        px, py, n, s = x[on], y[on], 1 << z, 360 / (1 << z)
        fx, fy = np.floor((px + 180) / s).astype(np.int64), np.floor((180 - py) / s).astype(np.int64)
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                tx, ty = fx + i, fy + j
                box = _bounds(z, tx, ty)
                w, so, e, no = _grown(box, margin)
                hit = (tx >= 0) & (ty >= 0) & (tx < n) & (ty < n) & (px >= w) & (px <= e) & (py >= so) & (py <= no)
                if clip is not None:
                    hit &= ~_beyond(box, clip)
                k = np.flatnonzero(hit)
                if len(k):
                    yield z, on[k], tx[k], ty[k]


def clip_segments(a: np.ndarray, b: np.ndarray, box) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which segments are left, their starts, their ends) inside boxes, by Liang-Barsky as in lines.clip_line."""
    d = b - a
    t0, t1, miss = np.zeros(len(a)), np.ones(len(a)), np.zeros(len(a), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for p, q in ((-d[:, 0], a[:, 0] - box[0]), (d[:, 0], box[2] - a[:, 0]), (-d[:, 1], a[:, 1] - box[1]), (d[:, 1], box[3] - a[:, 1])):
            miss |= (p == 0) & (q < 0)
            r = q / p
            t0 = np.where((p < 0) & (r > t0), r, t0)
            t1 = np.where((p > 0) & (r < t1), r, t1)
    start = np.where((t0 == 0)[:, None], a, a + t0[:, None] * d)
    end = np.where((t1 == 1)[:, None], b, a + t1[:, None] * d)
    kept = np.flatnonzero(~miss & (t0 <= t1) & (start != end).any(1))
    return kept, start[kept], end[kept]


def line_tiles(owner, xy, lowest, highest, margin: float, clip=None) -> Iterator[tuple]:
    """(z, which lines, tile x, tile y, their parts as multiline WKB) at zooms lowest..highest of each, walked down the pyramid.

    owner: the line of each point. A part of a tile is clipped from its parent's, and parts that meet stay one line.
    """
    if not len(lowest):
        return
    seg = np.flatnonzero(owner[1:] == owner[:-1])
    a, b = xy[seg], xy[seg + 1]
    of, line = owner[seg], owner[seg]  # a segment's piece and its line
    row, tx, ty = np.arange(len(lowest)), np.zeros(len(lowest), np.int64), np.zeros(len(lowest), np.int64)  # of each piece
    for z in range(int(highest.max()) + 1):
        box = _bounds(z, tx, ty)
        kept, a, b = clip_segments(a, b, [v[of] for v in _grown(box, margin)])
        of, line = of[kept], line[kept]
        out = (z > highest[row]) | (_beyond(box, clip) if clip is not None else False)
        stay = ~out[of]
        a, b, of, line = a[stay], b[stay], of[stay], line[stay]
        if not len(of):
            return
        first = np.append(True, of[1:] != of[:-1])
        begins = first | np.append(True, line[1:] != line[:-1]) | np.append(True, (a[1:] != b[:-1]).any(1))
        pieces, of = of[first], np.cumsum(first) - 1
        row, tx, ty, line = row[pieces], tx[pieces], ty[pieces], np.cumsum(begins) - 1
        some = np.flatnonzero(z >= lowest[row])
        if len(some):
            data, ends = _multilines(a, b, first, begins, of)
            got = binary_array(data, ends)
            yield z, row[some], tx[some], ty[some], got.take(pa.array(some))
        # each piece goes to its four children
        n, m = len(row), int(line[-1]) + 1
        child = [(i, j) for i in (0, 1) for j in (0, 1)]
        a, b = np.tile(a, (4, 1)), np.tile(b, (4, 1))
        of, line = (np.concatenate([v + k * size for k in range(4)]) for v, size in ((of, n), (line, m)))
        row, tx, ty = np.tile(row, 4), np.concatenate([2 * tx + i for i, _ in child]), np.concatenate([2 * ty + j for _, j in child])


def _multilines(a, b, first, begins, of) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each piece) of pieces as multilines."""
    end = np.cumsum(16 + 25 * begins + 9 * first)
    data = np.empty(int(end[-1]), np.uint8)

    def put(at, values):
        data[at[:, None] + np.arange(values.shape[1])] = values

    def head(code, counts):
        out = np.empty((len(counts), 9), np.uint8)
        out[:, :5] = np.frombuffer(b"\x01" + bytes([code, 0, 0, 0]), np.uint8)
        out[:, 5:] = counts.astype("<u4").view(np.uint8).reshape(-1, 4)
        return out

    coords = lambda v: np.ascontiguousarray(v, "<f8").view(np.uint8).reshape(-1, 16)
    new = np.flatnonzero(begins)
    put(end - 16, coords(b))
    put(end[new] - 32, coords(a[new]))
    put(end[new] - 41, head(2, np.diff(np.append(new, len(begins))) + 1))
    put(end[first] - 50, head(5, np.bincount(of[new])))
    last = np.flatnonzero(np.append(first[1:], True))
    return data, end[last]


def few(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive rows whose sizes sum to about `most`."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


# lines: written as WKB, tiles they pass, points that are left of them


def line_wkb(counts: np.ndarray, xy: np.ndarray) -> pa.Array:
    """Lines of so many consecutive points each as WKB."""
    size = 9 + 16 * counts
    end = np.cumsum(size)
    data = np.empty(int(size.sum()), np.uint8)
    data[(end - size)[:, None] + np.arange(5)] = _LINE
    data[(end - size + 5)[:, None] + np.arange(4)] = counts.astype("<u4").view(np.uint8).reshape(-1, 4)
    at = np.repeat(end - size + 9, counts) + 16 * ranges(np.zeros(len(counts), np.int64), counts)
    data[at[:, None] + np.arange(16)] = np.ascontiguousarray(xy, "<f8").view(np.uint8).reshape(-1, 16)
    return binary_array(data, end)


def covered_by_lines(owner: np.ndarray, xy: np.ndarray, zoom: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, tile x, tile y) of every tile that each line touches, once and in order, as in lines.covered_by_line."""
    n = 1 << zoom
    if not np.isfinite(xy).all():
        raise ValueError("a line leaves the plane")
    cell = np.column_stack([(xy[:, 0] + 180) / 360 * n, (180 - xy[:, 1]) / 360 * n])
    found = [(owner, np.floor(cell))]
    seg = np.flatnonzero((owner[1:] == owner[:-1]) & (cell[1:] != cell[:-1]).any(1))
    a, b = cell[seg], cell[seg + 1]
    first = np.ceil(np.minimum(a, b))
    count = np.where(a != b, np.floor(np.maximum(a, b)) - first + 1, 0).astype(np.int64)
    order = np.argsort(count.sum(1), kind="stable")
    for some in few(count.sum(1)[order] + 2, 1 << 18):
        k = order[some]
        wide = int(count[k].sum(1).max()) + 2
        cuts = np.full((len(k), wide), np.inf)
        cuts[:, 0], cuts[:, 1] = 0, 1
        at = np.full(len(k), 2)
        for axis in (0, 1):
            c = count[k, axis]
            row = np.repeat(np.arange(len(k)), c)
            border = first[k, axis][row] + ranges(np.zeros(len(k), np.int64), c)
            cuts[row, ranges(at, c)] = (border - a[k, axis][row]) / (b[k, axis] - a[k, axis])[row]
            at = at + c
        cuts.sort(1)
        row, col = np.nonzero((cuts[:, 1:] > cuts[:, :-1]) & np.isfinite(cuts[:, 1:]))
        m = ((cuts[row, col] + cuts[row, col + 1]) / 2)[:, None]
        row = k[row]
        found.append((owner[seg[row]], np.floor(a[row] + m * (b[row] - a[row]))))
    who, tile = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)
    inside = ((tile >= 0) & (tile < n)).all(1)
    code = np.sort(((who[inside] << zoom) + tile[inside, 0] << zoom) + tile[inside, 1])  # np.unique takes ten times as long
    code = code[np.diff(code, prepend=-1) != 0]
    return code >> 2 * zoom, code >> zoom & n - 1, code & n - 1


def fill_sizes(owner: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """How many tiles each of n lines has when the gaps of columns are filled; the tiles are in order."""
    first = np.append(True, (owner[1:] != owner[:-1]) | (x[1:] != x[:-1])) if len(owner) else np.zeros(0, bool)
    last = np.append(first[1:], True) if len(owner) else first
    return np.bincount(owner[first], y[last] - y[first] + 1, minlength=n).astype(np.int64)


def douglas_peucker(counts: np.ndarray, xy: np.ndarray, distance: float) -> np.ndarray:
    """Which points of lines of so many consecutive points are needed to stay within the distance, as in lines.douglas_peucker."""
    keep = np.zeros(len(xy), bool)
    end = np.cumsum(counts)
    if distance <= 0:
        return ~keep
    keep[(end - counts)[counts > 0]] = keep[end[counts > 0] - 1] = True
    a, b = (end - counts)[counts > 2], end[counts > 2] - 1
    while len(a):
        size = b - a - 1
        start = np.cumsum(size) - size
        of, at = np.repeat(np.arange(len(a)), size), ranges(a + 1, size)
        d = (xy[b] - xy[a])[of]
        mid, square = xy[at] - xy[a][of], d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
        t = np.clip((mid[:, 0] * d[:, 0] + mid[:, 1] * d[:, 1]) / np.where(square > 0, square, 1), 0, 1)
        far = np.where(square > 0, np.hypot(*(mid - t[:, None] * d).T), np.hypot(*mid.T))
        most = np.maximum.reduceat(far, start)
        k = np.minimum.reduceat(np.where(far == most[of], at, len(xy)), start)[most > distance]
        a, b = a[most > distance], b[most > distance]
        keep[k] = True
        a, b = np.concatenate([a, k]), np.concatenate([k, b])
        a, b = a[b - a > 1], b[b - a > 1]
    return keep


#: Lines of more points go through lines.visvalingam: others of a length are thinned together.
SHORT = 32


def visvalingam(counts: np.ndarray, xy: np.ndarray, distance: float, least: int = 2) -> np.ndarray:
    """Which points of lines of so many consecutive points are left, as in lines.visvalingam."""
    keep, starts, limit = np.ones(len(xy), bool), np.cumsum(counts) - counts, 8 * distance * distance
    for i in np.flatnonzero(counts > SHORT):
        here = slice(int(starts[i]), int(starts[i] + counts[i]))
        pts = [(*p, k) for k, p in enumerate(xy[here].tolist())]
        keep[here] = False
        keep[starts[i] + np.array([p[2] for p in lines.visvalingam(pts, distance, least)])] = True
    for n in np.unique(counts[(counts > max(2, least)) & (counts <= SHORT)]):
        at = starts[counts == n]
        p = xy[at[:, None] + np.arange(n)]
        before, after = np.tile(np.arange(-1, n - 1), (len(at), 1)), np.tile(np.arange(1, n + 1), (len(at), 1))

        def size(r, i):
            a, b, c = p[r, before[r, i]], p[r, i], p[r, after[r, i]]  # noqa: B023
            return np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1]))

        now, rows, floor = np.full((len(at), n), np.inf), np.arange(len(at)), np.zeros(len(at))
        for i in range(1, n - 1):
            now[:, i] = size(rows, np.full(len(at), i))
        for _ in range(n - least):
            i = now[rows].argmin(1)
            s = now[rows, i]
            rows, i, s = rows[s < limit], i[s < limit], s[s < limit]
            if not len(rows):
                break
            floor[rows] = np.maximum(floor[rows], s)
            now[rows, i] = np.inf
            keep[at[rows] + i] = False
            b, a = before[rows, i], after[rows, i]
            after[rows, b], before[rows, a] = a, b
            for k in (b, a):
                r = np.flatnonzero((k > 0) & (k < n - 1))
                now[rows[r], k[r]] = np.maximum(size(rows[r], k[r]), floor[rows[r]])
    return keep


def pixel_counts(counts: np.ndarray, xy: np.ndarray, bbox, extent: int = 4096) -> np.ndarray:
    """How many pixels lines of so many consecutive points have without repeats, as in lines.quantise."""
    sx, sy = (bbox[2] - bbox[0]) / extent, (bbox[3] - bbox[1]) / extent
    px = np.column_stack([np.floor((xy[:, 0] - bbox[0]) / sx), np.floor((bbox[3] - xy[:, 1]) / sy)])
    new = np.ones(len(xy), bool)
    new[1:] = (px[1:] != px[:-1]).any(1)
    new[(np.cumsum(counts) - counts)[counts > 0]] = True
    return row_sums(new, counts)
