"""Geometry as nested lists and as WKB.

In Python a point is (x, y), a line a list of points, a polygon a list of closed rings (outer first), a multi-geometry a
list of those. Only the two-dimensional types are written; Z and M values of what is read are dropped.
"""

from __future__ import annotations

import struct

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON = 1, 2, 3, 4, 5, 6


def _points(pts) -> bytes:
    flat = [v for p in pts for v in p[:2]]
    return struct.pack(f"<I{len(flat)}d", len(pts), *flat)


def dump(kind: int, geom) -> bytes:
    head = struct.pack("<BI", 1, kind)
    if kind == POINT:
        return head + struct.pack("<2d", *geom[:2])
    if kind == LINE:
        return head + _points(geom)
    if kind == POLYGON:
        return head + struct.pack("<I", len(geom)) + b"".join(_points(r) for r in geom)
    if kind in (MULTIPOINT, MULTILINE, MULTIPOLYGON):
        return head + struct.pack("<I", len(geom)) + b"".join(dump(kind - 3, g) for g in geom)
    raise ValueError(f"geometry type {kind}")


def load(data: bytes):
    """(kind, geometry)."""
    kind, geom, end = _load(bytes(data), 0)
    if end != len(data):
        raise ValueError("bytes after the geometry")
    return kind, geom


def _load(b: bytes, at: int):
    order = "<" if b[at] else ">"
    (code,) = struct.unpack_from(order + "I", b, at + 1)
    at += 5
    if code & 0x20000000:  # a reference system id precedes
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    if code >= 1000:
        dims, code = 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3), code % 1000

    def points(at):
        (n,) = struct.unpack_from(order + "I", b, at)
        v = struct.unpack_from(f"{order}{n * dims}d", b, at + 4)
        return [(v[i], v[i + 1]) for i in range(0, n * dims, dims)], at + 4 + 8 * n * dims

    if code == POINT:
        v = struct.unpack_from(f"{order}{dims}d", b, at)
        return code, (v[0], v[1]), at + 8 * dims
    if code == LINE:
        pts, at = points(at)
        return code, pts, at
    (n,) = struct.unpack_from(order + "I", b, at)
    at += 4
    out = []
    for _ in range(n):
        if code == POLYGON:
            item, at = points(at)
        else:
            _, item, at = _load(b, at)
        out.append(item)
    return code, out, at


def polygons(data: bytes) -> list:
    """The polygons of an area geometry."""
    kind, geom = load(data)
    if kind == POLYGON:
        return [geom]
    if kind == MULTIPOLYGON:
        return geom
    return []


def lines(data: bytes) -> list:
    """The lines of a line geometry, or the rings of an area."""
    kind, geom = load(data)
    return {LINE: lambda: [geom], MULTILINE: lambda: geom, POLYGON: lambda: geom, MULTIPOLYGON: lambda: [r for p in geom for r in p]}.get(kind, list)()
