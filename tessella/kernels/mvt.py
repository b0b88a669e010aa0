"""Mapbox Vector Tile encoding and decoding (format version 2)."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from tessella.kernels import overlay
from tessella.kernels.protobuf import (
    block, double, fields, joined_rows, number, packed, read_uvarint, signed, single, uvarint, unzigzag, varint_bytes, varint_matrix, varints, zigzag, zigzags,
)

POINT, LINE, POLYGON = 1, 2, 3
MOVE, DRAW, CLOSE = 1, 2, 7


@dataclass
class Feature:
    """geometry: points, or a list of lines, or a list of polygons (each a list of closed rings), in pixels."""

    kind: int
    geometry: list
    properties: dict
    id: int | None = None


@dataclass
class Layer:
    name: str
    extent: int = 4096
    version: int = 2
    features: list[Feature] = field(default_factory=list)


class Float32(float):
    """A property that is written as a 32-bit float."""


def value(v) -> bytes:
    if isinstance(v, bool):
        return number(7, int(v))
    if isinstance(v, int):
        return number(6, zigzag(v)) if v < 0 else number(5, v)
    if isinstance(v, Float32):
        return single(2, v)
    return double(3, v) if isinstance(v, float) else block(1, str(v).encode())


def read_value(b):
    for f, _, v in fields(b):
        if f == 1:
            return bytes(v).decode()
        if f == 2:
            return struct.unpack("<f", v)[0]
        if f == 3:
            return struct.unpack("<d", v)[0]
        if f == 4:
            return signed(v)
        if f == 5:
            return v
        if f == 6:
            return unzigzag(v)
        if f == 7:
            return bool(v)
    return None


class _Pen:
    def __init__(self):
        self.out, self.x, self.y = [], 0, 0

    def go(self, command: int, points) -> None:
        self.out.append(len(points) << 3 | command)
        for x, y in points:
            self.out += [zigzag(x - self.x), zigzag(y - self.y)]
            self.x, self.y = x, y


def rings_for_tile(poly) -> list:
    """Rings as a tile has them: in pixel space (y down) outers run with positive area, holes with negative."""
    out = []
    for i, ring in enumerate(poly):
        pts = ring[:-1]
        if len(pts) < 3:
            if not i:
                return []
            continue
        a = overlay.area_of_ring(ring)
        if not a:
            if not i:
                return []
            continue
        out.append(pts if (a > 0) == (i == 0) else pts[::-1])
    return out


def commands(kind: int, geometry) -> list[int]:
    pen = _Pen()
    if kind == POINT:
        if geometry:
            pen.go(MOVE, geometry)
    elif kind == LINE:
        for line in geometry:
            if len(line) > 1:
                pen.go(MOVE, line[:1])
                pen.go(DRAW, line[1:])
    else:
        for poly in geometry:
            for ring in rings_for_tile(poly):
                pen.go(MOVE, ring[:1])
                pen.go(DRAW, ring[1:])
                pen.out.append(1 << 3 | CLOSE)
    return pen.out


#: Points that are made into bytes at once.
CHUNK = 1 << 16


class LayerWriter:
    """A layer whose features are made into bytes as they come, so only its bytes are held."""

    def __init__(self, name: str, extent: int = 4096, version: int = 2):
        self.name, self.extent, self.version = name, extent, version
        self.keys: dict[str, int] = {}
        self.values: dict[bytes, int] = {}
        self.body: list[bytes] = []

    def tags(self, properties: dict) -> bytes:
        out = []
        for k, v in properties.items():
            if v is not None:
                out += [self.keys.setdefault(k, len(self.keys)), self.values.setdefault(value(v), len(self.values))]
        return packed(2, out) if out else b""

    def add(self, kind: int, geometry, properties: dict, fid: int | None) -> None:
        """A feature; one without geometry is left out."""
        drawn = commands(kind, geometry)
        if drawn:
            head = number(1, fid) if fid is not None else b""
            self.body.append(block(2, head + self.tags(properties) + number(3, kind) + packed(4, drawn)))

    def add_points(self, x, y, properties: dict, ids, valid) -> None:
        """A feature for each point; ids count where valid."""
        for at in range(0, len(x), CHUNK):
            px, py, own, has = (v[at : at + CHUNK] for v in (x, y, ids, valid))
            n = len(px)
            fixed = lambda b: (np.broadcast_to(np.frombuffer(b, np.uint8), (n, len(b))), np.full(n, len(b)))
            number_, size = varint_matrix(own.view(np.uint64))
            zx, zy = varint_matrix(zigzags(px)), varint_matrix(zigzags(py))
            tags = self.tags(properties)
            drawn = 1 + zx[1] + zy[1]
            parts = [(fixed(b"\x08")[0], has.astype(np.int64)), (number_, size * has), fixed(tags + number(3, POINT) + b"\x22"), varint_matrix(drawn), fixed(b"\x09"), zx, zy]
            whole = varint_matrix(sum(p[1] for p in parts))
            self.body.append(joined_rows([fixed(b"\x12"), whole, *parts]))

    def add_multipoint(self, x, y, properties: dict, fid: int | None) -> None:
        """One feature of all points."""
        if not len(x):
            return
        both = np.empty(2 * len(x), np.int64)
        both[::2], both[1::2] = np.diff(x, prepend=0), np.diff(y, prepend=0)
        drawn = [uvarint(len(x) << 3 | MOVE)] + [varint_bytes(zigzags(both[i : i + CHUNK])) for i in range(0, len(both), CHUNK)]
        head = (number(1, fid) if fid is not None else b"") + self.tags(properties) + number(3, POINT) + b"\x22" + uvarint(sum(map(len, drawn)))
        self.body += [b"\x12", uvarint(len(head) + sum(map(len, drawn))), head, *drawn]

    def add_raw(self, feature: bytes) -> None:
        """A feature's message whose tags count in this layer."""
        self.body += [b"\x12", uvarint(len(feature)), feature]

    def finish(self) -> bytes:
        """The layer; nothing if it has no feature."""
        if not self.body:
            return b""
        head = number(15, self.version) + block(1, self.name.encode())
        tail = b"".join(block(3, k.encode()) for k in self.keys) + b"".join(block(4, v) for v in self.values) + number(5, self.extent)
        size = len(head) + sum(map(len, self.body)) + len(tail)
        return b"".join([b"\x1a", uvarint(size), head, *self.body, tail])


def encode(layers: list[Layer]) -> bytes:
    """A tile; features without geometry and layers without features are left out."""
    out = []
    for layer in layers:
        w = LayerWriter(layer.name, layer.extent, layer.version)
        for f in layer.features:
            w.add(f.kind, f.geometry, f.properties, f.id)
        out.append(w.finish())
    return b"".join(out)


def read_geometry(kind: int, drawn) -> list:
    x = y = at = 0
    paths: list[list] = []
    drawn = [int(v) for v in drawn]
    while at < len(drawn):
        command, n = drawn[at] & 7, drawn[at] >> 3
        at += 1
        if command == CLOSE:
            paths[-1].append(paths[-1][0])
            continue
        for _ in range(n):
            x, y = x + unzigzag(drawn[at]), y + unzigzag(drawn[at + 1])
            at += 2
            if command == MOVE:
                paths.append([(x, y)])
            else:
                paths[-1].append((x, y))
    if kind == POINT:
        return [p[0] for p in paths]
    if kind == LINE:
        return paths
    polys: list[list] = []
    for ring in paths:
        if overlay.area_of_ring(ring) > 0 or not polys:
            polys.append([ring])
        else:
            polys[-1].append(ring)
    return polys


def read_points(drawn) -> tuple[np.ndarray, np.ndarray]:
    """x and y of a point geometry's packed commands."""
    raw = varints(drawn)
    at, taken = 0, []
    while at < len(raw):  # mostly one command
        n = int(raw[at]) >> 3
        taken.append(raw[at + 1 : at + 1 + 2 * n])
        at += 1 + 2 * n
    v = np.concatenate(taken) if taken else raw
    d = (v >> np.uint64(1)).astype(np.int64) ^ -(v & np.uint64(1)).astype(np.int64)
    return np.cumsum(d[::2]), np.cumsum(d[1::2])


def _small(b) -> list[int]:
    """Varints of a short packed field."""
    if len(b) > 64:
        return varints(b).tolist()
    out, n, shift = [], 0, 0
    for c in b:
        n |= (c & 127) << shift
        if c < 128:
            out.append(n)
            n = shift = 0
        else:
            shift += 7
    return out


class LayerReader:
    """A layer's head, and its features one at a time."""

    def __init__(self, data):
        self.data, self.name, self.extent, self.version = data, "", 4096, 1
        self.keys: list[str] = []
        self.raw_values: list[bytes] = []
        for g, _, v in fields(data):
            if g == 1:
                self.name = bytes(v).decode()
            elif g == 3:
                self.keys.append(bytes(v).decode())
            elif g == 4:
                self.raw_values.append(bytes(v))
            elif g == 5:
                self.extent = v
            elif g == 15:
                self.version = v
        self.values = [read_value(v) for v in self.raw_values]

    def messages(self) -> Iterator[memoryview]:
        for g, _, v in fields(self.data):
            if g == 2:
                yield v

    def features(self) -> Iterator[tuple[int, int | None, dict, memoryview]]:
        """(kind, id, properties, packed commands)."""
        known: dict[bytes, dict] = {}
        for r in self.messages():
            kind, fid, tags, drawn = 0, None, b"", b""
            for g, _, v in fields(r):
                if g == 1:
                    fid = v
                elif g == 2:
                    tags = bytes(v)
                elif g == 3:
                    kind = v
                elif g == 4:
                    drawn = v
            p = known.get(tags)
            if p is None:
                t = _small(tags)
                p = {self.keys[a]: self.values[c] for a, c in zip(t[::2], t[1::2], strict=True)}
                if len(known) < 4096:
                    known[tags] = p
            yield kind, fid, p, drawn


def layers(data) -> Iterator[LayerReader]:
    for f, _, b in fields(data):
        if f == 3:
            yield LayerReader(b)


def single_point(drawn) -> tuple[int, int] | None:
    """The point of a geometry of one point, None for any other."""
    if len(drawn) > 11 or not len(drawn) or drawn[0] != 1 << 3 | MOVE:
        return None
    x, at = read_uvarint(drawn, 1)
    y, at = read_uvarint(drawn, at)
    return (unzigzag(x), unzigzag(y)) if at == len(drawn) else None


def n_paths(kind: int, drawn) -> int:
    """How many points, lines or polygons a geometry has."""
    if kind == POINT:
        return 1 if single_point(drawn) else len(read_points(drawn)[0])
    return len(read_geometry(kind, _small(drawn)))


def decode(data: bytes) -> list[Layer]:
    return [
        Layer(la.name, la.extent, la.version, [Feature(kind, read_geometry(kind, _small(drawn)), dict(p), fid) for kind, fid, p, drawn in la.features()])
        for la in layers(data)
    ]


def merged(a: LayerReader, b: LayerReader) -> bytes:
    """A layer with the features of both, a's first; b's tags are numbered anew. 64-bit numbers become 32-bit ones, as layers write them."""
    w = LayerWriter(a.name, a.extent, a.version)
    for la in (a, b):
        keys = [w.keys.setdefault(k, len(w.keys)) for k in la.keys]
        values = [w.values.setdefault(value(Float32(v)) if isinstance(v, float) else raw, len(w.values)) for v, raw in zip(la.values, la.raw_values, strict=True)]
        if keys == list(range(len(keys))) and values == list(range(len(values))):
            for r in la.messages():
                w.add_raw(bytes(r))
            continue
        known: dict[bytes, bytes] = {}
        for r in la.messages():
            out = []
            for g, kind, v in fields(r):
                if g == 2:
                    tags = bytes(v)
                    if tags not in known:
                        if len(known) > 4096:
                            known.clear()
                        t = _small(tags)
                        known[tags] = packed(2, [values[n] if i % 2 else keys[n] for i, n in enumerate(t)])
                    out.append(known[tags])
                else:
                    out.append(number(g, v) if kind == 0 else block(g, bytes(v)))
            w.add_raw(b"".join(out))
    return w.finish()


def written(a: LayerReader) -> bytes:
    """A layer as it is written here."""
    return merged(a, LayerReader(b""))
