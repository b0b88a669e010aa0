"""PMTiles v3: tiles in Hilbert order, contents stored once, runs of equal tiles as one entry."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import projection as P
from tessella.storage import filesystem, open_input, open_output

#: Fixed values of the format: header size, the room for header and root directory, type codes.
HEADER, ROOT_ROOM = 127, 16384
GZIP, MVT = 2, 1
#: Entries a leaf directory holds.
LEAF = 4096


def run_lengths(tiles: DataFrame, body: str, key: str = "tile_id", span: int = 1 << 20) -> DataFrame:
    """(tile_id, body, run_length): consecutive ids with the same body as one row.

    Runs are found within spans of ids, so no task sees all tiles; a run ends at a span's edge, which a reader merges or
    keeps as two entries. The default span is larger than any low zoom.
    """
    part = Window.partitionBy("_span").orderBy(key)
    t = tiles.withColumn("_span", F.floor(F.col(key) / span))
    new = (F.lag(key).over(part) + 1 == F.col(key)) & (F.lag(body).over(part) == F.col(body))
    t = t.withColumn("_new", F.when(F.coalesce(new, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(part))
    return t.groupBy("_span", "_run").agg(F.min(key).alias(key), F.first(body).alias(body), F.count("*").alias("run_length")).drop("_span", "_run")


def place(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, blobs) of tiles (z, x, y, data): blobs hold each content once, in the order of its first tile.

    A blob's offset is the sum of the lengths before it: lengths are summed per range of first ids, then within it.
    """
    t = tiles.select(P.hilbert_tile_id("z", "x", "y").alias("tile_id"), "data").withColumn("digest", F.sha2("data", 256))
    blobs = t.groupBy("digest").agg(F.min("tile_id").alias("first"), F.first("data").alias("data"), F.max(F.length("data")).cast("long").alias("length"))
    blobs = blobs.withColumn("range", F.floor(F.col("first") / 65536))
    sums = blobs.groupBy("range").agg(F.sum("length").alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum("length").over(Window.partitionBy("range").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    placed = blobs.join(sums.select("range", F.coalesce(before, F.lit(0)).alias("start")), "range")
    placed = placed.withColumn("offset", F.col("start") + F.coalesce(inside, F.lit(0)))
    entries = run_lengths(t.select("tile_id", "digest"), "digest").join(placed.select("digest", "offset", "length"), "digest")
    return entries.select("tile_id", "offset", "length", "run_length"), placed.select("first", "offset", "length", "data")


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """Entries (tile_id, offset, length, run_length) as the format's columns, gzipped."""
    out = bytearray(varint(len(entries)))
    last = 0
    for e in entries:
        out += varint(e[0] - last)
        last = e[0]
    for e in entries:
        out += varint(e[3])
    for e in entries:
        out += varint(e[2])
    for i, e in enumerate(entries):
        follows = i and e[1] == entries[i - 1][1] + entries[i - 1][2]
        out += varint(0 if follows else e[1] + 1)
    return gzip.compress(bytes(out), mtime=0)


def read_directory(data: bytes) -> list[tuple[int, int, int, int]]:
    raw, at = gzip.decompress(data), 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = raw[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    n = number()
    ids, last = [], 0
    for _ in range(n):
        last += number()
        ids.append(last)
    runs, sizes, offsets = [number() for _ in range(n)], [number() for _ in range(n)], []
    for i in range(n):
        o = number()
        offsets.append(o - 1 if o else offsets[i - 1] + sizes[i - 1])
    return list(zip(ids, offsets, sizes, runs, strict=True))


def directories(entries: list[tuple[int, int, int, int]]) -> tuple[bytes, bytes]:
    """Root and leaf directories: all in the root if it fits, else leaves of a size that lets the root fit."""
    root = directory(entries)
    if len(root) <= ROOT_ROOM - HEADER:
        return root, b""
    size = LEAF
    while True:
        leaves, heads = bytearray(), []
        for i in range(0, len(entries), size):
            leaf = directory(entries[i : i + size])
            heads.append((entries[i][0], len(leaves), len(leaf), 0))
            leaves += leaf
        root = directory(heads)
        if len(root) <= ROOT_ROOM - HEADER:
            return root, bytes(leaves)
        size *= 2


def header(root: int, metadata: int, leaves: int, data: int, counts: tuple[int, int, int], zooms: tuple[int, int], bounds: tuple[float, float, float, float], centre: tuple[float, float, int]) -> bytes:
    meta_at = HEADER + root
    leaf_at = meta_at + metadata
    e7 = lambda v: int(round(v * 1e7))
    return b"PMTiles\x03" + struct.pack(
        "<11Q6B4iB2i", HEADER, root, meta_at, metadata, leaf_at, leaves, leaf_at + leaves, data, *counts, 1, GZIP, GZIP, MVT, *zooms, *map(e7, bounds), centre[2], e7(centre[0]), e7(centre[1])
    )


def write(tiles: DataFrame, path: str, metadata: dict, bounds: tuple[float, float, float, float], zooms: tuple[int, int]) -> int:
    """Write one PMTiles file on the driver's file system; gives the number of tiles.

    Blobs stream to the driver in order, a partition at a time, so the driver holds entries and one partition of blobs.
    """
    from tessella.sinks.compression import gzipped

    packed = tiles.select("z", "x", "y", gzipped("data").alias("data"))
    entries, blobs = place(packed)
    rows = [(r.tile_id, r.offset, r.length, r.run_length) for r in entries.orderBy("tile_id").toLocalIterator()]
    root, leaves = directories(rows)
    meta = gzip.compress(json.dumps(metadata).encode(), mtime=0)
    total = sum({r[1]: r[2] for r in rows}.values())
    counts = (sum(r[3] for r in rows), len(rows), len({r[1] for r in rows}))
    centre = ((bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2, (zooms[0] + zooms[1]) // 2)
    part = f"{path}.part"
    with open_output(part) as f:
        f.write(header(len(root), len(meta), len(leaves), total, counts, zooms, bounds, centre) + root + meta + leaves)
        for r in blobs.select("offset", "data").orderBy("offset").toLocalIterator():
            f.write(r.data)
    store, place_ = filesystem(part)
    store.move(place_, filesystem(path)[1])
    return counts[0]


def tile_id(z: int, x: int, y: int) -> int:
    """Number of a tile along the curve, outside Spark."""
    d = ((1 << 2 * z) - 1) // 3
    s = 1 << z >> 1
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, s = x & (s - 1), y & (s - 1), s >> 1
    return d


def tile_of(number: int) -> tuple[int, int, int]:
    """(z, x, y) of a tile's number along the curve."""
    z = ((3 * number + 1).bit_length() - 1) // 2
    d, x, y = number - ((1 << 2 * z) - 1) // 3, 0, 0
    for k in range(z):
        s = 1 << k
        rx = d >> 1 & 1
        ry = (d ^ rx) & 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y, d = x + s * rx, y + s * ry, d >> 2
    return z, x, y


def read(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, data) of every tile of a file, unzipped: the driver reads the directories, tasks read ranges of contents."""
    reader = Reader(path)
    at = reader.data_at
    rows = [(i, o, n, r) for i, o, n, r in reader.entries()]
    entries = spark.createDataFrame(rows, "tile_id long, offset long, length long, run_length long")

    def run(batches):
        for batch in batches:
            out = []
            with open_input(path) as f:
                for first, offset, length, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    f.seek(at + offset)
                    data = gzip.decompress(f.read(length))
                    out += [(*tile_of(first + k), data) for k in range(count)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["z", "x", "y", "data"])

    return entries.mapInArrow(run, "z int, x int, y int, data binary")


class Reader:
    """Header, metadata and tiles of a file, by range."""

    def __init__(self, path: str):
        self.path = path
        raw = self._range(0, HEADER)
        if raw[:8] != b"PMTiles\x03":
            raise ValueError("not a PMTiles v3 file")
        f = struct.unpack("<11Q6B4iB2i", raw[8:])
        self.root, self.meta, self.leaf_at, self.data_at = (f[0], f[1]), (f[2], f[3]), f[4], f[6]
        self.counts, self.zooms, self.bounds = f[8:11], f[15:17], tuple(v / 1e7 for v in f[17:21])

    def _range(self, at: int, n: int) -> bytes:
        with open_input(self.path) as f:
            f.seek(at)
            return f.read(n)

    def metadata(self) -> dict:
        return json.loads(gzip.decompress(self._range(*self.meta)))

    def entries(self) -> Iterable[tuple[int, int, int, int]]:
        for e in read_directory(self._range(*self.root)):
            if e[3]:
                yield e
            else:
                yield from read_directory(self._range(self.leaf_at + e[1], e[2]))

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        want, where = tile_id(z, x, y), self.root
        for _ in range(3):
            best = None
            for e in read_directory(self._range(*where)):
                if e[0] <= want:
                    best = e
            if best is None:
                return None
            if best[3]:
                return gzip.decompress(self._range(self.data_at + best[1], best[2])) if want < best[0] + best[3] else None
            where = (self.leaf_at + best[1], best[2])
        return None
