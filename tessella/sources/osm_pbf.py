"""OpenStreetMap PBF extracts as a data source, and a writer.

`spark.read.format("osm_pbf").option("path", ...).option("kind", "node" | "way" | "relation").load()` reads one kind of
object; partitions are runs of file blocks. In a file sorted by type the blocks of a kind are found by binary search, so
each read opens only its own. Plain and dense nodes, granularity and offsets, raw and zlib blobs are read. A block's objects
are read, and those of tables written, as arrays: all their fields at once.
"""

from __future__ import annotations

import lzma
import struct
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.kernels.protobuf import (
    LEN,
    Messages,
    block,
    deltas,
    fields,
    messages,
    number,
    packed,
    packed_deltas,
    ranges,
    row_deltas,
    row_totals,
    signed,
    spans,
    unzigzags,
    uvarint,
    varint_bytes,
    varints,
    zigzag,
    zigzags,
)
from tessella.storage import open_input, open_output

SORTED, LOCATIONS = "Sort.Type_then_ID", "LocationsOnWays"
KINDS = ("node", "way", "relation")
SCHEMAS = {
    "node": "id long, lat_e7 int, lon_e7 int, tags map<string,string>",
    "way": "id long, refs array<long>, coords array<struct<lat_e7:int,lon_e7:int>>, tags map<string,string>",
    "relation": "id long, tags map<string,string>, members array<struct<seq:int,type:int,ref:long,role:string>>",
}
_TAGS = pa.map_(pa.string(), pa.string())
_COORD = pa.struct([("lat_e7", pa.int32()), ("lon_e7", pa.int32())])
_MEMBER = pa.struct([("seq", pa.int32()), ("type", pa.int32()), ("ref", pa.int64()), ("role", pa.string())])
ARROW = {
    "node": pa.schema([("id", pa.int64()), ("lat_e7", pa.int32()), ("lon_e7", pa.int32()), ("tags", _TAGS)]),
    "way": pa.schema([("id", pa.int64()), ("refs", pa.list_(pa.int64())), ("coords", pa.list_(_COORD)), ("tags", _TAGS)]),
    "relation": pa.schema([("id", pa.int64()), ("tags", _TAGS), ("members", pa.list_(_MEMBER))]),
}
#: Blocks and stored bytes that a partition has at least: small blocks would else make as many tasks as there are blocks.
RUN, STORED = 8, 1 << 20
#: Rows of a batch that is read, about.
ROWS = 10000


@dataclass
class Blob:
    kind: str
    at: int
    size: int
    start: int = 0  # of its header


@dataclass
class Header:
    bbox: tuple[float, float, float, float] | None
    features: list[str]


def block_head(f, at: int) -> tuple[str, int, int] | None:
    """(kind, stored size, where it starts) of the block whose header is at a place where f stands; None at the end."""
    head = f.read(4)
    if not head:
        return None
    if len(head) < 4:
        raise ValueError("file ends inside a block header")
    (n,) = struct.unpack(">i", head)
    kind, size = "", 0
    for k, _, v in fields(f.read(n)):
        if k == 1:
            kind = bytes(v).decode()
        elif k == 3:
            size = v
    return kind, size, at + 4 + n


def blobs(path: str) -> Iterator[Blob]:
    """The file's blocks, by their headers alone."""
    with open_input(path) as f:
        at = 0
        while found := block_head(f, at):
            kind, size, begin = found
            yield Blob(kind, begin, size, at)
            at = begin + size
            f.seek(at)


def read_blob(path: str, blob: Blob) -> bytes:
    with open_input(path) as f:
        f.seek(blob.at)
        return unpacked(f.read(blob.size), blob.size)


def unpacked(data: bytes, size: int) -> bytes:
    """A block's content from its stored form of a given size."""
    if len(data) != size:
        raise ValueError("file ends inside a block")
    for k, _, v in fields(data):
        if k == 1:
            return bytes(v)
        if k == 3:
            return zlib.decompress(v)
        if k == 4:
            return lzma.decompress(v)
        if k == 7:
            import zstandard

            return zstandard.ZstdDecompressor().stream_reader(bytes(v)).read()
        if k in (5, 6):
            raise ValueError("bzip2 and LZ4 blobs are not read")
    return b""


def read_header(path: str) -> Header:
    first = next(blobs(path), None)
    if first is None or first.kind != "OSMHeader":
        raise ValueError("not an OSM PBF file")
    bbox, features = None, []
    for k, _, v in fields(read_blob(path, first)):
        if k == 1:
            box = {n: (w >> 1 ^ -(w & 1)) / 1e9 for n, _, w in fields(v)}
            bbox = (box.get(1, 0), box.get(4, 0), box.get(2, 0), box.get(3, 0))  # min lon, min lat, max lon, max lat
        elif k in (4, 5):
            features.append(bytes(v).decode())
    return Header(bbox, features)


def has_feature(path: str, feature: str) -> bool:
    return feature in read_header(path).features


def kinds_in(data: bytes) -> set[str]:
    """Kinds of the objects in a block, by its groups' fields."""
    out = set()
    for k, _, v in fields(data):
        if k == 2:
            for g, _, _ in fields(v):
                out |= {"node"} if g in (1, 2) else {"way"} if g == 3 else {"relation"} if g == 4 else set()
                break
    return out


def blocks_of(path: str, kind: str) -> list[Blob]:
    """Blocks that may hold a kind: in a sorted file by binary search, else all."""
    data = [b for b in blobs(path) if b.kind == "OSMData"]
    if not has_feature(path, SORTED):
        return data
    rank = {k: i for i, k in enumerate(KINDS)}

    def first(at_least: int) -> int:
        lo, hi = 0, len(data)
        while lo < hi:
            mid = (lo + hi) // 2
            found = kinds_in(read_blob(path, data[mid]))
            if found and max(rank[k] for k in found) >= at_least:
                hi = mid
            else:
                lo = mid + 1
        return lo

    lo = first(rank[kind])
    hi = first(rank[kind] + 1) if kind != "relation" else len(data)
    return data[lo : min(hi + 1, len(data))]  # a block may hold the end of one kind and the start of the next


def _map(names: pa.Array, keys: np.ndarray, values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Tags of each row from places in a string table; a key's last value counts."""
    keys, values = keys.astype(np.int64), values.astype(np.int64)
    same = names.dictionary_encode()
    if len(same.dictionary) < len(names):  # a text that stands twice in the table is one key
        first = np.unique(same.indices.to_numpy(), return_index=True)[1]
        keys = first[same.indices.to_numpy()[keys]]
    code = np.repeat(np.arange(len(counts)), counts) * np.int64(len(names) + 1) + keys
    once, first = np.unique(code, return_index=True)
    if len(once) < len(code):
        last = len(code) - 1 - np.unique(code[::-1], return_index=True)[1]
        values[first] = values[last]
        kept = np.sort(first)
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[kept], minlength=len(counts))
        keys, values = keys[kept], values[kept]
    return pa.MapArray.from_arrays(_offsets(counts), names.take(pa.array(keys)), names.take(pa.array(values)))


def _offsets(counts: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Offsets of lists; null: which of them are null."""
    return pa.array(np.append(0, np.cumsum(counts)).astype(np.int32), mask=None if null is None else np.append(null, False))


def _int(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64, copy=False)).cast(pa.int32())


def _dense_tags(kv: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, values, how many of each node) of dense nodes' list, where a zero in a key's place ends a node."""
    stops = np.flatnonzero(kv == 0)
    size = np.diff(stops, prepend=-1) - 1
    if len(stops) == n and (not n or stops[-1] == len(kv) - 1) and not (size % 2).any():
        inside = kv[kv != 0]
        return inside[::2], inside[1::2], size // 2
    keys, values, counts, at, listed = [], [], [], 0, kv.tolist()  # an empty text as a value, or nodes without an end
    for _ in range(n):
        found = 0
        while at < len(listed) and listed[at]:
            keys.append(listed[at])
            values.append(listed[at + 1])
            at, found = at + 2, found + 1
        at += 1
        counts.append(found)
    return np.array(keys, np.int64), np.array(values, np.int64), np.array(counts, np.int64)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not np.array_equal(a, b):
        raise ValueError("lists of an object differ in length")
    return a


def decode(data: bytes, kind: str) -> Iterator[pa.RecordBatch]:
    """Objects of a kind in a block."""
    names = pa.array([], pa.string())
    groups, grain, lat0, lon0 = [], 100, 0, 0
    for k, _, v in fields(data):
        if k == 1:
            names = pa.array([bytes(s).decode("utf-8", "replace") for n, _, s in fields(v) if n == 1], pa.string())
        elif k == 2:
            groups.append(bytes(v))
        elif k == 17:
            grain = v
        elif k == 19:
            lat0 = signed(v)
        elif k == 20:
            lon0 = signed(v)

    def e7(raw, offset):
        """Stored units to 1e-7 degrees."""
        return (offset + grain * raw) // 100

    def made(*columns):
        return pa.RecordBatch.from_arrays(list(columns), schema=ARROW[kind])

    def tags(m):
        (keys, n), (values, also) = m.lists(2), m.lists(3)
        return _map(names, keys, values, _same(n, also))

    for g in groups:
        if kind == "node":
            for start, end in zip(*spans(g, 2), strict=True):
                parts = {n: w for n, _, w in fields(g[start:end])}
                ids, lats, lons = (deltas(parts.get(k, b"")) for k in (1, 8, 9))
                if not len(ids) == len(lats) == len(lons):
                    raise ValueError("lists of nodes differ in length")
                kv = varints(parts[10]) if 10 in parts else np.zeros(len(ids), np.uint64)
                yield made(pa.array(ids), _int(e7(lats, lat0)), _int(e7(lons, lon0)), _map(names, *_dense_tags(kv, len(ids))))
        at = spans(g, {"node": 1, "way": 3, "relation": 4}[kind])
        if not len(at[0]):
            continue
        m = Messages(g, *at)
        if kind == "node":
            ids, lats, lons = (unzigzags(m.numbers(k)) for k in (1, 8, 9))
            yield made(pa.array(ids), _int(e7(lats, lat0)), _int(e7(lons, lon0)), tags(m))
        elif kind == "way":
            refs, n = m.lists(8)
            located = m.has(9, LEN) & m.has(10, LEN)
            (lats, nlat), (lons, nlon) = ((row_totals(*m.lists(k)), m.lists(k)[1]) for k in (9, 10))
            lats, lons = lats[np.repeat(located, nlat)], lons[np.repeat(located, nlon)]
            n_coords = _same(np.where(located, nlat, 0), np.where(located, nlon, 0))
            coords = pa.StructArray.from_arrays([_int(e7(lats, lat0)), _int(e7(lons, lon0))], fields=list(_COORD))
            yield made(
                pa.array(m.numbers(1).astype(np.int64)), pa.ListArray.from_arrays(_offsets(n), pa.array(row_totals(refs, n))),
                pa.ListArray.from_arrays(_offsets(n_coords, ~located), coords), tags(m),
            )
        else:
            (roles, n), (refs, n_refs), (types, n_types) = (m.lists(k) for k in (8, 9, 10))
            n = _same(_same(n, n_refs), n_types)
            members = [_int(ranges(np.zeros(len(n), np.int64), n)), _int(types), pa.array(row_totals(refs, n)), names.take(pa.array(roles.astype(np.int64)))]
            yield made(pa.array(m.numbers(1).astype(np.int64)), tags(m), pa.ListArray.from_arrays(_offsets(n), pa.StructArray.from_arrays(members, fields=list(_MEMBER))))


class Run(InputPartition):
    """Blocks of a file from one place up to another."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


def runs(path: str, kind: str, blocks: int = RUN, stored: int = STORED) -> list[Run]:
    out, start, n, size = [], None, 0, 0
    for b in blocks_of(path, kind):
        start = b.start if start is None else start
        n, size, end = n + 1, size + b.size, b.at + b.size
        if n >= blocks and size >= stored:
            out.append(Run(path, start, end))
            start, n, size = None, 0, 0
    return out if start is None else [*out, Run(path, start, end)]


class PbfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.kind, self.run = options.get("kind", "node"), int(options.get("run", RUN))

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(16) as pool:  # a walk over a file's headers mostly waits
            return [r for found in pool.map(lambda p: runs(p, self.kind, self.run), self.paths) for r in found] or [Run(self.paths[0], 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, start, end = partition.value
        held, rows = [], 0
        with open_input(path) as f:
            f.seek(start)
            while start < end:
                kind, size, start = block_head(f, start)
                data = f.read(size)
                start += size
                for batch in decode(unpacked(data, size), self.kind) if kind == "OSMData" else ():
                    held.append(batch)
                    rows += batch.num_rows
                    if rows >= ROWS:
                        yield pa.concat_batches(held)
                        held, rows = [], 0
        if held:
            yield pa.concat_batches(held)


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        kind = self.options.get("kind", "node")
        if kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {KINDS}")
        return SCHEMAS[kind]

    def reader(self, schema) -> DataSourceReader:
        return PbfReader(dict(self.options))


def read(spark: SparkSession, path: str, kind: str):
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").option("path", path).option("kind", kind).load()


# writing


def _frame(kind: str, data: bytes, raw: bool) -> bytes:
    blob = block(1, data) if raw else number(2, len(data)) + block(3, zlib.compress(data))
    head = block(1, kind.encode()) + number(3, len(blob))
    return struct.pack(">i", len(head)) + head + blob


def _header(bbox, features, raw: bool) -> bytes:
    head = b""
    if bbox:
        w, s, e, n = (int(round(v * 1e9)) for v in bbox)
        head += block(1, number(1, zigzag(w)) + number(2, zigzag(e)) + number(3, zigzag(n)) + number(4, zigzag(s)))
    head += block(4, b"OsmSchema-V0.6") + block(4, b"DenseNodes") + b"".join(block(5, x.encode()) for x in features)
    return _frame("OSMHeader", head, raw)


class _Strings:
    def __init__(self):
        self.at: dict[str, int] = {"": 0}

    def __call__(self, s: str) -> int:
        return self.at.setdefault(s, len(self.at))

    def block(self) -> bytes:
        return block(1, b"".join(block(1, s.encode()) for s in self.at))


def write(path: str, nodes=(), ways=(), relations=(), bbox=None, features=(SORTED,), raw: bool = False, per_block: int = 8000, dense: bool = True) -> None:
    """nodes: (id, lat_e7, lon_e7, tags); ways: (id, refs, coords or None, tags); relations: (id, tags, [(type, ref, role)])."""
    with open_output(path) as f:
        f.write(_header(bbox, features, raw))

        def put(rows, make):
            rows = iter(rows)
            while some := list(islice(rows, per_block)):
                names = _Strings()
                group = make(some, names)
                f.write(_frame("OSMData", names.block() + block(2, group), raw))

        def node_group(rows, names):
            if not dense:
                return b"".join(
                    block(1, number(1, zigzag(i)) + packed(2, [names(k) for k in t]) + packed(3, [names(v) for v in t.values()]) + number(8, zigzag(la)) + number(9, zigzag(lo)))
                    for i, la, lo, t in rows
                )
            kv = []
            for *_, t in rows:
                for k, v in t.items():
                    kv += [names(k), names(v)]
                kv.append(0)
            return block(2, packed_deltas(1, [r[0] for r in rows]) + packed_deltas(8, [r[1] for r in rows]) + packed_deltas(9, [r[2] for r in rows]) + packed(10, kv))

        def way_group(rows, names):
            out = b""
            for i, refs, coords, t in rows:
                body = number(1, i) + packed(2, [names(k) for k in t]) + packed(3, [names(v) for v in t.values()]) + packed_deltas(8, refs)
                if coords:
                    body += packed_deltas(9, [c[0] for c in coords]) + packed_deltas(10, [c[1] for c in coords])
                out += block(3, body)
            return out

        def relation_group(rows, names):
            out = b""
            for i, t, m in rows:
                out += block(
                    4,
                    number(1, i) + packed(2, [names(k) for k in t]) + packed(3, [names(v) for v in t.values()])
                    + packed(8, [names(x[2]) for x in m]) + packed_deltas(9, [x[1] for x in m]) + packed(10, [x[0] for x in m]),
                )
            return out

        put(nodes, node_group)
        put(ways, way_group)
        put(relations, relation_group)


#: Objects of all kinds in one table: kind is 0, 1 or 2 as in KINDS.
OBJECT = (
    "kind int, id long, lat_e7 int, lon_e7 int, refs array<long>, tags map<string,string>, members array<struct<type:int,ref:long,role:string>>"
)


def _whole(column: pa.Array, what: str) -> np.ndarray:
    """A column's numbers; none may be missing."""
    if column.null_count:
        raise ValueError(f"an object without {what}")
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(how many values of each row, places of the values in the column's list)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    counts = np.diff(offsets)
    if column.null_count:
        counts = np.where(column.is_valid().to_numpy(zero_copy_only=False), counts, 0)
    return counts, pa.array(ranges(offsets[:-1], counts))


def _numbered(parts: list[tuple[pa.Array, np.ndarray]]) -> tuple[list[np.ndarray], bytes]:
    """(numbers of the texts of each part, string table): parts are (texts, how many of each row), numbered row by row as they come."""
    texts = pa.concat_arrays([pa.array([""], pa.string()), *(t.cast(pa.string()) for t, _ in parts)])
    if texts.null_count:
        raise ValueError("a tag or role without a text")
    total = sum(n for _, n in parts)
    at, base, order, places = np.cumsum(total) - total + 1, 1, np.zeros(len(texts), np.int64), []
    for t, n in parts:
        places.append(ranges(at, n))
        order[places[-1]] = base + np.arange(len(t))
        at, base = at + n, base + len(t)
    found = texts.take(pa.array(order)).dictionary_encode()
    numbers = found.indices.to_numpy().astype(np.uint64)
    return [numbers[p] for p in places], block(1, b"".join(block(1, s.encode()) for s in found.dictionary.to_pylist()))


def encode(rows: pa.RecordBatch, kind: int, dense: bool = True) -> bytes:
    """A block of OBJECT rows of one kind, as `write` makes it."""
    col = {n: rows.column(n) for n in rows.schema.names}
    ids = _whole(col["id"], "an id")
    n, at = _lists(col["tags"])
    keys, values = col["tags"].keys.take(at), col["tags"].items.take(at)
    if kind == 0:
        lats, lons = _whole(col["lat_e7"], "a place"), _whole(col["lon_e7"], "a place")
        if dense:
            one = np.ones(len(keys), np.int64)
            (k, v), names = _numbered([(keys, one), (values, one)])
            size = 2 * n + 1
            kv = np.zeros(int(size.sum()), np.uint64)
            kv[ranges(np.cumsum(size) - size, 2 * n)] = np.column_stack([k, v]).reshape(-1)
            whole = np.array([len(ids)])
            return names + block(2, block(2, b"".join(block(f, varint_bytes(x)) for f, x in ((1, row_deltas(ids, whole)), (8, row_deltas(lats, whole)), (9, row_deltas(lons, whole)), (10, kv)))))
        (k, v), names = _numbered([(keys, n), (values, n)])
        return names + block(2, messages(1, [(1, zigzags(ids), None), (2, k, n), (3, v, n), (8, zigzags(lats), None), (9, zigzags(lons), None)]))
    if kind == 1:
        if col["refs"].null_count:
            raise ValueError("a way without refs")
        (k, v), names = _numbered([(keys, n), (values, n)])
        n_refs, at = _lists(col["refs"])
        refs = _whole(col["refs"].values.take(at), "a ref")
        return names + block(2, messages(3, [(1, ids.view(np.uint64), None), (2, k, n), (3, v, n), (8, row_deltas(refs, n_refs), n_refs)]))
    if col["members"].null_count:
        raise ValueError("a relation without members")
    m, at = _lists(col["members"])
    types, refs, roles = (col["members"].values.field(k).take(at) for k in range(3))
    (k, v, r), names = _numbered([(keys, n), (values, n), (roles, m)])
    types, refs = _whole(types, "a member's type").view(np.uint64), _whole(refs, "a member's ref")
    return names + block(2, messages(4, [(1, ids.view(np.uint64), None), (2, k, n), (3, v, n), (8, r, m), (9, row_deltas(refs, m), m), (10, types, m)]))


def runs_of_kinds(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(kind, up to so many rows of it) of batches sorted by kind; only a kind's last rows may be fewer."""
    now, rest = None, None
    for batch in batches:
        kinds = _whole(batch.column("kind"), "a kind")
        cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if rest is not None and now != kinds[a]:
                yield now, rest
                rest = None
            now, rows = int(kinds[a]), batch.slice(a, b - a)
            rows = rows if rest is None else pa.concat_batches([rest, rows])
            whole = len(rows) // most * most
            for k in range(0, whole, most):
                yield now, rows.slice(k, most)
            rest = rows.slice(whole) if whole < len(rows) else None
    if rest is not None:
        yield now, rest


def write_parts(objects: DataFrame, folder: str, bbox=None, features=(SORTED,), raw: bool = False, per_block: int = 8000, dense: bool = True) -> list[str]:
    """A file for each partition of OBJECT rows, sorted by kind and id as readers like it; the paths of the files.

    Only files of tasks that succeeded are named, so a lost or repeated task leaves nothing but unused files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = runs_of_kinds(batches, per_block)
        first = next(blocks, None)
        if first is None:
            return
        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId()}-{task.taskAttemptId()}.osm.pbf"
        with open_output(path) as f:
            f.write(_header(bbox, features, raw))
            for kind, rows in chain([first], blocks):
                f.write(_frame("OSMData", encode(rows, kind, dense), raw))
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    names = [c.split()[0] for c in ("kind", "id", "lat_e7", "lon_e7", "refs", "tags", "members")]
    return sorted(r.path for r in objects.select(*names).sortWithinPartitions("kind", "id").mapInArrow(run, "path string").collect())


__all__ = ["PbfSource", "read", "read_header", "has_feature", "write", "blobs", "uvarint"]
