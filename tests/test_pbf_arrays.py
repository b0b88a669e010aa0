"""Map extracts read and written as arrays: the same files as row by row, the same objects, in few tasks and little time."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tessella.kernels.protobuf import Messages, block, number, packed, packed_deltas, spans, uvarint, zigzag
from tessella.sources import osm_pbf

TEXTS = ["", "a", "name", "über 一", "long " * 30, "0"]
OBJECT = pa.schema([
    ("kind", pa.int32()), ("id", pa.int64()), ("lat_e7", pa.int32()), ("lon_e7", pa.int32()), ("refs", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string())),
    ("members", pa.list_(pa.struct([("type", pa.int32()), ("ref", pa.int64()), ("role", pa.string())]))),
])


def objects(n):
    r = random.Random(5)
    tags = lambda: {f"k{r.randrange(9)}": r.choice(TEXTS) for _ in range(r.randrange(4))}
    ids = lambda k: [r.randrange(-(1 << 60), 1 << 60) if r.random() < 0.1 else r.randrange(1 << 34) for _ in range(k)]
    nodes = [(i, r.randrange(-850000000, 850000000), r.randrange(-1800000000, 1800000000), tags()) for i in ids(n)]
    ways = [(i, ids(r.choice([0, 1, 5, 300])), tags()) for i in ids(n)]
    rels = [(i, tags(), [(r.randrange(3), k, r.choice(TEXTS)) for k in ids(r.choice([0, 1, 7]))]) for i in ids(n)]
    return nodes, ways, rels


def as_rows(nodes, ways, rels):
    none = dict.fromkeys(OBJECT.names)
    return [
        *({**none, "kind": 0, "id": i, "lat_e7": a, "lon_e7": o, "tags": list(t.items())} for i, a, o, t in nodes),
        *({**none, "kind": 1, "id": i, "refs": refs, "tags": list(t.items())} for i, refs, t in ways),
        *({**none, "kind": 2, "id": i, "tags": list(t.items()), "members": [{"type": k, "ref": x, "role": s} for k, x, s in m]} for i, t, m in rels),
    ]


def read(path, kind):
    parts = osm_pbf.PbfReader({"path": path, "kind": kind}).partitions()
    return [r for p in parts for b in osm_pbf.PbfReader({"path": path, "kind": kind}).read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("options", [{}, {"dense": False, "raw": True}])
@pytest.mark.parametrize("per_block", [1, 7, 500])
def test_same_file_as_row_by_row(tmp_path, options, per_block):
    nodes, ways, rels = objects(60)
    path = str(tmp_path / "rows.pbf")
    osm_pbf.write(path, nodes, [(i, refs, None, t) for i, refs, t in ways], rels, per_block=per_block, **options)
    rows = pa.RecordBatch.from_pylist(as_rows(nodes, ways, rels), OBJECT)
    cut = [rows.slice(a, 13) for a in range(0, len(rows), 13)]
    made = [(k, osm_pbf.encode(some, k, options.get("dense", True))) for k, some in osm_pbf.runs_of_kinds(iter(cut), per_block)]
    want = [osm_pbf.read_blob(path, b) for b in osm_pbf.blobs(path) if b.kind == "OSMData"]
    assert [m for _, m in made] == want
    got = [(r["id"], r["lat_e7"], r["lon_e7"], dict(r["tags"])) for r in read(path, "node")]
    assert got == nodes
    assert [(r["id"], r["refs"], r["coords"], dict(r["tags"])) for r in read(path, "way")] == [(i, refs, None, t) for i, refs, t in ways]
    assert [(r["id"], dict(r["tags"]), [(m["type"], m["ref"], m["role"]) for m in r["members"]], [m["seq"] for m in r["members"]]) for r in read(path, "relation")] == [
        (i, t, m, list(range(len(m)))) for i, t, m in rels
    ]


def test_missing_values_are_refused():
    nodes, ways, rels = as_rows([(1, 2, 3, {})], [(1, [4], {})], [(1, {}, [(0, 1, "r")])])
    for row, gap in ((nodes, {"lat_e7": None}), (nodes, {"tags": [("k", None)]}), (ways, {"refs": None}), (ways, {"refs": [None]}), (rels, {"members": [{"type": 0, "ref": 1, "role": None}]})):
        with pytest.raises(ValueError):
            osm_pbf.encode(pa.RecordBatch.from_pylist([{**row, **gap}], OBJECT), row["kind"])
    nothing = pa.RecordBatch.from_pylist([{**nodes, "tags": None}], OBJECT)
    assert [b.to_pylist()[0]["tags"] for b in osm_pbf.decode(osm_pbf.encode(nothing, 0), "node")] == [[]]


def test_odd_blocks():
    """Coordinates in ways, granularity, unknown fields, texts that stand twice, keys that repeat, broken messages."""
    names = block(1, b"".join(block(1, s) for s in (b"", b"k", b"k", b"v", b"w")))
    way = number(1, 9) + packed(2, [1, 2]) + packed(3, [3, 4]) + block(4, b"\xff\xff") + packed_deltas(8, [5, 6]) + packed_deltas(9, [10, 20]) + packed_deltas(10, [30, -40]) + uvarint(99 << 3 | 5) + b"\xff" * 4
    bare = number(1, 1 << 63)
    data = names + block(2, block(3, way) + block(3, bare)) + number(17, 1000) + number(19, 7)
    (b,) = osm_pbf.decode(data, "way")
    assert b.to_pylist() == [
        {"id": 9, "refs": [5, 6], "coords": [{"lat_e7": 100, "lon_e7": 300}, {"lat_e7": 200, "lon_e7": -400}], "tags": [("k", "w")]},
        {"id": -(1 << 63), "refs": [], "coords": None, "tags": []},
    ]
    dense = packed_deltas(1, [1, 2, 3]) + packed_deltas(8, [0, 0, 0]) + packed_deltas(9, [0, 0, 0]) + packed(10, [1, 0, 0, 1, 3, 2, 4, 0])
    (b,) = osm_pbf.decode(names + block(2, block(2, dense)), "node")
    assert [r["tags"] for r in b.to_pylist()] == [[("k", "")], [("k", "w")], []]
    for broken in (b"", number(1, 1) + packed(2, [1]), number(1, 1) + b"\x42\x05\x01", number(1, 1) + b"\x42\x01\x80", b"\x08" + b"\xff" * 11, b"\x0b"):
        with pytest.raises(ValueError):
            list(osm_pbf.decode(names + block(2, block(3, broken)), "way"))
    b = block(5, b"abc") + number(3, 300) + block(40, b"de") + b"\x0d1234"
    assert [v.tolist() for v in spans(b, 40)] == [[len(b) - 7], [len(b) - 5]]
    m = Messages(b, np.array([0]), np.array([len(b)]))
    assert m.numbers(3).tolist() == [300] and not m.has(9, 0).any()
    assert zigzag(-1) == 1


def test_tasks_grow_with_bytes_not_blocks(tmp_path):
    """Many small blocks are read by few tasks, every object once."""
    path = str(tmp_path / "many.pbf")
    osm_pbf.write(path, [(i, i, -i, {"k": str(i % 5)}) for i in range(20000)], [(i, [1, 2], None, {}) for i in range(20000)], per_block=50)
    assert len(osm_pbf.PbfReader({"path": path, "kind": "node"}).partitions()) <= 2
    assert [r["id"] for r in read(path, "node")] == list(range(20000)) and [r["id"] for r in read(path, "way")] == list(range(20000))


def test_time_for_many_objects(tmp_path):
    """Plain nodes and ways by the hundred thousand, written from a table and read."""
    n = 200000
    rows = pa.RecordBatch.from_pylist(as_rows([(i, i, -i, {"k": str(i % 5), "w": "x"}) for i in range(500)], [(i, [1, i, 7, 9], {"k": "v"}) for i in range(500)], []), OBJECT)
    began = time.time()
    for kind, name in ((0, "node"), (1, "way")):
        some = rows.slice(500 * kind, 500)
        for _ in range(n // 500):
            (b,) = osm_pbf.decode(osm_pbf.encode(some, kind, dense=False), name)
        assert b.num_rows == 500
    assert time.time() - began < 6
