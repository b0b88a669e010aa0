"""GeoJSON as rows: whole FeatureCollections, or one feature (or collection) a line.

Rows: geom_type, geom (WKB), properties (map of JSON text), types. A collection in one document is parsed by one task, a
feature at a time; line-delimited files are split by Spark.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.kernels import wkb
from tessella.storage import open_input, open_output

SCHEMA = "feature_id string, geom_type int, geom binary, properties map<string,string>, types map<string,int>"
STRING, DOUBLE, BOOL = 0, 1, 2
LINE_SUFFIXES = (".jsonl", ".geojsonl", ".geojsons", ".ndjson", ".geojsonseq")


def _xy(p) -> tuple[float, float]:
    return float(p[0]), float(p[1])


def _ring(r) -> list:
    pts = [_xy(p) for p in r]
    return pts if pts and pts[0] == pts[-1] else [*pts, *pts[:1]]


def geometry(g: dict) -> list[tuple[int, object]]:
    """(kind, geometry) pairs; a multipoint gives one for each point, a line is a multiline of one."""
    kind, c = g["type"], g.get("coordinates")
    if kind == "Point":
        return [(wkb.POINT, _xy(c))]
    if kind == "MultiPoint":
        return [(wkb.POINT, _xy(p)) for p in c]
    if kind == "LineString":
        return [(wkb.MULTILINE, [[_xy(p) for p in c]])]
    if kind == "MultiLineString":
        return [(wkb.MULTILINE, [[_xy(p) for p in line] for line in c])]
    if kind == "Polygon":
        return [(wkb.MULTIPOLYGON, [[_ring(r) for r in c]])]
    if kind == "MultiPolygon":
        return [(wkb.MULTIPOLYGON, [[_ring(r) for r in p] for p in c])]
    raise ValueError(f"{kind} is not read")


def properties(p: dict | None) -> tuple[dict[str, str], dict[str, int]]:
    """Property texts and type codes: strings, numbers and booleans by kind, anything else as its JSON text; nulls go."""
    values, types = {}, {}
    for k, v in (p or {}).items():
        if v is None:
            continue
        if isinstance(v, bool):
            values[k], types[k] = ("true" if v else "false"), BOOL
        elif isinstance(v, (int, float)):
            values[k], types[k] = repr(float(v)), DOUBLE
        elif isinstance(v, str):
            values[k], types[k] = v, STRING
        else:
            values[k], types[k] = json.dumps(v, separators=(",", ":"), ensure_ascii=False), STRING
    return values, types


def features(doc: dict, columns: list[str] | None = None) -> Iterator[tuple]:
    kind = doc.get("type")
    if kind == "FeatureCollection":
        for f in doc["features"]:
            yield from features(f, columns)
        return
    if kind != "Feature":
        raise ValueError("a FeatureCollection or Feature is expected")
    if not doc.get("geometry"):
        return
    values, types = properties(doc.get("properties"))
    if columns is not None:
        values, types = {k: v for k, v in values.items() if k in columns}, {k: v for k, v in types.items() if k in columns}
    fid = None if doc.get("id") is None else str(doc["id"])
    for g, shape in geometry(doc["geometry"]):
        yield fid, g, wkb.dump(g, shape), values, types


def documents(text: str) -> Iterator[dict]:
    """JSON documents one after another, with white space or record separators between."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at] in " \t\r\n\x1e":
            at += 1
        if at >= len(text):
            return
        doc, at = decoder.raw_decode(text, at)
        yield doc


class Stream:
    """Features of the documents of a file, read piece by piece: only the feature at hand is held, however long its collection."""

    def __init__(self, f, columns: list[str] | None = None, piece: int = 1 << 20):
        self.f, self.columns, self.piece = f, columns, piece
        self.text, self.at, self.ended = "", 0, False
        self.utf8, self.json = codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder()

    def _more(self) -> None:
        data = self.f.read(max(self.piece, len(self.text) - self.at))
        self.ended = not data
        self.text, self.at = self.text[self.at :] + self.utf8.decode(data, self.ended), 0

    def _next(self) -> str:
        """The next character that is no white space or record separator, "" at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in " \t\r\n\x1e":
                    return self.text[self.at]
                self.at += 1
            if self.ended:
                return ""
            self._more()

    def _value(self):
        self._next()
        while True:
            try:
                v, end = self.json.raw_decode(self.text, self.at)
            except json.JSONDecodeError:
                if self.ended:
                    raise
            else:
                if end < len(self.text) or self.ended:  # a number may go on
                    self.at = end
                    return v
            self._more()

    def _expect(self, c: str) -> None:
        if self._next() != c:
            raise ValueError(f"{c} is expected in GeoJSON")
        self.at += 1

    def _items(self, close: str) -> Iterator[None]:
        """Stands at each item of an array or object, whose opening is read, and then behind its end."""
        if self._next() != close:
            yield
            while self._next() != close:
                self._expect(",")
                yield
        self._expect(close)

    def _document(self) -> Iterator[tuple]:
        if self._next() != "{" or self.text.startswith('{"type":"Feature",', self.at):
            yield from features(self._value(), self.columns)
            return
        self._expect("{")
        doc = {}
        for _ in self._items("}"):
            key = self._value()
            self._expect(":")
            if key == "features" and doc.get("type", "FeatureCollection") == "FeatureCollection" and self._next() == "[":
                self._expect("[")
                for _ in self._items("]"):
                    yield from self._document()
                doc[key] = []
            else:
                doc[key] = self._value()
        yield from features(doc, self.columns)

    def __iter__(self) -> Iterator[tuple]:
        while self._next():
            yield from self._document()


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    lines = path.lower().endswith(LINE_SUFFIXES)
    source = spark.read.text(path) if lines else spark.read.format("binaryFile").load(path).select("path")

    def found(batches) -> Iterator[tuple]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if lines:
                    yield from (r for d in documents(t) for r in features(d, columns))
                else:
                    with open_input(t) as f:
                        yield from Stream(f, columns)

    def run(batches):
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.int32()))
        rows = found(batches)
        while some := list(islice(rows, 4096)):
            made = [pa.array([list(v.items()) for v in c] if pa.types.is_map(k) else list(c), k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(made, names=["feature_id", "geom_type", "geom", "properties", "types"])

    return source.mapInArrow(run, SCHEMA)


def write(rows: DataFrame, path: str, digits: int = 5) -> None:
    """A FeatureCollection of rows (geom, properties) for debugging, streamed to the driver."""
    kinds = {wkb.POINT: "Point", wkb.LINE: "LineString", wkb.POLYGON: "Polygon", wkb.MULTILINE: "MultiLineString", wkb.MULTIPOLYGON: "MultiPolygon", wkb.MULTIPOINT: "MultiPoint"}

    def rounded(g):
        return [round(v, digits) for v in g] if g and not isinstance(g[0], (list, tuple)) else [rounded(x) for x in g]

    with open_output(path) as f:
        f.write(b'{"type":"FeatureCollection","features":[')
        for i, r in enumerate(rows.select("geom", "properties").toLocalIterator()):
            kind, shape = wkb.load(r.geom)
            doc = {"type": "Feature", "geometry": {"type": kinds[kind], "coordinates": rounded(shape)}, "properties": r.properties or {}}
            f.write((("," if i else "") + json.dumps(doc, ensure_ascii=False)).encode())
        f.write(b"]}")
