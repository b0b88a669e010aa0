"""From features to encoded tiles.

`pieces` walks each feature down the tile pyramid, clipping a tile's part from its parent's, so a large area is never
clipped whole for a small tile and its coordinates are not sent to tiles they miss. `render` then encodes one output layer
of one tile at a time, and `tiles` joins a tile's layers, which in the format is concatenation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.attributes import ATTRIBUTE, BOOL, FLOAT, INT, attr_hash
from tessella.kernels import lines as K
from tessella.kernels import batches as B
from tessella.kernels import mvt, overlay, wkb
from tessella.operators.features import limit_features
from tessella.sources.config import Config

POINT, LINE, MLINE, POLY = 0, 1, 2, 3
MARGIN = 1 / 200
#: Rows of a batch that is made, and points of lines that are walked down together.
ROWS, POINTS = 1 << 15, 1 << 14
#: Bytes of tiles that are sent on together.
BYTES = 1 << 22
FEATURE = (
    f"feature_id long, osm_id long, source_pos int, layer string, geom_type int, geom binary, attrs array<{ATTRIBUTE}>, fmin int, z_order int"
)
PIECE = f"z int, x int, y int, layer_id int, source_pos int, geom_type int, z_order int, feature_id long, osm_id long, attrs array<{ATTRIBUTE}>, geom binary"


def bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """min lon, min latp, max lon, max latp."""
    s = 360 / (1 << z)
    return x * s - 180, 180 - (y + 1) * s, (x + 1) * s - 180, 180 - y * s


def grown(box, margin: float = MARGIN):
    w, h = (box[2] - box[0]) * margin, (box[3] - box[1]) * margin
    return box[0] - w, box[1] - h, box[2] + w, box[3] + h


def clip(kind: int, shape, box):
    """A shape clipped to a box: a list of points, lines or polygons, empty if nothing is left."""
    if kind == POINT:
        return [p for p in shape if box[0] <= p[0] <= box[2] and box[1] <= p[1] <= box[3]]
    if kind in (LINE, MLINE):
        return [part for line in shape for part in K.clip_line(line, box)]
    return K.clip_polygons(shape, box)


def descend(kind: int, shape, lowest: int, highest: int, clip_box=None) -> Iterator[tuple[int, int, int, list]]:
    """(z, x, y, part) of every tile that a shape reaches at zooms lowest..highest."""
    stack = [(0, 0, 0, shape)]
    while stack:
        z, x, y, parent = stack.pop()
        box = bounds(z, x, y)
        if clip_box is not None and (box[0] >= clip_box[2] or box[2] <= clip_box[0] or box[1] >= clip_box[3] or box[3] <= clip_box[1]):
            continue
        part = clip(kind, parent, grown(box))
        if not part:
            continue
        if z >= lowest:
            yield z, x, y, part
        if z < highest:
            stack += [(z + 1, 2 * x + i, 2 * y + j, part) for i in (0, 1) for j in (0, 1)]


def parts_of(kind: int, data: bytes) -> list:
    code, geom = wkb.load(data)
    if kind == POINT:
        return [geom] if code == wkb.POINT else list(geom)
    if kind in (LINE, MLINE):
        return [geom] if code == wkb.LINE else geom
    return [geom] if code == wkb.POLYGON else geom


_CODES = {POINT: wkb.MULTIPOINT, LINE: wkb.MULTILINE, MLINE: wkb.MULTILINE, POLY: wkb.MULTIPOLYGON}


def pieces(features: DataFrame, config: Config) -> DataFrame:
    """A row per feature and tile, with the feature's part in the tile. Features of unknown layers are an error."""
    settings = {la.name: (i, la.minzoom, la.maxzoom) for i, la in enumerate(config.layers)}
    low, high = config.minzoom, config.maxzoom
    box = None
    if config.bounding_box:
        w, s, e, n = config.bounding_box
        box = (w, _latp(s), e, _latp(n))
    schema = T._parse_datatype_string(PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)

        def emit(rows):
            return pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], schema=kinds)

        def taken(batch, which, numbers, z, x, y, geom):
            """Rows of some features, each with its tile and part."""
            for at in range(0, len(which), ROWS):
                some = slice(at, at + ROWS)
                k = pa.array(which[some])
                made = {"z": np.full(len(k), z), "x": x[some], "y": y[some], "layer_id": numbers[which[some]]}
                cols = [pa.array(made[f.name], f.type) if f.name in made else geom[some] if f.name == "geom" else batch.column(f.name).take(k).cast(f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays(cols, schema=kinds)

        for batch in batches:
            names = batch.column("layer").dictionary_encode()
            for name in names.dictionary.to_pylist() + [None] * bool(names.null_count):
                if name not in settings:
                    raise ValueError(f"unknown layer {name}")
            known = np.array([settings[name] for name in names.dictionary.to_pylist()]).reshape(-1, 3)
            number, first, last = known[names.indices.to_numpy(zero_copy_only=False)].T
            lowest, highest = np.maximum(np.maximum(low, first), B.numbers(batch.column("fmin"))), np.minimum(high, last)
            kind, geom = B.numbers(batch.column("geom_type")), batch.column("geom")
            ok, px, py = B.single_points(geom)
            points = np.flatnonzero(ok & (kind == POINT))
            for z, k, x, y in B.point_tiles(px[points], py[points], lowest[points], highest[points], MARGIN, box):
                which = points[k]
                yield from taken(batch, which, number, z, x, y, B.point_wkb(px[which], py[which], multi=True))
            ok, size = B.plain_lines(geom)
            lines = np.flatnonzero(ok & np.isin(kind, (LINE, MLINE)))
            for some in B.few(size[lines], POINTS):
                which = lines[some]
                for z, k, x, y, parts in B.line_tiles(*B.line_points(geom, which, size), lowest[which], highest[which], MARGIN, box):
                    yield from taken(batch, which[k], number, z, x, y, parts)
            others = np.ones(len(batch), bool)
            others[points] = others[lines] = False
            rows: list[tuple] = []
            for i in np.flatnonzero(others).tolist():
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                shape = parts_of(r["geom_type"], r["geom"])
                for z, x, y, part in descend(r["geom_type"], shape, int(lowest[i]), int(highest[i]), box):
                    rows.append((z, x, y, int(number[i]), r["source_pos"], r["geom_type"], r["z_order"], r["feature_id"], r["osm_id"], r["attrs"], wkb.dump(_CODES[r["geom_type"]], part)))
                    if len(rows) >= 4096:
                        yield emit(rows)
                        rows = []
            if rows:
                yield emit(rows)

    cols = [c.split()[0] for c in ("feature_id osm_id source_pos layer geom_type geom attrs fmin z_order").split()]
    return features.select(*cols).mapInArrow(run, schema)


def _latp(lat: float) -> float:
    return math.degrees(math.log(math.tan(math.radians(max(-85.06, min(85.06, lat)) + 90) / 2)))


def _metres(m: float, latp: float) -> float:
    return math.degrees(m / K.EARTH_RADIUS / math.cos(math.radians(K.latp_to_lat(latp))))


def properties(attrs, z: int) -> dict:
    out = {}
    for a in attrs if attrs is not None else ():
        if (a["minzoom"] or 0) <= z:
            t = a["vtype"]
            out[a["key"]] = bool(a["d"]) if t == BOOL else int(a["d"]) if t == INT else mvt.Float32(a["d"]) if t == FLOAT else a["s"]
    return out


def scaled(polys, box, extent) -> list:
    sx, sy = (box[2] - box[0]) / extent, (box[3] - box[1]) / extent
    to = lambda p: (math.floor((p[0] - box[0]) / sx), math.floor((box[3] - p[1]) / sy))
    out = []
    for p in polys:
        rings = []
        for r in p:
            pts = [q for i, q in enumerate(map(to, r)) if not i or q != to(r[i - 1])]
            rings.append(pts if pts and pts[0] == pts[-1] else [*pts, *pts[:1]])
        if len(rings[0]) > 3:
            out.append([rings[0], *(r for r in rings[1:] if len(r) > 3)])
    return out


def whole(polys) -> list:
    """Valid polygons in whole pixels: spikes off, crossings resolved."""
    flat = [[r for r in (K.unspiked(r) for r in p) if len(r) > 3 and overlay.area_of_ring(r)] for p in polys]
    flat = [p for p in flat if p]
    if not flat:
        return []
    fixed = overlay.make_valid(flat)
    return [[[(round(x), round(y)) for x, y in r] for r in p] for p in fixed]


def encode_run(layer: mvt.LayerWriter, rows: list[dict], s: dict, box, z: int, fid: int | None) -> None:
    """Adds one feature: a row, or rows that are merged. s: the settings of their layer."""
    r, kind, extent, mid = rows[0], rows[0]["geom_type"], layer.extent, (box[1] + box[3]) / 2
    parts = [parts_of(kind, q["geom"]) for q in rows]
    level = 0.0
    if z < s["simplify_below"]:
        level = _metres(s["simplify_length"], mid) if s["simplify_length"] > 0 else s["simplify_level"]
        level *= s["simplify_ratio"] ** (s["simplify_below"] - 1 - z)
    if kind in (LINE, MLINE):
        ls = [line for part in parts for line in part]
        ls = K.stitch(ls) if len(rows) > 1 else ls
        how = "visvalingam" if s["simplify_algorithm"] == "visvalingam" else "douglas-peucker"
        px = [K.quantise(K.simplify_line(line, level, how) if level else line, box, extent) for line in ls]
        layer.add(mvt.LINE, [p for p in px if len(p) > 1], properties(r["attrs"], z), fid)
        return
    polys = overlay.union_all(parts) if len(rows) > 1 else parts[0]
    if z < s["filter_below"]:
        polys = K.drop_small(polys, _metres(s["filter_area"], mid) * 2.0 ** (s["filter_below"] - 1 - z))
    px = scaled(polys, box, extent)
    if level:
        px = K.simplify_polygons(px, level / ((box[2] - box[0]) / extent), s["simplify_algorithm"])
        px = [[[(round(a), round(b)) for a, b in ring] for ring in p] for p in px]
    px = whole(px)
    if level and z < s["combine_polygons_below"]:
        px = overlay.combine_overlapping(px)
        px = [[[(round(a), round(b)) for a, b in ring] for ring in p] for p in px]
    layer.add(mvt.POLYGON, px, properties(r["attrs"], z), fid)


class TileEncoder:
    """Output layers of tiles from batches in drawing order: a layer's features become bytes as their rows come.

    Repeated rows are left out. Of rows that are merged, points are kept as numbers; lines and areas as they are, until the
    last of them has come.
    """

    TILE = ("z", "x", "y", "group_pos")
    MERGE = ("layer_id", "source_pos", "geom_type", "z_order", "attr_hash")
    REST = ("feature_id", "osm_id")

    def __init__(self, names: list[str], settings: list[dict], top: int, include_ids: bool, version: int):
        self.names, self.settings, self.top, self.include_ids, self.version = names, settings, top, include_ids, version
        self.last = self.layer = self.tile = self.open = None

    def take(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(z, x, y, group_pos, data) of the layers that end within a batch."""
        cols = [*self.TILE, *self.MERGE, *self.REST]
        key = np.column_stack([B.numbers(batch.column(c)) for c in cols] + [batch.column("osm_id").is_valid().to_numpy(zero_copy_only=False)])
        before = np.vstack([key[:1] - 1 if self.last is None else self.last, key[:-1]])
        differs = key != before
        self.last = key[-1:]
        kept = np.flatnonzero(differs.any(1))
        merge_from = len(self.TILE) + len(self.MERGE)
        starts = np.flatnonzero(differs[kept, :merge_from].any(1))
        simple, lon, lat = B.single_points(batch.column("geom"), multi=True)
        bounds_ = np.unique(np.concatenate([[0], starts, [len(kept)]]))
        begins = set(starts.tolist())
        for a, b in zip(bounds_, bounds_[1:], strict=False):
            rows = kept[a:b]
            k = key[rows[0]].tolist()
            if int(a) in begins:
                self._close()
                if self.tile != tuple(k[:4]):
                    yield from self.finish()
                    self._begin(tuple(k[:4]))
                self._open(k, batch, int(rows[0]))
            self._add(batch, rows, key, simple, lon, lat)

    def finish(self) -> Iterator[tuple]:
        self._close()
        if self.layer is not None:
            yield *self.tile, self.layer.finish()
        self.layer = None

    def _begin(self, tile):
        self.tile, self.box = tile, bounds(*tile[:3])
        self.layer = mvt.LayerWriter(self.names[tile[3]], 8192 if tile[0] == self.top else 4096, self.version)

    def _open(self, k, batch, i):
        z, kind, s = self.tile[0], k[6], self.settings[k[4]]
        merge = s["combine_points"] if kind == POINT else z < s["combine_lines_below"] if kind == LINE else z < s["combine_polygons_below"] if kind == POLY else False
        fid = k[10] if self.include_ids and k[11] else None
        self.open = {"s": s, "kind": kind, "merge": merge, "fid": fid, "attrs": batch.column("attrs")[i].as_py(), "xy": [], "rows": []}

    def _pixels(self, lon, lat):
        """Pixels of points, and which are near enough to the tile to be drawn."""
        extent = self.layer.extent
        sx, sy = (self.box[2] - self.box[0]) / extent, (self.box[3] - self.box[1]) / extent
        x, y = np.floor((lon - self.box[0]) / sx).astype(np.int64), np.floor((self.box[3] - lat) / sy).astype(np.int64)
        return x, y, (x >= -256) & (x <= extent + 256) & (y >= -256) & (y <= extent + 256)

    def _add(self, batch, rows, key, simple, lon, lat):
        o, z = self.open, self.tile[0]
        ids = lambda i: int(key[i, 10]) if self.include_ids and key[i, 11] else None
        if o["kind"] != POINT:
            for i in rows.tolist():
                r = {"geom_type": o["kind"], "geom": batch.column("geom")[i].as_py(), "attrs": o["attrs"]}
                if o["merge"]:
                    o["rows"].append(r)
                else:
                    encode_run(self.layer, [r], o["s"], self.box, z, ids(i))
            return
        if simple[rows].all():
            x, y, near = self._pixels(lon[rows], lat[rows])
            if o["merge"]:
                o["xy"].append((x[near].astype(np.int32), y[near].astype(np.int32)))
            else:
                some = rows[near]
                self.layer.add_points(x[near], y[near], properties(o["attrs"], z), key[some, 10], key[some, 11].astype(bool) & self.include_ids)
            return
        for i in rows.tolist():
            p = np.array(parts_of(POINT, batch.column("geom")[i].as_py()), float).reshape(-1, 2)
            x, y, near = self._pixels(p[:, 0], p[:, 1])
            if o["merge"]:
                o["xy"].append((x[near].astype(np.int32), y[near].astype(np.int32)))
            else:
                self.layer.add_multipoint(x[near], y[near], properties(o["attrs"], z), ids(i))

    def _close(self):
        o, self.open = self.open, None
        if o is None or not o["merge"]:
            return
        if o["xy"]:
            x, y = (np.concatenate([p[k] for p in o["xy"]]) for k in (0, 1))
            self.layer.add_multipoint(x, y, properties(o["attrs"], self.tile[0]), o["fid"])
        elif o["rows"]:
            encode_run(self.layer, o["rows"], o["s"], self.box, self.tile[0], o["fid"])


def render(rows: DataFrame, config: Config) -> DataFrame:
    """(z, x, y, group_pos, data): each output layer of each tile, encoded."""
    settings = [asdict(la) for la in config.layers]
    groups = config.groups()
    of = {n: (g, k) for g, names in enumerate(groups) for k, n in enumerate(names)}
    place = [of[la.name] for la in config.layers]
    names, ids, version, top = [g[0] for g in groups], config.include_ids, config.mvt_version, config.maxzoom if config.high_resolution else -1
    pick = lambda values, kind="int": F.element_at(F.array(*[F.lit(v) for v in values]), F.col("layer_id") + 1).cast(kind)
    rows = rows.withColumns({
        "group_pos": pick([p[0] for p in place]), "sub_pos": pick([p[1] for p in place]), "attr_hash": attr_hash(F.col("attrs")),
        "up": pick([la.z_order_ascending for la in config.layers], "boolean"),
    })
    order = [F.when(F.col("up"), F.col("z_order")).otherwise(-F.col("z_order")), F.col("geom_type"), F.col("attr_hash"), F.col("feature_id"), F.col("osm_id")]
    if any(la.feature_limit for la in config.layers):  # a row's repeats have its rank
        limits, below = pick([la.feature_limit for la in config.layers]), pick([la.feature_limit_below for la in config.layers])
        rows = limit_features(rows, ["z", "x", "y", "layer_id", "source_pos"], order, limits, below, max(la.feature_limit for la in config.layers), F.dense_rank())

    tile = ["z", "x", "y", "group_pos"]
    drawn = [*tile, "sub_pos", "source_pos", order[0], "geom_type", "attr_hash", "feature_id", F.col("osm_id").asc_nulls_last()]
    dealt = rows.repartition(*tile).sortWithinPartitions(*drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, encoder = [], 0, TileEncoder(names, settings, top, ids, version)

        def emit():
            cols = list(zip(*found, strict=True))
            kinds = [pa.int32()] * 4 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*tile, "data"])

        def all_tiles():
            for batch in batches:
                if batch.num_rows:
                    yield from encoder.take(batch)
            yield from encoder.finish()

        for t in all_tiles():
            found.append(t)
            held += len(t[4])
            if held > BYTES or len(found) >= 4096:
                yield emit()
                found, held = [], 0
        if found:
            yield emit()

    cols = [*tile, *TileEncoder.MERGE, *TileEncoder.REST, "attrs", "geom"]
    return dealt.select(*cols).mapInArrow(run, "z int, x int, y int, group_pos int, data binary")


def tiles(layers: DataFrame, empty: bool = False) -> DataFrame:
    """(z, x, y, data): a tile's layers in order, one after another; tiles without any feature are left out."""
    listed = layers.groupBy("z", "x", "y").agg(F.sort_array(F.collect_list(F.struct("group_pos", "data"))).alias("s"))
    data = F.aggregate("s", F.lit(b""), lambda a, e: F.concat(a, e["data"]))
    out = listed.select("z", "x", "y", data.alias("data"))
    return out if empty else out.where(F.length("data") > 0)


def merge_encoded(old: bytes | None, new: bytes | None) -> bytes:
    """A tile with the features of both: layer by layer, old features first; layers of either side stay."""
    own = {la.name: la for la in mvt.layers(new or b"")}
    out = []
    for la in mvt.layers(old or b""):
        more = own.pop(la.name, None)
        if more is not None and more.extent == la.extent:
            out.append(mvt.merged(la, more))
            continue
        out += [mvt.written(x) for x in (more, la) if x is not None]
    return b"".join(out + [mvt.written(la) for la in own.values()])


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Existing and new tiles as one set; tiles of one side pass as they are."""
    from tessella.sinks.compression import decompress

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a tile at a time: tiles may be large
            for i in range(batch.num_rows):
                z, x, y, a, b = (c.slice(i, 1) for c in batch.columns)
                data = merge_encoded(decompress(a[0].as_buffer()), decompress(b[0].as_buffer()))
                yield pa.RecordBatch.from_arrays([z, x, y, pa.array([data], pa.binary())], names=["z", "x", "y", "data"])

    key = ["z", "x", "y"]
    joined = old.select(*key, F.col("data").alias("old")).join(new.select(*key, F.col("data").alias("new")), key, "full_outer")
    shared = F.col("old").isNotNull() & F.col("new").isNotNull()
    one = joined.where(~shared).select(*key, F.coalesce("old", "new").alias("data"))
    return one.unionByName(joined.where(shared).select(*key, "old", "new").mapInArrow(both, "z int, x int, y int, data binary"))
