"""Configuration: JSON settings and layers, defaults, boxes and command-line options."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessella.sinks.compression import MODES
from tessella.storage import open_input, size

ALGORITHMS = ("douglas-peucker", "visvalingam", "buildings")


@dataclass
class Layer:
    name: str
    minzoom: int
    maxzoom: int
    write_to: str = ""
    simplify_below: int = 0
    simplify_level: float = 0.01
    simplify_length: float = 0.0
    simplify_ratio: float = 2.0
    simplify_algorithm: str = "douglas-peucker"
    filter_below: int = 0
    filter_area: float = 0.5
    feature_limit: int = 0
    feature_limit_below: int = 0
    combine_points: bool = True
    combine_lines_below: int = 0
    combine_polygons_below: int = 0
    z_order_ascending: bool = True
    source: str = ""
    source_columns: list[str] | None = None
    all_source_columns: bool = False
    index: bool = False
    index_column: str = ""


@dataclass
class Config:
    basezoom: int
    minzoom: int
    maxzoom: int
    include_ids: bool
    name: str
    version: str
    description: str
    compress: str
    high_resolution: bool = False
    combine_below: int = 0
    mvt_version: int = 2
    bounding_box: tuple[float, float, float, float] | None = None
    default_view: tuple[float, ...] | None = None
    metadata: dict = field(default_factory=dict)
    filemetadata: dict = field(default_factory=dict)
    layers: list[Layer] = field(default_factory=list)

    @property
    def index_zoom(self) -> int:
        return min(self.basezoom, 14)

    def groups(self) -> list[list[str]]:
        """Output layers in order, each with the layers that write to it."""
        out = {la.name: [la.name] for la in self.layers if not la.write_to}
        for la in self.layers:
            if la.write_to:
                out[la.write_to].append(la.name)
        return list(out.values())


def parse_box(text: str) -> tuple[float, float, float, float]:
    """min lon, min lat, max lon, max lat, comma-separated."""
    parts = [float(v) for v in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a box has four numbers")
    if parts[0] >= parts[2] or parts[1] >= parts[3]:
        raise ValueError("a box's minimum must be below its maximum")
    return tuple(parts)


def layer_of(name: str, d: dict, combine_below: int = 0) -> Layer:
    la = Layer(name, int(d["minzoom"]), int(d["maxzoom"]), combine_lines_below=combine_below)
    for k in ("write_to", "simplify_below", "simplify_level", "simplify_length", "simplify_ratio", "simplify_algorithm", "filter_below", "filter_area",
              "feature_limit", "feature_limit_below", "combine_points", "combine_lines_below", "combine_polygons_below", "source", "index", "index_column"):
        if k in d:
            setattr(la, k, d[k])
    if la.simplify_algorithm not in ALGORITHMS:
        raise ValueError(f"layer {name}: simplify_algorithm must be one of {ALGORITHMS}")
    la.feature_limit_below = d.get("feature_limit_below", la.maxzoom + 1)
    la.z_order_ascending = d.get("z_order_ascending", not la.feature_limit)
    columns = d.get("source_columns")
    la.all_source_columns, la.source_columns = columns is True, columns if isinstance(columns, list) else None
    return la


def parse(doc: dict, bbox=None) -> Config:
    s = doc["settings"]
    if s["maxzoom"] > s["basezoom"]:
        raise ValueError("maxzoom must not exceed basezoom")
    if s["compress"] not in MODES:
        raise ValueError(f"compress must be one of {MODES}")
    box = tuple(s["bounding_box"]) if "bounding_box" in s else bbox
    c = Config(
        s["basezoom"], s["minzoom"], s["maxzoom"], bool(s["include_ids"]), s["name"], str(s["version"]), s["description"], s["compress"],
        bool(s.get("high_resolution", False)), s.get("combine_below", 0), s.get("mvt_version", 2), box, tuple(s["default_view"]) if "default_view" in s else None,
        s.get("metadata", {}), s.get("filemetadata", {}),
    )
    for name, d in doc["layers"].items():
        la = layer_of(name, d, c.combine_below)
        if la.write_to and la.write_to not in {x.name for x in c.layers}:
            raise ValueError(f"layer {name} writes to {la.write_to}, which is not declared before it")
        if la.source and box is None:
            raise ValueError("an external source needs a bounding box")
        c.layers.append(la)
    return c


def load(path: str, bbox=None) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(json.load(f), bbox)


def layers_frame(spark: SparkSession, config: Config) -> DataFrame:
    """One row per layer, with its number, output layer and places in it."""
    rows = []
    order = {n: (g, k) for g, names in enumerate(config.groups()) for k, n in enumerate(names)}
    for i, la in enumerate(config.layers):
        d = asdict(la)
        d.pop("source_columns")
        rows.append({**d, "layer_id": i, "out_layer": la.write_to or la.name, "group_pos": order[la.name][0], "sub_pos": order[la.name][1]})
    schema = (
        "name string, minzoom int, maxzoom int, write_to string, simplify_below int, simplify_level double, simplify_length double, simplify_ratio double, "
        "simplify_algorithm string, filter_below int, filter_area double, feature_limit int, feature_limit_below int, combine_points boolean, "
        "combine_lines_below int, combine_polygons_below int, z_order_ascending boolean, source string, all_source_columns boolean, index boolean, "
        "index_column string, layer_id int, out_layer string, group_pos int, sub_pos int"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    floats = ("simplify_level", "simplify_length", "simplify_ratio", "filter_area")
    return spark.createDataFrame([tuple(float(r[n]) if n in floats else r[n] for n in names) for r in rows], schema)


def options(argv: list[str]) -> argparse.Namespace:
    """Command-line options. The flags that only tune stores and threads are taken and ignored: Spark's configuration does that."""
    p = argparse.ArgumentParser(prog="tessella")
    p.add_argument("positional", nargs="*", help="input files and, unless --output is given, the output last")
    p.add_argument("--input", action="append", default=[])
    p.add_argument("--output")
    p.add_argument("--bbox", type=parse_box)
    p.add_argument("--merge", action="store_true")
    p.add_argument("--config", default="config.json")
    p.add_argument("--process", default="simple")
    for flag in ("quiet", "verbose", "skip-integrity", "log-tile-timings", "fast", "compact", "no-compress-nodes", "no-compress-ways", "materialize-geometries", "shard-stores"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--store")
    p.add_argument("--threads", type=int, default=0)
    o = p.parse_args(argv)
    rest = list(o.positional)
    if not o.output:
        if not rest:
            p.error("an output is needed")
        o.output = rest.pop()
    o.input += rest
    o.mode = output_mode(o.output)
    if o.merge and o.mode != "mbtiles":
        p.error("--merge writes to MBTiles only")
    return o


def output_mode(path: str) -> str:
    return "mbtiles" if path.endswith((".mbtiles", ".sqlite")) else "pmtiles" if path.endswith(".pmtiles") else "directory"


def newline_chunks(path: str, n: int) -> list[tuple[int, int]]:
    """About n (offset, length) ranges of a file that end at newlines."""
    total, out, at = size(path), [], 0
    step = max(1, total // max(1, n))
    with open_input(path) as f:
        while at < total:
            end = min(at + step, total)
            f.seek(end - 1)
            while end < total and (more := f.read(1 << 16)):  # on to the next newline
                found = more.find(b"\n")
                if found >= 0:
                    end += found
                    break
                end += len(more)
            end = min(end, total)
            out.append((at, end - at))
            at = end
    return out


def chunk(path: str, at: int, n: int) -> bytes:
    with open_input(path) as f:
        f.seek(at)
        return f.read(n)
