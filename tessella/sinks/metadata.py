"""Metadata of a tile set, as each container wants it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from tessella.functions.attributes import FIELD_NAMES
from tessella.sources.config import Config


def vector_layers(config: Config, fields: DataFrame | None) -> list[dict]:
    """Layers with their fields; a sublayer's fields count to the layer it writes to. The rows are one per layer and key."""
    own: dict[str, dict[str, str]] = {}
    out_of = {la.name: la.write_to or la.name for la in config.layers}
    for r in [] if fields is None else fields.collect():
        own.setdefault(out_of.get(r["layer"], r["layer"]), {})[r["key"]] = FIELD_NAMES[r["vtype"]]
    return [
        {"id": la.name, "description": "", "minzoom": la.minzoom, "maxzoom": la.maxzoom, "fields": dict(sorted(own.get(la.name, {}).items()))}
        for la in config.layers if not la.write_to
    ]


def centre(config: Config, bounds) -> tuple[float, float, int]:
    if config.default_view:
        v = config.default_view
        return v[0], v[1], int(v[2]) if len(v) > 2 else (config.minzoom + config.maxzoom) // 2
    return (bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2, (config.minzoom + config.maxzoom) // 2


def for_mbtiles(config: Config, bounds, layers: list[dict]) -> dict[str, str]:
    out = {
        "name": config.name, "type": "baselayer", "version": config.version, "description": config.description, "format": "pbf",
        "minzoom": str(config.minzoom), "maxzoom": str(config.maxzoom), "bounds": ",".join(f"{v:f}" for v in bounds),
        "center": ",".join(f"{v:f}" if i < 2 else str(v) for i, v in enumerate(centre(config, bounds))), "json": json.dumps({"vector_layers": layers}),
    }
    return out | {k: v if isinstance(v, str) else json.dumps(v) for k, v in config.metadata.items()}


def for_pmtiles(config: Config, layers: list[dict]) -> dict:
    out = {"name": config.name, "description": config.description, "version": config.version, "vector_layers": layers}
    return out | config.metadata


def for_directory(config: Config, bounds, layers: list[dict]) -> dict:
    return config.filemetadata | {
        "name": config.name, "version": config.version, "description": config.description, "bounds": list(bounds), "minzoom": config.minzoom,
        "maxzoom": config.maxzoom, "vector_layers": layers, "format": "pbf",
    }
