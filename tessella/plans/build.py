"""The whole run: objects to features by a profile, external layers, tiles, container."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from tessella.functions import attributes as A
from tessella.functions import projection as P
from tessella.functions.tags import is_multipolygon, significant
from tessella.kernels import lines as K
from tessella.kernels import overlay, wkb
from tessella.operators import relations as R
from tessella.operators import render
from tessella.plans import rules
from tessella.plans.rules import Profile
from tessella.sinks import compression, directory, mbtiles, metadata, pmtiles
from tessella.sources import config as C
from tessella.sources import geojson, osm_pbf, shapefile

#: Bits that keep ids of nodes, ways and relations apart in feature ids; external shapes have 3 and their place in the input.
_OSM_KIND = {"node": 0, "way": 1, "relation": 2}


def _geometries(objects: DataFrame) -> DataFrame:
    """Features' geometry by what their rule asked for: point, line, area or centroid, from lon/lat to lon/latp WKB.

    objects: coordinates as `lines` (array of lines of struct lon, lat) for ways, `polys` for relations, lon/lat for nodes.
    Rows whose geometry is invalid (a line of one point, an area of fewer than four) are dropped.
    """
    keep = ["feature_id", "osm_id", "source_pos", "layer", "attrs", "fmin", "z_order"]
    schema = T._parse_datatype_string(render.FEATURE)

    def shape(kind: str, r: dict) -> tuple[int, bytes] | None:
        project = lambda p: (p[0], render._latp(p[1]))
        if r["lon"] is not None:
            return render.POINT, wkb.dump(wkb.POINT, project((r["lon"], r["lat"])))
        lines = [[project((p["lon"], p["lat"])) for p in line] for line in r["lines"] or []]
        inners = [[project((p["lon"], p["lat"])) for p in line] for line in r["inners"] or []]
        lines = [x for x in lines if len(x) > 1]
        if not lines:
            return None
        if kind == "line":
            made = lines if not r["is_relation"] else K.multiline(lines + [x for x in inners if len(x) > 1])
            return (render.MLINE, wkb.dump(wkb.MULTILINE, made)) if r["is_relation"] else (render.LINE, wkb.dump(wkb.LINE, made[0]))
        if r["is_relation"]:
            polys = K.multipolygon(lines, inners)
        else:
            ring = lines[0] if lines[0][0] == lines[0][-1] else [*lines[0], lines[0][0]]
            polys = [[ring]] if len(ring) > 3 else []
        if kind == "centroid":
            at = K.label_point(polys) if polys and any(overlay.area_of_ring(p[0]) for p in polys) else K.line_centre(lines[0])
            return render.POINT, wkb.dump(wkb.POINT, at)
        polys = overlay.make_valid([[q for q in map(K.unspiked, p) if len(q) > 3] for p in polys])
        return (render.POLY, wkb.dump(wkb.MULTIPOLYGON, polys)) if polys else None

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                made = shape(r["geometry"], r)
                if made is not None:
                    out.append({**{k: r[k] for k in keep}, "geom_type": made[0], "geom": made[1]})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    cols = [*keep, "geometry", "lon", "lat", "lines", "inners", "is_relation"]
    return objects.select(*cols).mapInArrow(run, schema)


_LINES = "array<array<struct<lon:double,lat:double>>>"


def _finish(rows: DataFrame, kind: str) -> DataFrame:
    have = set(rows.columns)
    add = {
        "lon": F.lit(None).cast("double"), "lat": F.lit(None).cast("double"), "lines": F.lit(None).cast(_LINES), "inners": F.lit(None).cast(_LINES),
        "is_relation": F.lit(kind == "relation"),
    }
    out = rows.withColumns({k: v for k, v in add.items() if k not in have})
    return out.withColumns({"osm_id": F.col("feature_id"), "feature_id": F.col("id") * 4 + _OSM_KIND[kind], "source_pos": F.lit(0)})


def node_features(nodes: DataFrame, profile: Profile, relations: DataFrame | None = None) -> DataFrame | None:
    """nodes: id, lon, lat, tags. Tags that a profile takes from a labelled relation are joined before the rules."""
    if profile.node_rules is None:
        return None
    t = F.col("tags")
    kept = nodes.where((F.size(t) > 0) & significant(t, profile.node_keys))
    if relations is not None and profile.accept_relation is not None:
        for key in profile.settings.get("label_tags", ()):
            kept = R.label_tags(kept, relations.where(profile.accept_relation(F.col("tags"))), key)
    return _geometries(_finish(rules.apply(kept, profile.node_rules(t)), "node"))


def way_features(ways: DataFrame, nodes: DataFrame, profile: Profile, relations: DataFrame | None = None, skip_integrity: bool = True) -> DataFrame | None:
    """ways: id, refs, tags. Their coordinates, closedness, area and parents' least admin level are joined before the rules."""
    if profile.way_rules is None:
        return None
    t = F.col("tags")
    emitted = ways.where((F.size(t) > 0) & significant(t, profile.way_keys))
    level = F.lit(None).cast("double")
    if relations is not None and profile.accept_relation is not None:
        accepted = relations.where(profile.accept_relation(F.col("tags")))
        used = R.used_ways(ways, accepted)
        emitted = emitted.unionByName(used).dropDuplicates(["id"])
        least = R.least_parent_number(emitted, accepted, R.WAY, "admin_level").select(F.col("id").alias("_i"), F.coalesce("least", F.lit(11.0)).alias("admin_level"))
        emitted = emitted.join(least, emitted["id"] == least["_i"], "left").drop("_i")
    else:
        emitted = emitted.withColumn("admin_level", level)
    g = R.way_coordinates(emitted, nodes, skip_integrity)
    g = g.withColumns({"lines": F.array("coords"), "area": F.when(F.col("closed"), ring_area(F.col("coords"))).otherwise(0.0)})
    return _geometries(_finish(rules.apply(g, profile.way_rules(t)), "way"))


def ring_area(coords: Column) -> Column:
    """Square metres of a closed ring, as an expression (the spherical excess of its edges)."""
    r = P.EARTH_RADIUS
    n = F.size(coords)

    def step(acc, i):
        a, b = F.element_at(coords, i), F.element_at(coords, i + 1)
        d = F.radians(b["lon"] - a["lon"])
        p, q = F.tan(F.radians(a["lat"]) / 2), F.tan(F.radians(b["lat"]) / 2)
        return acc + F.lit(2.0) * F.atan2(F.tan(d / 2) * (p + q), F.lit(1.0) + p * q)

    return F.when(n > 3, F.abs(F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), step)) * r * r).otherwise(0.0)


def line_length(coords: Column) -> Column:
    """Metres along a line."""

    def step(acc, i):
        a, b = F.element_at(coords, i), F.element_at(coords, i + 1)
        p, q = F.radians(a["lat"]), F.radians(b["lat"])
        h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(b["lon"] - a["lon"]) / 2), 2)
        return acc + F.lit(2 * P.EARTH_RADIUS) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))

    return F.when(F.size(coords) > 1, F.aggregate(F.sequence(F.lit(1), F.size(coords) - 1), F.lit(0.0), step)).otherwise(0.0)


def relation_features(relations: DataFrame, ways: DataFrame, nodes: DataFrame, profile: Profile) -> DataFrame | None:
    """Multipolygons go by the way rules, other accepted relations by the relation rules. A role other than inner is outer."""
    t = F.col("tags")
    native = is_multipolygon(t)
    if profile.way_rules is None and profile.relation_rules is None:
        return None
    keep = native & significant(t, profile.way_keys)
    if profile.relation_rules is not None and profile.accept_relation is not None:
        keep = keep | profile.accept_relation(t)
    rel = relations.where(keep)
    m = R.members(rel).where(F.col("type") == R.WAY)
    w = R.way_coordinates(ways, nodes).select(F.col("id").alias("_w"), "coords")
    joined = m.join(w, m["ref"] == w["_w"])
    inner = F.col("role") == "inner"
    lists = joined.groupBy("rel_id").agg(
        F.sort_array(F.collect_list(F.when(~inner, F.struct("seq", "coords")))).alias("o"), F.sort_array(F.collect_list(F.when(inner, F.struct("seq", "coords")))).alias("i")
    )
    lists = lists.select("rel_id", F.transform("o", lambda s: s["coords"]).alias("lines"), F.transform("i", lambda s: s["coords"]).alias("inners"))
    g = rel.join(lists, rel["id"] == lists["rel_id"]).where(F.size("lines") > 0)
    rings = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + ring_area(x))
    g = g.withColumns({"closed": native, "area": F.greatest(rings(F.col("lines")) - rings(F.col("inners")), F.lit(0.0)), "admin_level": F.lit(None).cast("double")})
    out = None
    for wanted, make in ((native, profile.way_rules), (~native, profile.relation_rules)):
        if make is not None:
            made = _geometries(_finish(rules.apply(g.where(wanted), make(t)), "relation"))
            out = made if out is None else out.unionByName(made)
    return out


def external_features(spark: SparkSession, layer: C.Layer, box, remap=None, first_id: int = 0) -> DataFrame:
    """Features of a layer with a source: GeoJSON by suffix, else a shapefile; clipped to the box, columns as asked."""
    columns = None if layer.all_source_columns else (layer.source_columns or [])
    if layer.source.lower().endswith((".geojson", ".json", *geojson.LINE_SUFFIXES)):
        rows = geojson.read(spark, layer.source, columns)
    else:
        rows = shapefile.read(spark, layer.source, box, "true" if columns is None else columns)
    props = F.col("properties")
    if remap is not None:
        rows = rows.withColumns({"_p": remap(props, F.lit(layer.name))})
        props = F.col("_p")
    code = F.map_filter("types", lambda k, v: v.isNotNull())
    as_attr = lambda e: F.struct(
        e["key"].alias("key"),
        F.when(code[e["key"]] == 3, A.BOOL).when(code[e["key"]].isin(1, 2) & (F.lit(not layer.source.lower().endswith(("json", "jsonl", "ndjson")))), F.when(code[e["key"]] == 1, A.INT).otherwise(A.FLOAT))
        .when(code[e["key"]] == 1, A.FLOAT).when((code[e["key"]] == 2), A.BOOL).otherwise(A.STRING).alias("vtype"),
        e["value"].alias("s"),
        F.when(e["value"].isin("true", "false"), (e["value"] == "true").cast("double")).otherwise(e["value"].try_cast("double")).alias("d"),
        F.lit(0).alias("minzoom"),
    )
    attrs = F.transform(F.filter(F.map_entries(props), lambda e: e["key"] != "_minzoom"), as_attr)
    fmin = F.coalesce(props["_minzoom"].try_cast("int"), F.lit(layer.minzoom))
    projected = rows.select(
        (F.monotonically_increasing_id() * 4 + 3).alias("feature_id"), F.lit(None).cast("long").alias("osm_id"),
        F.lit(1).alias("source_pos"), F.lit(layer.name).alias("layer"), "geom_type", "geom", F.array_sort(attrs).alias("attrs"), fmin.alias("fmin"), F.lit(0).alias("z_order"),
    )

    schema = T._parse_datatype_string(render.FEATURE)
    clip = None if box is None else (box[0], render._latp(box[1]), box[2], render._latp(box[3]))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        of = {wkb.POINT: render.POINT, wkb.LINE: render.LINE, wkb.MULTILINE: render.MLINE, wkb.POLYGON: render.POLY, wkb.MULTIPOLYGON: render.POLY}
        up = lambda g: (g[0], render._latp(g[1])) if isinstance(g, tuple) else [up(x) for x in g]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kind = of[r["geom_type"]]
                shape = up(render.parts_of(kind, r["geom"]))
                shape = shape if clip is None else render.clip(kind, shape, clip)
                if kind == render.POLY:
                    shape = overlay.make_valid(shape)
                if shape:
                    out.append({**r, "geom_type": kind, "geom": wkb.dump(render._CODES[kind], shape)})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    cols = ["feature_id", "osm_id", "source_pos", "layer", "geom_type", "geom", "attrs", "fmin", "z_order"]
    return projected.select(*cols).mapInArrow(run, render.FEATURE)


def _packed(column: Column, make) -> Column:
    """WKB of a struct column, by a function of its row as a dict."""

    @pandas_udf("binary")
    def run(s: pd.DataFrame) -> pd.Series:
        return pd.Series([make(r) for r in s.to_dict("records")])

    return run(column)


def point_geometry(x: str, y: str) -> Column:
    from tessella.kernels import batches

    @arrow_udf("binary")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return batches.point_wkb(*(v.to_numpy(zero_copy_only=False) for v in (x, y)))

    return run(F.col(x).cast("double"), F.col(y).cast("double"))


def box_polygon(min_x: str, min_y: str, max_x: str, max_y: str, projected: bool = True) -> Column:
    """A box in degrees as a polygon in lon/latp (or lon/lat)."""
    up = render._latp if projected else float

    def make(r):
        w, s, e, n = r["a"], up(r["b"]), r["c"], up(r["d"])
        return wkb.dump(wkb.MULTIPOLYGON, [[[(w, s), (e, s), (e, n), (w, n), (w, s)]]])

    return _packed(F.struct(*[F.col(c).cast("double").alias(k) for c, k in zip((min_x, min_y, max_x, max_y), "abcd", strict=True)]), make)


def line_of(ways: DataFrame) -> DataFrame:
    """(id, geom): lines in lon/latp of ways with `coords`."""

    from tessella.kernels import batches as B

    def run(batches):
        for batch in batches:
            offsets = batch.column(1).offsets.to_numpy().astype(np.int64)
            lon, lat = (batch.column(1).values.field(k).slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False) for k in ("lon", "lat"))
            latp = np.array([render._latp(v) for v in lat.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), B.line_wkb(np.diff(offsets), np.column_stack([lon, latp]))], names=["id", "geom"])

    return ways.select("id", "coords").mapInArrow(run, "id long, geom binary")


def degrees(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", (F.col("lon_e7") / 1e7).alias("lon"), (F.col("lat_e7") / 1e7).alias("lat"), "tags")


def features(spark: SparkSession, config: C.Config, profile: Profile, inputs: list[str], skip_integrity: bool = True) -> DataFrame:
    """All features of the inputs and of the external layers."""
    found = []
    if inputs:
        path = ",".join(inputs)
        nodes, ways, rels = (osm_pbf.read(spark, path, k) for k in osm_pbf.KINDS)
        nodes = degrees(nodes)
        w = ways.select("id", "refs", "tags")
        found += [node_features(nodes, profile, rels), way_features(w, nodes, profile, rels, skip_integrity), relation_features(rels, w, nodes, profile)]
    found += [external_features(spark, la, config.bounding_box, profile.remap) for la in config.layers if la.source]
    found = [f for f in found if f is not None]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def encoded(found: DataFrame, config: C.Config) -> DataFrame:
    return render.tiles(render.render(render.pieces(found, config), config))


def run(spark: SparkSession, config: C.Config, profile: Profile, inputs: list[str], output: str, merge: bool = False, skip_integrity: bool = True) -> None:
    found = features(spark, config, profile, inputs, skip_integrity)
    box = config.bounding_box or (-180.0, -85.0511, 180.0, 85.0511)
    layers = metadata.vector_layers(config, A.layer_fields(found))
    made = encoded(found, config)
    mode = C.output_mode(output)
    if mode == "pmtiles":
        pmtiles.write(made, output, metadata.for_pmtiles(config, layers), box, (config.minzoom, config.maxzoom))
        return
    if merge:
        made = render.merge(mbtiles.read(spark, output), made)
    packed = made if config.compress == "none" else made.select("z", "x", "y", compression.gzipped("data", config.compress).alias("data"))
    if mode == "mbtiles":
        mbtiles.write(packed, output, metadata.for_mbtiles(config, box, layers), merge)
    else:
        directory.write(packed, output, metadata.for_directory(config, box, layers))


def main(argv: list[str] | None = None) -> None:
    o = C.options(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    headers = [osm_pbf.read_header(p).bbox for p in o.input]
    boxes = [b for b in headers if b]
    box = o.bbox or ((min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else None)
    run(spark, C.load(o.config, box), rules.PROFILES[o.process], o.input, o.output, o.merge, True if o.skip_integrity else False)


if __name__ == "__main__":
    main()
