"""Operators on features within a tile: filters, order, limits, merges by key, unions and tile merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = ["z", "x", "y"]
#: What makes two features of a tile the same (the zoom from which they show does not).
IDENTITY = ["layer_id", "z_order", "geom_type", "attr_hash", "feature_id", "osm_id"]
#: What makes two features of a layer mergeable.
MERGE_KEY = ["geom_type", "z_order", "attr_hash"]


def with_layers(features: DataFrame, layers: DataFrame) -> DataFrame:
    """Each feature with its layer's settings; a feature of an unknown layer is an error when the rows are read.

    layers is one row per configured layer, so it is broadcast: its size is bounded by the configuration file.
    """
    joined = features.join(F.broadcast(layers), features["layer"] == layers["name"], "left")
    unknown = F.raise_error(F.concat(F.lit("unknown layer "), F.col("layer"))).cast("string")
    return joined.withColumn("name", F.coalesce("name", unknown))


def in_zoom_range(rows: DataFrame, minzoom: str = "minzoom", maxzoom: str = "maxzoom") -> DataFrame:
    return rows.where(F.col("z").between(F.col(minzoom), F.col(maxzoom)))


def distinct_in_tile(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates([*TILE, *IDENTITY])


def tile_order(ascending: Column) -> list[Column]:
    """Order within a layer: z_order up or down as the layer says, then kind, attributes, id."""
    return [
        F.when(ascending, F.col("z_order")).otherwise(-F.col("z_order")).asc(),
        F.col("geom_type").asc(), F.col("attr_hash").asc(), F.col("feature_id").asc(),
    ]


def ascending(feature_limit: Column, setting: Column | None = None) -> Column:
    """Whether low z_orders come first: as set, else unless the layer has a limit."""
    default = F.coalesce(feature_limit, F.lit(0)) == 0
    return default if setting is None else F.coalesce(setting, default)


def limit_features(rows: DataFrame, keys: list[str], order: list[Column], limit: Column, below: Column, most: int, by: Column | None = None) -> DataFrame:
    """The first `limit` rows of each tile, sublayer and source at zooms under `below`; a limit of 0 is none.

    most: the largest limit there is. Rows without a limit are not sorted, and for the others the plan has a group limit of
    `most` before the exchange: of a tile with very many features each task sends that many, not all. by: another rank than
    the row number.
    """
    limited = (limit > 0) & (F.col("z") < below)
    rank = (F.row_number() if by is None else by).over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.where(limited).withColumn("_rank", rank).where(F.col("_rank") <= most).where(F.col("_rank") <= limit).drop("_rank")
    return rows.where(~F.coalesce(limited, F.lit(False))).unionByName(first)


def combine_points(points: DataFrame, keys: list[str], collect: bool = True) -> DataFrame:
    """Points of a tile that share a merge key become one multipoint, in id order; the id is the least."""
    aggs = [F.count("*").alias("n_points"), F.min("feature_id").alias("feature_id")]
    if collect:
        aggs.append(F.sort_array(F.collect_list(F.struct("feature_id", "px", "py"))).alias("points"))
    return points.groupBy(*keys, *MERGE_KEY).agg(*aggs)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources (ALL, by name), with the position of their source."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_pos", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def output_layer(rows: DataFrame, write_to: str = "write_to", name: str = "name") -> DataFrame:
    """out_layer: the layer a sublayer writes to, or its own name."""
    return rows.withColumn("out_layer", F.when(F.coalesce(F.col(write_to), F.lit("")) != "", F.col(write_to)).otherwise(F.col(name)))


def merge_tiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tiles of both sides: (z, x, y, old, new) from frames with a `data` column."""
    a, b = old.select(*TILE, F.col("data").alias("old")), new.select(*TILE, F.col("data").alias("new"))
    return a.join(b, TILE, "full_outer")


def far_points(rows: DataFrame, extent: int = 4096, reach: int = 256) -> DataFrame:
    """Points within `reach` pixels of their tile."""
    return rows.where(F.col("px").between(-reach, extent + reach) & F.col("py").between(-reach, extent + reach))


def drop_repeats(points: Column) -> Column:
    """An array of points without consecutive repeats."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.element_at(points, F.greatest(i, F.lit(1)))))


def bbox_union(rows: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return rows.agg(F.min(lon).alias("min_lon"), F.min(lat).alias("min_lat"), F.max(lon).alias("max_lon"), F.max(lat).alias("max_lat"))


def lookup(rows: DataFrame, key: str, store: DataFrame, value: str = "value") -> DataFrame:
    """rows with the stored value of a key, "" where there is none."""
    s = store.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    return rows.join(s, rows[key] == s["_k"], "left").withColumn(value, F.coalesce("_v", F.lit(""))).drop("_k", "_v")
