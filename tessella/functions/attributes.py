"""Feature attributes: typed values with a zoom from which they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRING, FLOAT, BOOL, INT = 0, 1, 2, 3
ATTRIBUTE = "struct<key:string,vtype:int,s:string,d:double,minzoom:int>"
#: What a published field of each type code is called.
FIELD_NAMES = {STRING: "String", FLOAT: "Number", BOOL: "Boolean", INT: "Number"}


def _attr(key: str, vtype: int, s: Column | None, d: Column | None, minzoom) -> Column:
    return F.struct(
        F.lit(key).alias("key"), F.lit(vtype).alias("vtype"),
        (s if s is not None else F.lit(None)).cast("string").alias("s"),
        (d if d is not None else F.lit(None)).cast("double").alias("d"),
        (minzoom if isinstance(minzoom, Column) else F.lit(minzoom)).cast("int").alias("minzoom"),
    )


def attribute(key: str, value: Column, minzoom=0) -> Column:
    return _attr(key, STRING, value, None, minzoom)


def attribute_numeric(key: str, value: Column, minzoom=0) -> Column:
    return _attr(key, FLOAT, None, value, minzoom)


def attribute_boolean(key: str, value: Column, minzoom=0) -> Column:
    return _attr(key, BOOL, None, value.cast("int"), minzoom)


def attribute_integer(key: str, value: Column, minzoom=0) -> Column:
    return _attr(key, INT, None, value.cast("long"), minzoom)


def attribute_set(*attrs: Column) -> Column:
    """A feature's attributes by key: the last write of a key stands; null values and empty strings are no attribute."""
    listed = F.array(*attrs) if attrs else F.array().cast(f"array<{ATTRIBUTE}>")
    valued = F.filter(listed, lambda a: a.isNotNull() & (a["d"].isNotNull() | (F.coalesce(a["s"], F.lit("")) != "")))
    none = F.array().cast(f"array<{ATTRIBUTE}>")
    # folded, so the list is made once: a lambda that reads it would make it anew for each attribute
    last = F.aggregate(valued, none, lambda kept, a: F.concat(F.filter(kept, lambda k: k["key"] != a["key"]), F.array(a)))
    return F.array_sort(last)


def shown(attrs: Column, zoom) -> Column:
    """The attributes visible at a zoom."""
    z = zoom if isinstance(zoom, Column) else F.lit(zoom)
    return F.filter(attrs, lambda a: a["minzoom"] <= z)


def attr_hash(attrs: Column) -> Column:
    """One number for an attribute set: its identity in sorts and merges, the same on every run."""
    return F.xxhash64(attrs)


def last_wins(rows: DataFrame, group: list[str], key: str, order: list[str]) -> DataFrame:
    """Of several writes of a key, the last in `order`."""
    w = Window.partitionBy(*group, key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def layer_fields(features: DataFrame, layer: str = "layer", attrs: str = "attrs") -> DataFrame:
    """(layer, key, vtype): the fields each layer publishes, the highest type code where features differ."""
    return (
        features.select(layer, F.explode(attrs).alias("a")).groupBy(F.col(layer).alias("layer"), F.col("a.key").alias("key"))
        .agg(F.max("a.vtype").alias("vtype"))
    )


def vector_layers(fields: DataFrame, layers: DataFrame) -> DataFrame:
    """(layer, fields JSON) as metadata lists them; layers that write to another are left out."""
    name = F.create_map(*[F.lit(x) for kv in FIELD_NAMES.items() for x in kv])
    entries = fields.select("layer", F.struct("key", name[F.col("vtype")].alias("value")).alias("e"))
    listed = entries.groupBy("layer").agg(F.map_from_entries(F.sort_array(F.collect_list("e"))).alias("fields"))
    return (
        layers.where(F.coalesce(F.col("write_to"), F.lit("")) == "").join(listed, layers["name"] == listed["layer"], "left")
        .select(
            layers["name"].alias("id"), layers["minzoom"], layers["maxzoom"],
            F.coalesce(F.to_json("fields"), F.lit("{}")).alias("fields"),
        )
    )
