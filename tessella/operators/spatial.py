"""Spatial joins against a layer of named shapes: an equi-join on grid cells, then the exact test."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def cells(rows: DataFrame, size: float, min_x: str, min_y: str, max_x: str, max_y: str) -> DataFrame:
    """A row per grid cell that the box meets: columns cx, cy."""
    lo, hi = (lambda c: F.floor(F.col(c) / size).cast("int")), (lambda c: F.floor(F.col(c) / size).cast("int"))
    return rows.withColumn("cx", F.explode(F.sequence(lo(min_x), hi(max_x)))).withColumn("cy", F.explode(F.sequence(lo(min_y), hi(max_y))))


def candidates(objects: DataFrame, shapes: DataFrame, size: float) -> DataFrame:
    """Pairs whose boxes meet, each once. Boxes: min_x, min_y, max_x, max_y on objects; s_-prefixed on shapes.

    A pair sharing several cells is kept in one: that of its boxes' common lower corner.
    """
    a = cells(objects, size, "min_x", "min_y", "max_x", "max_y")
    b = cells(shapes, size, "s_min_x", "s_min_y", "s_max_x", "s_max_y")
    meet = (F.col("min_x") <= F.col("s_max_x")) & (F.col("max_x") >= F.col("s_min_x")) & (F.col("min_y") <= F.col("s_max_y")) & (F.col("max_y") >= F.col("s_min_y"))
    corner = (F.col("cx") == F.floor(F.greatest("min_x", "s_min_x") / size)) & (F.col("cy") == F.floor(F.greatest("min_y", "s_min_y") / size))
    return a.join(b, ["cx", "cy"]).where(meet & corner).drop("cx", "cy")


def intersects(objects: DataFrame, shapes: DataFrame, size: float, exact: Column | None = None) -> DataFrame:
    """Objects that meet some shape."""
    found = candidates(objects, shapes, size)
    ids = (found if exact is None else found.where(exact)).select(F.col("id").alias("_id")).distinct()
    return objects.join(ids, objects["id"] == ids["_id"], "left_semi")


def find_names(objects: DataFrame, shapes: DataFrame, size: float, exact: Column | None = None) -> DataFrame:
    """(id, names): sorted names of the shapes each object meets."""
    found = candidates(objects, shapes, size)
    found = found if exact is None else found.where(exact)
    return found.groupBy("id").agg(F.sort_array(F.collect_set("name")).alias("names"))


def box_covers() -> Column:
    """Whether the shape's box covers the object's."""
    return (F.col("s_min_x") <= F.col("min_x")) & (F.col("s_max_x") >= F.col("max_x")) & (F.col("s_min_y") <= F.col("min_y")) & (F.col("s_max_y") >= F.col("max_y"))


def area_intersecting(objects: DataFrame, shapes: DataFrame, size: float, area: Column | None = None) -> DataFrame:
    """(id, area): the sum of the areas each object shares with the shapes; of boxes unless `area` is given."""
    w = F.least("max_x", "s_max_x") - F.greatest("min_x", "s_min_x")
    h = F.least("max_y", "s_max_y") - F.greatest("min_y", "s_min_y")
    one = w * h if area is None else area
    return candidates(objects, shapes, size).groupBy("id").agg(F.sum(one).alias("area"))


def exact_polygons(op: str) -> Callable:
    """A pandas predicate over WKB columns: 'intersects', 'covered_by' or the shared 'area'."""
    @pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        from tessella.kernels import overlay, wkb

        def one(x: bytes, y: bytes) -> float:
            p, q = wkb.polygons(bytes(x)), wkb.polygons(bytes(y))
            common = overlay.area(overlay.overlay(p, q, "and"))
            if op == "area":
                return common
            if op == "covered_by":
                return float(common >= overlay.area(p) * (1 - 1e-9))
            return float(common > 0)

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return run
