"""From features to tiles: which tiles hold a feature at which zoom, and which tiles exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import projection as P

#: Zoom up to which tiles are known exactly; deeper ones exist if their ancestor here does.
PRECISE_ZOOM = 14


def index_points(points: DataFrame, zoom: int, lon: str = "lon", latp: str = "latp") -> DataFrame:
    """Adds the tile (z, x, y) of each point at one zoom; points outside the world's tiles are dropped."""
    n = 1 << zoom
    out = points.withColumns({"z": F.lit(zoom), "x": P.lon_to_tilex(lon, zoom), "y": P.latp_to_tiley(latp, zoom)})
    return out.where(F.col("x").between(0, n - 1) & F.col("y").between(0, n - 1))


def roll_up(tiles: DataFrame, base: int, lowest: int, highest: int, minzoom: str | None = None) -> DataFrame:
    """A row for each zoom in lowest..highest: rows at `base` (columns x, y) moved to their ancestors.

    With `minzoom`, only from that zoom on: the filter is part of the exploded range, so no row is made in vain.
    """
    low = F.lit(lowest) if minzoom is None else F.greatest(F.lit(lowest), F.col(minzoom).cast("int"))
    top = min(highest, base)
    zooms = F.when(low <= top, F.sequence(low, F.lit(top))).otherwise(F.array().cast("array<int>"))
    # the shift's width is a column here, so it is written as SQL
    return tiles.drop("z").withColumn("z", F.explode(zooms)).withColumns(
        {"x": F.expr(f"shiftright(x, {base} - z)"), "y": F.expr(f"shiftright(y, {base} - z)")}
    )


def tile_set(tiles: DataFrame, base: int, lowest: int = 0, highest: int | None = None) -> DataFrame:
    """Distinct (z, x, y) from lowest to highest zoom.

    Each zoom is made from the distinct tiles of the one below, so the rows shrink as zooms fall instead of being
    exploded first.
    """
    highest = base if highest is None else highest
    level = tiles.select("x", "y").distinct()
    out = None
    for z in range(base, lowest - 1, -1):
        if z < base:
            level = level.select(P.parent("x").alias("x"), P.parent("y").alias("y")).distinct()
        if z <= highest:
            now = level.select(F.lit(z).alias("z"), "x", "y")
            out = now if out is None else out.unionByName(now)
    if highest > base:
        out = (out if out is not None else tiles.select("z", "x", "y").limit(0)).unionByName(
            deeper(tiles.select("x", "y").distinct(), base, base + 1, highest)
        )
    return out


def deeper(tiles: DataFrame, base: int, lowest: int, highest: int) -> DataFrame:
    """Tiles beyond the precise zoom: all children of the tiles at `base`."""
    z = F.explode(F.sequence(F.lit(lowest), F.lit(highest)))
    grown = tiles.select("x", "y", z.alias("z")).withColumn("n", F.expr(f"shiftleft(1, z - {base})"))
    grown = grown.withColumn("dx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    grown = grown.withColumn("dy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return grown.select("z", (F.col("x") * F.col("n") + F.col("dx")).alias("x"), (F.col("y") * F.col("n") + F.col("dy")).alias("y"))


def within_box(tiles: DataFrame, min_lon: float, min_latp: float, max_lon: float, max_latp: float) -> DataFrame:
    """Tiles whose box, drawn in a little, meets the clipping box."""
    b = P.tile_box("z", "x", "y")
    return tiles.where((b["w"] <= max_lon) & (b["e"] >= min_lon) & (b["s"] <= max_latp) & (b["n"] >= min_latp))


def covers_parent_cell(tiles: DataFrame, cell_zoom: int = 6) -> DataFrame:
    """Tiles with the number of the cell at `cell_zoom` that holds them: a partitioning key for output."""
    return tiles.withColumn(
        "cell",
        F.when(F.col("z") >= cell_zoom, F.expr(f"shiftright(x, z - {cell_zoom}) * {1 << cell_zoom} + shiftright(y, z - {cell_zoom})")),
    )


def interleaved(x: Column, y: Column, bits: int) -> Column:
    """Bits of x and y interleaved: tiles near each other get near numbers."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        bx = F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)).cast("long"), 2 * k + 1)
        by = F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1)).cast("long"), 2 * k)
        out = out.bitwiseOR(bx).bitwiseOR(by)
    return out


def cluster(features: DataFrame, zoom: int, partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted along the interleaved tile number at one zoom."""
    keyed = features.withColumn("_curve", interleaved(F.col("x"), F.col("y"), zoom))
    dealt = keyed.repartitionByRange(partitions, "_curve") if partitions else keyed.repartitionByRange("_curve")
    return dealt.sortWithinPartitions("_curve").drop("_curve")


def job_order(tiles: DataFrame) -> DataFrame:
    """Tiles in output order: zooms below 6 breadth first, then each zoom-6 cell depth first."""
    low = F.col("z") < 6
    cell_x, cell_y = F.expr("shiftright(x, greatest(z - 6, 0))"), F.expr("shiftright(y, greatest(z - 6, 0))")
    zero = F.lit(0)
    key = F.struct(
        F.when(low, 0).otherwise(1).alias("a"), F.when(low, F.col("z")).otherwise(cell_x).alias("b"), F.when(low, F.col("x")).otherwise(cell_y).alias("c"),
        F.when(low, F.col("y")).otherwise(zero).alias("d"), F.col("z"), F.col("x"), F.col("y"),
    )
    return tiles.orderBy(key)


def weight_batches(tiles: DataFrame, cap: int = 1000) -> DataFrame:
    """Batch numbers such that a batch's weights sum to about `cap`: shallow tiles weigh more.

    Weights are summed per (z, x) first, so the ordered window runs over few rows; within a column the sum is by y.
    """
    from pyspark.sql import Window

    weight = F.when(F.col("z") > 12, 1).when(F.col("z") > 11, 10).when(F.col("z") > 10, 100).otherwise(1000).cast("long")
    t = tiles.withColumn("weight", weight)
    sums = t.groupBy("z", "x").agg(F.sum("weight").alias("w"))
    before = sums.withColumn("before", F.sum("w").over(Window.orderBy("z", "x").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.sum("weight").over(Window.partitionBy("z", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, -1))
    joined = t.join(before.select("z", "x", "before"), ["z", "x"]).withColumn("own", own)
    start = F.coalesce("before", F.lit(0)) + F.coalesce("own", F.lit(0))
    return joined.select("z", "x", "y", "weight", F.floor(start / cap).cast("long").alias("batch"))
