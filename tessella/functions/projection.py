"""Web-Mercator tile arithmetic as Column expressions.

"latp" is a latitude projected so that it shares the scale of longitude degrees (-180..180).
Tile and pixel results are integers, which agree between engines; raw projected doubles differ in their last bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clamp of projected latitude, Earth radius in metres, tile extent in pixels.
MAX_LATITUDE = 85.06
EARTH_RADIUS = 6371000.0
EXTENT = 4096


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if not isinstance(x, str) else F.col(x)


def _scale(z) -> Column:
    return F.pow(F.lit(2.0), _c(z).cast("double"))


def lat_to_latp(lat) -> Column:
    clamped = F.greatest(F.least(_c(lat), F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    return F.degrees(F.log(F.tan(F.radians(clamped + 90.0) / 2.0)))


def latp_to_lat(latp) -> Column:
    return F.degrees(F.atan(F.exp(F.radians(_c(latp)))) * 2.0) - 90.0


def to_e7(degrees) -> Column:
    """Degrees as a whole number of 1e-7, cut towards zero."""
    return (_c(degrees) * 1e7).cast("int")


def lon_to_tilexf(lon, z) -> Column:
    return (_c(lon) + 180.0) / 360.0 * _scale(z)


def latp_to_tileyf(latp, z) -> Column:
    return (180.0 - _c(latp)) / 360.0 * _scale(z)


def lon_to_tilex(lon, z) -> Column:
    return F.floor(lon_to_tilexf(lon, z)).cast("int")


def latp_to_tiley(latp, z) -> Column:
    return F.floor(latp_to_tileyf(latp, z)).cast("int")


def lat_to_tiley(lat, z) -> Column:
    return latp_to_tiley(lat_to_latp(lat), z)


def tilex_to_lon(x, z) -> Column:
    return _c(x) / _scale(z) * 360.0 - 180.0


def tiley_to_latp(y, z) -> Column:
    return 180.0 - _c(y) / _scale(z) * 360.0


def tiley_to_lat(y, z) -> Column:
    return latp_to_lat(tiley_to_latp(y, z))


def degp_to_meter(degp, latp) -> Column:
    return F.radians(_c(degp)) * EARTH_RADIUS * F.cos(F.radians(latp_to_lat(latp)))


def meter_to_degp(meter, latp) -> Column:
    return F.degrees(_c(meter) / EARTH_RADIUS / F.cos(F.radians(latp_to_lat(latp))))


def tile_bounds(z, x, y, extent: int = EXTENT, margin: float = 1 / 200) -> dict[str, Column]:
    """Bounds of a tile, its clipping box a margin wider, and degrees per pixel."""
    x, y = _c(x), _c(y)
    west, east = tilex_to_lon(x, z), tilex_to_lon(x + 1, z)
    south, north = tiley_to_latp(y + 1, z), tiley_to_latp(y, z)
    dx, dy = (east - west) * margin, (north - south) * margin
    return {
        "min_lon": west, "max_lon": east, "min_latp": south, "max_latp": north,
        "clip_min_lon": west - dx, "clip_max_lon": east + dx, "clip_min_latp": south - dy, "clip_max_latp": north + dy,
        "x_scale": (east - west) / extent, "y_scale": (north - south) / extent,
    }


def pixel_x(lon, z, x, extent: int = EXTENT) -> Column:
    return F.floor((_c(lon) - tilex_to_lon(x, z)) / (360.0 / _scale(z) / extent)).cast("int")


def pixel_y(latp, z, y, extent: int = EXTENT) -> Column:
    return F.floor((tiley_to_latp(y, z) - _c(latp)) / (360.0 / _scale(z) / extent)).cast("int")


def floor_to_pixel(lon, latp, z, x, y, extent: int = EXTENT) -> tuple[Column, Column]:
    """A point moved to its pixel's corner, back in degrees."""
    b = tile_bounds(z, x, y, extent)
    return (
        pixel_x(lon, z, x, extent) * b["x_scale"] + b["min_lon"],
        b["max_latp"] - pixel_y(latp, z, y, extent) * b["y_scale"],
    )


def tile_box(z, x, y) -> dict[str, Column]:
    """The tile's box drawn in by 1/8192 of its size, for tests against a clipping box."""
    b = tile_bounds(z, x, y)
    dx, dy = (b["max_lon"] - b["min_lon"]) / 8192.0, (b["max_latp"] - b["min_latp"]) / 8192.0
    return {"w": b["min_lon"] + dx, "s": b["min_latp"] + dy, "e": b["max_lon"] - dx, "n": b["max_latp"] - dy}


def extend_box(z, x, y) -> dict[str, Column]:
    """Box for coarse clipping: two tiles further west and north, 8191/8192 of a tile further east and south."""
    b = tile_bounds(z, x, y)
    w, h = b["max_lon"] - b["min_lon"], b["max_latp"] - b["min_latp"]
    far = 8191.0 / 8192.0
    return {"w": b["min_lon"] - 2 * w, "s": b["min_latp"] - h * far, "e": b["max_lon"] + w * far, "n": b["max_latp"] + 2 * h}


def parent(v, levels=1) -> Column:
    return F.shiftright(_c(v), levels)


def flip_row(y, z) -> Column:
    """Row number counted from the other edge."""
    return (F.call_function("shiftleft", F.lit(1), _c(z).cast("int")) - 1 - _c(y)).cast("int")


def hilbert_tile_id(z, x, y) -> Column:
    """Number of a tile along the Hilbert curve, after all tiles of lower zooms (PMTiles v3)."""
    z, x, y = _c(z).cast("int"), _c(x).cast("long"), _c(y).cast("long")
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a: Column, level: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        rx, ry = (a["x"].bitwiseAND(s) > 0).cast("long"), (a["y"].bitwiseAND(s) > 0).cast("long")
        d = a["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        fx, fy = F.when(rx == 1, s - 1 - a["x"].bitwiseAND(s - 1)).otherwise(a["x"].bitwiseAND(s - 1)), F.when(
            rx == 1, s - 1 - a["y"].bitwiseAND(s - 1)
        ).otherwise(a["y"].bitwiseAND(s - 1))
        keep = ry == 1
        return F.struct(
            F.when(keep, a["x"].bitwiseAND(s - 1)).otherwise(fy).alias("x"),
            F.when(keep, a["y"].bitwiseAND(s - 1)).otherwise(fx).alias("y"),
            d.alias("d"),
        )

    # at zoom 0 there is no level to walk
    levels = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    before = ((F.call_function("shiftleft", F.lit(1).cast("long"), 2 * z) - 1) / 3).cast("long")
    return before + F.aggregate(levels, start, step, lambda a: a["d"])


def encode_z_order(z) -> Column:
    """16-bit order value: tenths near zero, square roots beyond 1000; not finite gives 0."""
    z = _c(z).cast("double")
    high = F.floor(F.sqrt((z - 1000.0) * 10.0) + 10000.0)
    low = F.floor(F.lit(-10000.0) - F.sqrt((F.abs(z) - 1000.0) * 10.0))
    finite = ~F.isnan(z) & (F.abs(z) != F.lit(float("inf")))
    value = F.when(z > 1000, high).when(z < -1000, low).otherwise(F.floor(z * 10.0))
    return F.when(finite, F.greatest(F.least(value, F.lit(32767)), F.lit(-32768))).otherwise(0).cast("int")


def encode_min_zoom(z, top: int = 15) -> Column:
    """Whole zoom, not finite gives 0; held to 0..top rather than wrapped."""
    z = _c(z).cast("double")
    finite = ~F.isnan(z) & (F.abs(z) != F.lit(float("inf")))
    return F.when(finite, F.greatest(F.least(F.floor(z), F.lit(top)), F.lit(0))).otherwise(0).cast("int")


def simplify_level(z, latp, level, length, ratio, below) -> Column:
    base = F.when(_c(length) > 0, meter_to_degp(length, latp)).otherwise(_c(level))
    return F.when(_c(z) < _c(below), base * F.pow(_c(ratio).cast("double"), (_c(below) - 1 - _c(z)).cast("double"))).otherwise(0.0)


def filter_area_level(z, latp, area, below) -> Column:
    grown = meter_to_degp(area, latp) * F.pow(F.lit(2.0), (_c(below) - 1 - _c(z)).cast("double"))
    return F.when(_c(z) < _c(below), grown).otherwise(0.0)
