"""Web-Mercator tile Columns."""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .geo import clamp, lit

# Latitude limit of the square world, metres per pixel at zoom 0 (256-pixel tiles).
MAX_LAT = 85.0511287798066
M_PER_PIXEL_Z0 = 156543.03392804097


def per_axis(z) -> Column:
    return F.pow(F.lit(2.0), lit(z))


def tile_x_exact(lon, z) -> Column:
    return (lit(lon) + 180.0) / 360.0 * per_axis(z)


def tile_y_exact(lat, z) -> Column:
    p = F.radians(clamp(lat, -MAX_LAT, MAX_LAT))
    return (1.0 - F.asinh(F.tan(p)) / math.pi) / 2.0 * per_axis(z)


def _whole(v: Column, z) -> Column:
    return F.when(v.isNotNull(), F.least(F.greatest(F.floor(v), F.lit(0)), per_axis(z).cast("long") - 1)).cast("int")


def tile_x(lon, z) -> Column:
    return _whole(tile_x_exact(lon, z), z)


def tile_y(lat, z) -> Column:
    return _whole(tile_y_exact(lat, z), z)


def tms_row(y, z) -> Column:
    return (per_axis(z).cast("int") - 1 - lit(y)).cast("int")


def tile_lon(x, z) -> Column:
    return lit(x) / per_axis(z) * 360.0 - 180.0


def tile_lat(y, z) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * lit(y) / per_axis(z)))))


def tile_bounds(x, y, z) -> Column:
    return F.struct(tile_lat(lit(y) + 1, z).alias("s"), tile_lon(x, z).alias("w"),
                    tile_lat(y, z).alias("n"), tile_lon(lit(x) + 1, z).alias("e"))


def parent(v) -> Column:
    return F.shiftright(lit(v), 1)


def children(x, y) -> Column:
    x2, y2 = F.shiftleft(lit(x), 1), F.shiftleft(lit(y), 1)
    return F.array(*[F.struct((x2 + i).alias("x"), (y2 + j).alias("y")) for j in (0, 1) for i in (0, 1)])


def m_per_pixel(z, lat) -> Column:
    return M_PER_PIXEL_Z0 * F.cos(F.radians(lit(lat))) / per_axis(z)


def zoom_for_scale(denom, lat, mm_per_pixel, z_min: int, z_max: int) -> Column:
    """Whole zoom whose ground resolution is nearest the display scale."""
    p = clamp(lat, -MAX_LAT, MAX_LAT)
    view = lit(denom) * lit(mm_per_pixel) / 1000.0
    z = F.log2(F.try_divide(M_PER_PIXEL_Z0 * F.cos(F.radians(p)), view))
    return F.when((lit(denom) > 0) & z.isNotNull(),
                  F.least(F.greatest(F.round(z), F.lit(z_min)), F.lit(z_max))).otherwise(F.lit(z_max)).cast("int")


def scale_for_zoom(z, lat, mm_per_pixel) -> Column:
    return m_per_pixel(z, clamp(lat, -MAX_LAT, MAX_LAT)) * 1000.0 / lit(mm_per_pixel)


def tiles_covering(s, w, n, e, z) -> Column:
    """Array of struct(x, y) tiles touching a box that does not cross +-180."""
    xs = F.sequence(tile_x(w, z), tile_x(e, z))
    ys = F.sequence(tile_y(n, z), tile_y(s, z))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))
