"""Sphere, tangent-plane, box and heading Columns.

Names carry the Earth model: ``sphere`` and ``plane`` use the mean radius, ``rhumb`` its own radius.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Earth radii in metres (mean sphere; curvature drop), metres per degree of latitude.
EARTH_R = 6371008.8
CURVATURE_R = 6378135.0
M_PER_DEG = EARTH_R * math.pi / 180.0


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def pinned(df, **cols):
    """Adds columns that later filters and projections read as they are.

    A one-element explode stops the optimizer from writing a long expression out again in every place
    that reads it, which would otherwise grow with each step.
    """
    for n, c in cols.items():
        df = df.withColumn(n, F.explode(F.array(c)))
    return df


def normalize_lon(lon: Column) -> Column:
    """Longitude into (-180, 180]; both +180 and -180 become +180."""
    r = F.pmod(lit(lon) + 180.0, F.lit(360.0))
    return F.when(r == 0.0, 180.0).otherwise(r - 180.0)


def clamp(v, low: float, high: float) -> Column:
    """The value held between two numbers; null stays null, which least() and greatest() would skip."""
    return F.when(lit(v) < low, low).when(lit(v) > high, high).otherwise(lit(v))


def clamp_lat(lat: Column) -> Column:
    return clamp(lat, -90.0, 90.0)


def normalize_heading(deg: Column) -> Column:
    """[0, 360); not finite gives 0."""
    bad = deg.isNull() | F.isnan(deg) | (F.abs(deg) == float("inf"))
    r = F.pmod(deg, F.lit(360.0))
    return F.when(bad | (r >= 360.0), 0.0).otherwise(r)


def signed_delta(a: Column, b: Column) -> Column:
    """Turn from a to b in (-180, 180]."""
    r = F.pmod(b - a, F.lit(360.0))
    return F.when(r > 180.0, r - 360.0).otherwise(r)


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(signed_delta(a, b))


def sphere_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres."""
    p1, p2 = F.radians(lit(lat1)), F.radians(lit(lat2))
    dl = F.radians(lit(lon2) - lit(lon1))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return 2 * EARTH_R * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))   # null stays null; least() would skip it


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial true bearing on the sphere in [0, 360); identical points give 0."""
    p1, p2 = F.radians(lit(lat1)), F.radians(lit(lat2))
    dl = F.radians(lit(lon2) - lit(lon1))
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.when((lit(lat1) == lit(lat2)) & (lit(lon1) == lit(lon2)), 0.0).otherwise(
        F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)))


def plane_m_per_deg_lon(lat: Column) -> Column:
    return M_PER_DEG * F.greatest(F.lit(1e-6), F.cos(F.radians(lit(lat))))


def plane_m(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the plane touching the sphere at the first point."""
    dx = normalize_lon(lit(lon2) - lit(lon)) * plane_m_per_deg_lon(lat)
    dy = (lit(lat2) - lit(lat)) * M_PER_DEG
    return F.sqrt(dx * dx + dy * dy)


def project_onto_segment(lat: Column, lon: Column, alat, alon, blat, blon) -> Column:
    """Struct(lat, lon, distance_m, along_m, length_m, bearing_deg) of the nearest point of a segment."""
    mx = plane_m_per_deg_lon(lat)
    ax, ay = normalize_lon(lit(alon) - lon) * mx, (lit(alat) - lat) * M_PER_DEG
    dx = normalize_lon(lit(blon) - lon) * mx - ax
    dy = (lit(blat) - lat) * M_PER_DEG - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0.0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(-(ax * dx + ay * dy), len2)))
               ).otherwise(0.0)
    px, py = ax + t * dx, ay + t * dy
    return F.struct(
        (lat + py / M_PER_DEG).alias("lat"),
        normalize_lon(lon + px / mx).alias("lon"),
        F.sqrt(px * px + py * py).alias("distance_m"),
        (t * F.sqrt(len2)).alias("along_m"),
        F.sqrt(len2).alias("length_m"),
        F.when(len2 > 0.0, normalize_heading(F.degrees(F.atan2(dx, dy)))).otherwise(0.0).alias("bearing_deg"))


def with_projection(df, name: str, lat: str, lon: str, alat: str, alon: str, blat: str, blon: str):
    """``project_onto_segment`` as a column, built in steps so that generated code stays small."""
    c = F.col
    mx = plane_m_per_deg_lon(c(lat))
    d = (df.withColumn("_mx", mx)
         .withColumn("_ax", normalize_lon(c(alon) - c(lon)) * c("_mx")).withColumn("_ay", (c(alat) - c(lat)) * M_PER_DEG)
         .withColumn("_dx", normalize_lon(c(blon) - c(lon)) * c("_mx") - c("_ax"))
         .withColumn("_dy", (c(blat) - c(lat)) * M_PER_DEG - c("_ay"))
         .withColumn("_l2", c("_dx") * c("_dx") + c("_dy") * c("_dy"))
         .withColumn("_t", F.when(c("_l2") > 0.0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(
             -(c("_ax") * c("_dx") + c("_ay") * c("_dy")), c("_l2"))))).otherwise(0.0))
         .withColumn("_px", c("_ax") + c("_t") * c("_dx")).withColumn("_py", c("_ay") + c("_t") * c("_dy")))
    p = F.struct((c(lat) + c("_py") / M_PER_DEG).alias("lat"), normalize_lon(c(lon) + c("_px") / c("_mx")).alias("lon"),
                 F.sqrt(c("_px") * c("_px") + c("_py") * c("_py")).alias("distance_m"),
                 (c("_t") * F.sqrt(c("_l2"))).alias("along_m"), F.sqrt(c("_l2")).alias("length_m"),
                 F.when(c("_l2") > 0.0, normalize_heading(F.degrees(F.atan2(c("_dx"), c("_dy"))))).otherwise(0.0).alias("bearing_deg"))
    # one-element explode: later filters on the result are not pushed back through the steps
    return d.withColumn(name, F.explode(F.array(p))).drop("_mx", "_ax", "_ay", "_dx", "_dy", "_l2", "_t", "_px", "_py")


# --- boxes: (south, west, north, east); west > east crosses the antimeridian -----------------

def crosses_antimeridian(west: Column, east: Column) -> Column:
    return lit(west) > lit(east)


def in_lon_range(lon: Column, west: Column, east: Column) -> Column:
    inside = (lon >= west) & (lon <= east)
    return F.when(crosses_antimeridian(west, east), (lon >= west) | (lon <= east)).otherwise(inside)


def box_contains(lat, lon, s, w, n, e) -> Column:
    return (lit(lat) >= s) & (lit(lat) <= n) & in_lon_range(lit(lon), lit(w), lit(e))


def box_parts(s, w, n, e) -> Column:
    """Array of one or two non-crossing boxes."""
    def box(a, b, c, d):
        return F.struct(lit(a).alias("s"), lit(b).alias("w"), lit(c).alias("n"), lit(d).alias("e"))
    return F.when(crosses_antimeridian(w, e), F.array(box(s, w, n, F.lit(180.0)), box(s, F.lit(-180.0), n, e))
                  ).otherwise(F.array(box(s, w, n, e)))


def _lon_overlap(w1, e1, w2, e2) -> Column:
    c1, c2 = crosses_antimeridian(w1, e1), crosses_antimeridian(w2, e2)
    plain = (lit(w1) <= e2) & (lit(w2) <= e1)
    either = (lit(w1) <= e2) | (lit(w2) <= e1)
    return F.when(c1 & c2, True).when(c1 | c2, either).otherwise(plain)


def box_intersects(a: tuple, b: tuple) -> Column:
    """Inclusive overlap of two (s, w, n, e) boxes, either of which may cross +-180."""
    return (lit(a[0]) <= b[2]) & (lit(b[0]) <= a[2]) & _lon_overlap(a[1], a[3], b[1], b[3])


def lon_span(w, e) -> Column:
    d = lit(e) - lit(w)
    return F.when(crosses_antimeridian(w, e), d + 360.0).otherwise(d)


def box_encloses(a: tuple, b: tuple) -> Column:
    """Box a holds the whole of box b."""
    off = F.pmod(lit(b[1]) - lit(a[1]), F.lit(360.0))
    lon_ok = (off + lon_span(b[1], b[3]) <= lon_span(a[1], a[3])) | (lon_span(a[1], a[3]) >= 360.0)
    return (lit(a[0]) <= b[0]) & (lit(b[2]) <= a[2]) & lon_ok


def box_center(s, w, n, e) -> Column:
    return F.struct(((lit(s) + lit(n)) / 2).alias("lat"),
                    normalize_lon(lit(w) + lon_span(w, e) / 2).alias("lon"))


def box_around(lat: Column, lon: Column, radius_m) -> Column:
    """The box a circle fits in: struct(s, w, n, e); wraps the world when the radius does."""
    dlat = lit(radius_m) / M_PER_DEG
    scale = M_PER_DEG * F.cos(F.radians(lat))
    dlon = F.when(scale > 1e-6, F.try_divide(lit(radius_m), scale)).otherwise(F.lit(360.0))
    whole = dlon >= 180.0
    return F.struct(clamp(lat - dlat, -90.0, 180.0).alias("s"),
                    F.when(whole, -180.0).otherwise(normalize_lon(lon - dlon)).alias("w"),
                    clamp(lat + dlat, -180.0, 90.0).alias("n"),
                    F.when(whole, 180.0).otherwise(normalize_lon(lon + dlon)).alias("e"))


def box_gap_m(a: tuple, b: tuple) -> Column:
    """Metres between the nearest points of two boxes (0 when they touch); +-180 is not unwrapped."""
    def axis(lo1, hi1, lo2, hi2):
        p1 = F.when(lit(hi1) < lo2, hi1).when(lit(hi2) < lo1, lo1).otherwise(F.greatest(lit(lo1), lit(lo2)))
        p2 = F.when(lit(hi1) < lo2, lo2).when(lit(hi2) < lo1, hi2).otherwise(F.greatest(lit(lo1), lit(lo2)))
        return p1, p2
    la, lb = axis(a[0], a[2], b[0], b[2])
    oa, ob = axis(a[1], a[3], b[1], b[3])
    return plane_m(la, oa, lb, ob)


def circle_intersects_box(lat, lon, radius_m, box: tuple) -> Column:
    """A circle meets a box: nearest point of the box within the radius."""
    s, w, n, e = box
    near_lat = F.least(F.greatest(lit(lat), lit(s)), lit(n))
    to_w, to_e = angle_between(lit(lon), lit(w)), angle_between(lit(lon), lit(e))
    near_lon = F.when(in_lon_range(lit(lon), lit(w), lit(e)), lon).when(to_w <= to_e, w).otherwise(e)
    return sphere_m(lat, lon, near_lat, near_lon) <= radius_m


# --- geocentric -----------------------------------------------------------------------------

def unit_xyz(lat: Column, lon: Column) -> Column:
    p, l = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(p) * F.cos(l)).alias("x"), (F.cos(p) * F.sin(l)).alias("y"), F.sin(p).alias("z"))


def xyz_to_geo(x: Column, y: Column, z: Column) -> Column:
    return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"),
                    F.degrees(F.atan2(y, x)).alias("lon"))


def great_circle_intersection(p1, p2, q1, q2) -> Column:
    """Struct(lat, lon) where two great circles cross, on the side nearer p1. Points are (lat, lon)."""
    def vec(p):
        a, b = F.radians(lit(p[0])), F.radians(lit(p[1]))
        return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)

    def cross(u, v):
        return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    a = vec(p1)
    n = cross(cross(a, vec(p2)), cross(vec(q1), vec(q2)))
    s = F.when(n[0] * a[0] + n[1] * a[1] + n[2] * a[2] < 0, -1.0).otherwise(1.0)
    zero = (F.abs(n[0]) + F.abs(n[1]) + F.abs(n[2])) < 1e-15
    return F.when(~zero, xyz_to_geo(n[0] * s, n[1] * s, n[2] * s))


def plane_line_intersection(p1, p2, q1, q2) -> Column:
    """Struct(x, y) where two planar lines cross; null when parallel. Points are (x, y)."""
    d = (lit(p2[0]) - p1[0]) * (lit(q2[1]) - q1[1]) - (lit(p2[1]) - p1[1]) * (lit(q2[0]) - q1[0])
    t = F.try_divide((lit(q1[0]) - p1[0]) * (lit(q2[1]) - q1[1]) - (lit(q1[1]) - p1[1]) * (lit(q2[0]) - q1[0]), d)
    return F.when(t.isNotNull(), F.struct((lit(p1[0]) + t * (lit(p2[0]) - p1[0])).alias("x"),
                                          (lit(p1[1]) + t * (lit(p2[1]) - p1[1])).alias("y")))


def gnomonic(lat, lon, lat0, lon0) -> Column:
    """Struct(x, y) in Earth radii on the plane touching at (lat0, lon0); null beyond the horizon."""
    p, p0 = F.radians(lit(lat)), F.radians(lit(lat0))
    dl = F.radians(lit(lon) - lit(lon0))
    c = F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(dl)
    return F.when(c > 0, F.struct(F.try_divide(F.cos(p) * F.sin(dl), c).alias("x"),
                                  F.try_divide(F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl), c).alias("y")))


# --- rhumb lines ----------------------------------------------------------------------------
# Fixed value: radius of the equal-area sphere, used for rhumb lines.
RHUMB_R = 6371007.1809


def rhumb(lat1, lon1, lat2, lon2) -> Column:
    """Struct(range_m, bearing_deg) along the line of constant bearing."""
    p1, p2 = F.radians(lit(lat1)), F.radians(lit(lat2))
    d = F.radians(lit(lon2) - lit(lon1))
    dx = F.when(d > math.pi, d - 2 * math.pi).when(d < -math.pi, d + 2 * math.pi).otherwise(d)
    dy = F.ln(F.tan(p2 / 2 + math.pi / 4) / F.tan(p1 / 2 + math.pi / 4))
    q = F.when(F.abs(p2 - p1) < math.sqrt(1e-15), F.cos(p1)).otherwise(F.try_divide(p2 - p1, dy))
    return F.struct((RHUMB_R * F.sqrt(q * q * dx * dx + (p2 - p1) * (p2 - p1))).alias("range_m"),
                    F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0)).alias("bearing_deg"))


def rhumb_end(lat, lon, range_m, bearing_deg) -> Column:
    """Struct(lat, lon) reached along a line of constant bearing."""
    p1, h, r = F.radians(lit(lat)), F.radians(lit(bearing_deg)), lit(range_m) / RHUMB_R
    p2 = p1 + r * F.cos(h)
    dy = F.ln(F.tan(p2 / 2 + math.pi / 4) / F.tan(p1 / 2 + math.pi / 4))
    q = F.when(F.abs(p2 - p1) < math.sqrt(1e-15), F.cos(p1)).otherwise(F.try_divide(p2 - p1, dy))
    return F.struct(F.degrees(p2).alias("lat"),
                    normalize_lon(lit(lon) + F.degrees(r * F.sin(h) / q)).alias("lon"))


def sphere_end(lat, lon, range_m, bearing_deg) -> Column:
    """Struct(lat, lon) reached along a great circle."""
    p1, h, r = F.radians(lit(lat)), F.radians(lit(bearing_deg)), lit(range_m) / EARTH_R
    s2 = F.sin(p1) * F.cos(r) + F.cos(p1) * F.sin(r) * F.cos(h)
    dl = F.atan2(F.sin(h) * F.sin(r) * F.cos(p1), F.cos(r) - F.sin(p1) * s2)
    return F.struct(F.degrees(F.asin(s2)).alias("lat"),
                    normalize_lon(lit(lon) + F.degrees(dl)).alias("lon"))


def elevation_drop(distance_m) -> Column:
    """How far the surface falls below the tangent plane."""
    return lit(distance_m) * lit(distance_m) / (2 * CURVATURE_R)
