"""Range, area, bearing units and their report text."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .geo import lit

# Metres per unit, mils per degree.
METERS_PER = {"NM": 1852.0, "miles": 1609.344, "km": 1000.0, "m": 1.0, "yards": 0.9144, "ft": 0.3048}
MILS_PER_DEGREE = 17.777777777777777


def convert_range(m, unit: str) -> Column:
    return lit(m) / METERS_PER[unit]


def convert_area(m2, unit: str) -> Column:
    return lit(m2) / (METERS_PER[unit] * METERS_PER[unit])


def degrees_to_mils(deg) -> Column:
    return lit(deg) * MILS_PER_DEGREE


def mils_to_degrees(mils) -> Column:
    return lit(mils) / MILS_PER_DEGREE


def scaled_half_even(v, places: int) -> Column:
    """|v| * 10**places as a LONG, rounded by the exact binary value (Java rounds the printed decimal)."""
    a, b = F.abs(lit(v).cast("double")), float(10 ** places)
    c = a * 134217729.0
    hi = c - (c - a)
    p = a * b
    err = (hi * b - p) + (a - hi) * b
    n = F.floor(p)
    r = p - n
    up = (r > 0.5) | ((r == 0.5) & ((err > 0) | ((err == 0) & (n % 2 == 1))))
    return n + F.when(up, 1).otherwise(0)


def fixed(v, places: int, width: int = 0) -> Column:
    """C-style ``%0{width}.{places}f``."""
    n, unit = scaled_half_even(v, places), 10 ** places
    whole = F.floor(n / unit).cast("long") if places else n
    body = F.concat(whole.cast("string"), F.lit("."), F.lpad((n % unit).cast("string"), places, "0")) if places else whole.cast("string")
    neg = lit(v) < 0
    pad = F.when(neg, F.greatest(F.lit(width - 1), F.length(body))).otherwise(F.greatest(F.lit(width), F.length(body)))
    return F.concat(F.when(neg, "-").otherwise(""), F.lpad(body, pad, F.lit("0")))


def format_range(m, unit: str, places: int | None = None) -> Column:
    """Two places below 100, one below 1000, none above, unless given."""
    v = convert_range(m, unit)
    t = fixed(v, places) if places is not None else (
        F.when(v < 100, fixed(v, 2)).when(v < 1000, fixed(v, 1)).otherwise(fixed(v, 0)))
    return F.concat(t, F.lit(f" {unit}"))


def format_area(m2, unit: str) -> Column:
    return F.concat(fixed(convert_area(m2, unit), 0), F.lit(f" sq {unit}"))


def format_bearing(deg, style: str = "deg") -> Column:
    """deg, dm, dms (every field truncated) or mils."""
    d = lit(deg)
    if style == "mils":
        return F.concat(fixed(degrees_to_mils(d), 1, 6), F.lit("Mils "))
    if style == "deg":
        return F.concat(fixed(d, 1, 5), F.lit("°"))
    whole = F.floor(d)
    minutes = (d - whole) * 60
    if style == "dm":
        return F.concat(F.format_string("%03d° ", whole), fixed(minutes, 1, 4), F.lit("'"))
    return F.format_string("%03d° %02d' %02d\"", whole, F.floor(minutes), F.floor((minutes - F.floor(minutes)) * 60))


def true_to_magnetic(bearing, variation) -> Column:
    """Bearing less the variation, wrapped below 0 and above 360 (360 itself stays)."""
    b = lit(bearing) - lit(variation)
    return F.when(b < 0, b + 360.0).when(b > 360, b - 360.0).otherwise(b)


def leg_label(bearing, range_m, unit: str, style: str = "deg", magnetic: bool = False) -> Column:
    return F.concat(F.lit(" "), format_bearing(bearing, style), F.lit("M / " if magnetic else "T / "), format_range(range_m, unit), F.lit(" "))
