"""NMEA 0183 sentences as Columns: validity, fields, parsing and building."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .geo import lit, pinned

# Longest sentence, metres per second per knot and per km/h.
MAX_SENTENCE = 82
KNOT = 1852.0 / 3600.0


def checksum(body) -> Column:
    """Two hex digits of the exclusive-or of all characters."""
    codes = F.transform(F.filter(F.split(lit(body), ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.lpad(F.upper(F.hex(F.aggregate(codes, F.lit(0), lambda a, b: a.bitwiseXOR(b)))), 2, "0")


def looks_valid(line) -> Column:
    """Starts with $, at most 82 characters, and a right checksum when one is given."""
    c = lit(line)
    star = F.instr(c, "*")
    given = F.upper(F.regexp_extract(c, r"\*([0-9A-Fa-f]{2})", 1))
    body = F.substring(F.split_part(c, F.lit("*"), F.lit(1)), 2, 200)
    ok = F.when(star == 0, True).when(given == "", False).otherwise(given == checksum(body))
    return F.coalesce(c.startswith("$") & (F.length(c) <= MAX_SENTENCE) & ok, F.lit(False))


def sentence_type(line) -> Column:
    t = F.substring(lit(line), 4, 3)
    return F.when(lit(line).startswith("$") & t.isin("RMC", "GGA", "GLL", "VTG", "HDT"), t)


def fields(line) -> Column:
    """Field 0 is the talker and type."""
    return F.split(F.substring(F.split_part(lit(line), F.lit("*"), F.lit(1)), 2, 200), ",")


def _leading(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*([+-]?\d+\.?\d*)", 1).try_cast("double")


def degrees(field: Column, hemi: Column, limit: float) -> Column:
    """ddmm.mmmm and a hemisphere to signed degrees; null when out of range."""
    v = _leading(field)
    d = F.floor(v / 100)
    x = d + (v - d * 100) / 60
    s = F.when(F.upper(hemi).isin("S", "W"), -x).otherwise(x)
    return F.when((F.abs(s) <= limit) & (hemi != ""), s)


def day_seconds(field: Column) -> Column:
    ok = field.rlike(r"^\d{6}")
    return F.when(ok, F.substring(field, 1, 2).try_cast("int") * 3600 + F.substring(field, 3, 2).try_cast("int") * 60 + F.substring(field, 5, 20).try_cast("double"))


def with_reading(df: DataFrame, name: str = "r") -> DataFrame:
    """Adds ``parse`` of the ``line`` column; fields and checksum are worked out once per line."""
    d = pinned(df, _f=fields(F.col("line")), _ok=looks_valid(F.col("line")))
    return pinned(d, **{name: parse(F.col("line"), F.col("_f"), F.col("_ok"))}).drop("_f", "_ok")


def parse(line: Column, f: Column | None = None, valid: Column | None = None) -> Column:
    """Struct(type, lat, lon, speed_mps, heading_deg, magnetic_deg, tod_s, date, satellites, hdop, alt_m); null when unusable."""
    ty = sentence_type(line)
    f = fields(line) if f is None else f
    valid = looks_valid(line) if valid is None else valid

    def at(i):
        return F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    n = F.size(f)
    rmc, gga, gll, vtg, hdt = [ty == t for t in ("RMC", "GGA", "GLL", "VTG", "HDT")]

    def by(r=None, g=None, l=None, v=None, h=None):
        out = F.lit(None)
        for cond, x in ((rmc, r), (gga, g), (gll, l), (vtg, v), (hdt, h)):
            if x is not None:
                out = F.when(cond, x).otherwise(out)
        return out
    lat = by(degrees(at(3), at(4), 90.0), degrees(at(2), at(3), 90.0), degrees(at(1), at(2), 90.0))
    lon = by(degrees(at(5), at(6), 180.0), degrees(at(4), at(5), 180.0), degrees(at(3), at(4), 180.0))
    kn, kmh = _leading(at(5)), _leading(at(7))
    speed = by(_leading(at(7)) * KNOT, v=F.coalesce(F.when(at(6).startswith("N"), kn * KNOT), F.when(at(8).startswith("K"), kmh / 3.6)))
    course = _leading(at(8))
    var = _leading(at(10))
    mag = F.when(F.upper(F.substring(at(11), 1, 1)) == "E", F.when(course - var < 0, course - var + 360).otherwise(course - var)).otherwise(
        F.when(course + var > 360, course + var - 360).otherwise(course + var))
    heading = by(course, v=F.when(at(2).startswith("T"), _leading(at(1))), h=F.when(_leading(at(1)).between(0, 360), _leading(at(1))))
    magnetic = by(F.when((at(10) != "") & (at(11) != ""), mag), v=F.when(at(4).startswith("M"), _leading(at(3))))
    tod = by(day_seconds(at(1)), day_seconds(at(1)), day_seconds(at(5)))
    yy = F.substring(at(9), 5, 2).try_cast("int")
    date = F.when(rmc & at(9).rlike(r"^\d{6}"), F.make_date(F.when(yy > 70, 1900 + yy).otherwise(2000 + yy), F.substring(at(9), 3, 2).try_cast("int"), F.substring(at(9), 1, 2).try_cast("int")))
    sats = F.when(gga, _leading(at(7)).cast("int"))
    alt = F.when(gga & (sats > 3) & at(10).startswith("M"), _leading(at(9)))
    ok = (valid & ty.isNotNull()
          & F.when(rmc, (n >= 12) & ~at(2).startswith("V")).when(gga, (n >= 15) & ~at(6).startswith("0")).when(gll, (n >= 7) & ~at(6).startswith("V")).when(vtg, n >= 9).otherwise(n >= 2))
    st = F.struct(ty.alias("type"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), speed.cast("double").alias("speed_mps"), heading.cast("double").alias("heading_deg"),
                  magnetic.cast("double").alias("magnetic_deg"), tod.cast("double").alias("tod_s"), date.alias("date"), sats.alias("satellites"), F.when(gga, _leading(at(8))).alias("hdop"), alt.alias("alt_m"))
    positioned = lat.isNotNull() & lon.isNotNull()
    useful = F.when(vtg, speed.isNotNull() | heading.isNotNull() | magnetic.isNotNull()).when(hdt, heading.isNotNull()).otherwise(positioned)
    return F.when(ok & useful, st)


def _with_sum(body: Column) -> Column:
    return F.concat(F.lit("$"), body, F.lit("*"), checksum(body))


def _deg_text(v: Column, width: int, pos: str, neg: str) -> Column:
    # minutes in ten-thousandths, rounded once so that 60.0000 carries into the degree
    m = F.round(F.abs(v) * 600000).cast("long")
    d = F.floor(m / 600000)
    r = m - d * 600000
    return F.concat(F.lpad(d.cast("string"), width, "0"), F.lpad(F.floor(r / 10000).cast("string"), 2, "0"), F.lit("."), F.lpad((r % 10000).cast("string"), 4, "0"),
                    F.lit(","), F.when(v < 0, neg).otherwise(pos))


def tod_text(s: Column) -> Column:
    """hhmmss.sss of seconds in a day."""
    ms = F.round(s * 1000).cast("long")
    return F.concat(F.lpad(F.floor(ms / 3600000).cast("string"), 2, "0"), F.lpad((F.floor(ms / 60000) % 60).cast("string"), 2, "0"), F.lpad((F.floor(ms / 1000) % 60).cast("string"), 2, "0"),
                    F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def build_rmc(t: Column, lat: Column, lon: Column, speed_mps: Column, heading: Column) -> Column:
    day = F.timestamp_seconds(F.floor(t / 86400) * 86400)
    return _with_sum(F.concat(F.lit("GPRMC,"), tod_text(F.pmod(t, F.lit(86400.0))), F.lit(",A,"), _deg_text(lat, 2, "N", "S"), F.lit(","), _deg_text(lon, 3, "E", "W"), F.lit(","),
                              F.coalesce(F.format_string("%.3f", speed_mps / KNOT), F.lit("")), F.lit(","), F.coalesce(F.format_string("%.1f", heading), F.lit("")), F.lit(","),
                              F.date_format(day, "ddMMyy"), F.lit(",,")))


def build_gga(t: Column, lat: Column, lon: Column, sats: Column, hdop: Column, alt: Column) -> Column:
    return _with_sum(F.concat(F.lit("GPGGA,"), tod_text(F.pmod(t, F.lit(86400.0))), F.lit(","), _deg_text(lat, 2, "N", "S"), F.lit(","), _deg_text(lon, 3, "E", "W"), F.lit(",1,"),
                              F.lpad(sats.cast("string"), 2, "0"), F.lit(","), F.format_string("%.1f", hdop), F.lit(","), F.coalesce(F.format_string("%.1f", alt), F.lit("")), F.lit(",M,,M,,")))


def build_vtg(heading: Column, speed_mps: Column) -> Column:
    return _with_sum(F.concat(F.lit("GPVTG,"), F.format_string("%.1f", heading), F.lit(",T,,M,"), F.format_string("%.3f", speed_mps / KNOT), F.lit(",N,"), F.format_string("%.3f", speed_mps * 3.6), F.lit(",K")))
