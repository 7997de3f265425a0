"""AIS sentences as Columns: TAG block, fields, 6-bit payloads, message layouts, kinds and CPA."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .geo import EARTH_R, lit, pinned
from .nmea import KNOT, checksum

# MMSI ranges by kind; kinds that stay where they are.
MMSI_KINDS = [(970000000, 970999999, "sart"), (972000000, 972999999, "mob"), (974000000, 974999999, "epirb"), (111000000, 111999999, "sar aircraft"),
              (990000000, 999999999, "aid to navigation"), (1000000, 9999999, "base station")]
FIXED_KINDS = ["aid to navigation", "base station"]


def split_tag(line: Column) -> Column:
    """Struct(tag, sentence): a leading \\...\\ block apart from the sentence."""
    has = line.startswith("\\")
    tag = F.when(has, F.regexp_extract(line, r"^\\([^\\]*)\\", 1))
    return F.struct(tag.alias("tag"), F.when(has, F.regexp_replace(line, r"^\\[^\\]*\\", "")).otherwise(line).alias("sentence"))


def tag_ok(tag: Column) -> Column:
    body = F.split_part(tag, F.lit("*"), F.lit(1))
    return F.upper(F.split_part(tag, F.lit("*"), F.lit(2))) == checksum(body)


def tag_time(tag: Column) -> Column:
    """Seconds of the ``c:`` field of a valid TAG block (milliseconds accepted)."""
    v = F.regexp_extract(tag, r"(?:^|,)c:(\d+)", 1).try_cast("double")
    return F.when(tag_ok(tag), F.when(v > 4e10, v / 1000).otherwise(v))


def is_vdm(s: Column) -> Column:
    return s.rlike(r"^[!$]..VD[MO]")


def sentence_ok(s: Column) -> Column:
    body = F.substring(F.split_part(s, F.lit("*"), F.lit(1)), 2, 400)
    given = F.upper(F.regexp_extract(s, r"\*([0-9A-Fa-f]{2})", 1))
    return is_vdm(s) & (given == checksum(body))


def line_class(line: Column) -> Column:
    """ais, gps or ignored."""
    s = split_tag(line)["sentence"]
    return F.when(is_vdm(s), "ais").when(s.rlike(r"^\$..(RMC|GGA|GLL|VTG|HDT)"), "gps").otherwise("ignored")


def sentence_fields(s: Column) -> Column:
    """Struct(talker, own, count, number, seq_id, channel, payload, fill)."""
    f = F.split(F.split_part(s, F.lit("*"), F.lit(1)), ",")

    def at(i):
        return F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    return F.struct(F.substring(at(0), 2, 2).alias("talker"), at(0).endswith("O").alias("own"), at(1).try_cast("int").alias("count"), at(2).try_cast("int").alias("number"),
                    at(3).alias("seq_id"), at(4).alias("channel"), at(5).alias("payload"), F.coalesce(at(6).try_cast("int"), F.lit(0)).alias("fill"))


def payload_bits(payload: Column, fill: Column) -> Column:
    """The payload as a text of 0 and 1, fill bits off the end; null when a character is out of range."""
    ok = payload.rlike("^[0-W`-w]+$")
    chars = F.filter(F.split(payload, ""), lambda c: c != "")
    six = F.transform(chars, lambda c: F.lpad(F.conv((F.ascii(c) - 48 - F.when(F.ascii(c) > 87, 8).otherwise(0)).cast("string"), 10, 2), 6, "0"))
    bits = F.array_join(six, "")
    return F.when(ok, F.substring(bits, F.lit(1), F.length(bits) - fill))


def u(bits: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(F.rpad(bits, 512, "0"), start + 1, n), 2, 10).cast("long")


def s(bits: Column, start: int, n: int) -> Column:
    v = u(bits, start, n)
    return F.when(v >= 2 ** (n - 1), v - 2 ** n).otherwise(v)


def text(bits: Column, start: int, chars: int) -> Column:
    """Six-bit text: stops at @, ends trimmed."""
    idx = F.sequence(F.lit(0), F.lit(chars - 1))
    code = F.transform(idx, lambda i: F.conv(F.substring(bits, (i * 6 + start + 1).cast("int"), F.lit(6)), 2, 10).cast("int"))
    t = F.array_join(F.transform(code, lambda v: F.when(v.isNull() | (v == 0), "@").otherwise(F.char(F.when(v < 32, v + 64).otherwise(v)))), "")
    return F.trim(F.split_part(t, F.lit("@"), F.lit(1)))


def decode(df: DataFrame, bits: str = "bits") -> DataFrame:
    """Adds message columns for types 1-5, 9, 18, 19, 21, 24 and 27; ``outcome`` says decoded, unsupported or error."""
    b = F.col(bits)
    d = df.withColumn("type", u(b, 0, 6).cast("int")).withColumn("mmsi", u(b, 8, 30))
    ty = F.col("type")
    a, cb = ty.isin(1, 2, 3), ty.isin(18, 19)
    raw = {  # column -> [(types, expression of the raw number)]
        "_lon": [(a | (ty == 9), s(b, 61, 28)), (ty == 4, s(b, 79, 28)), (cb, s(b, 57, 28)), (ty == 21, s(b, 164, 28)), (ty == 27, s(b, 44, 18) * 1000)],
        "_lat": [(a | (ty == 9), s(b, 89, 27)), (ty == 4, s(b, 107, 27)), (cb, s(b, 85, 27)), (ty == 21, s(b, 192, 27)), (ty == 27, s(b, 62, 17) * 1000)],
        "_sog": [(a, u(b, 50, 10)), (cb, u(b, 46, 10)), (ty == 9, u(b, 50, 10) * 10), (ty == 27, u(b, 79, 6) * 10)],
        "_cog": [(a | (ty == 9), u(b, 116, 12)), (cb, u(b, 112, 12)), (ty == 27, u(b, 85, 9) * 10)],
        "_hdg": [(a, u(b, 128, 9)), (cb, u(b, 124, 9))],
        "_nav": [(a, u(b, 38, 4)), (ty == 27, u(b, 40, 4))],
        "_rot": [(a, s(b, 42, 8))],
        "_ship": [(ty == 5, u(b, 232, 8)), (ty == 19, u(b, 263, 8)), (ty == 21, u(b, 38, 5)), ((ty == 24) & (u(b, 38, 2) == 1), u(b, 40, 8))],
        "_dim": [(ty == 5, u(b, 240, 30)), (ty == 19, u(b, 271, 30)), (ty == 21, u(b, 219, 30)), ((ty == 24) & (u(b, 38, 2) == 1) & (F.floor(F.col("mmsi") / 10000000) != 98), u(b, 132, 30))],
        "_alt": [(ty == 9, u(b, 38, 12))],
        "_imo": [(ty == 5, u(b, 40, 30))], "_draught": [(ty == 5, u(b, 294, 8))]}
    for name, arms in raw.items():
        out = F.lit(None).cast("long")
        for cond, e in reversed(arms):
            out = F.when(cond, e).otherwise(out)
        d = d.withColumn(name, out)
    d = pinned(d, _raw=F.struct(*raw)).drop(*raw).select("*", "_raw.*").drop("_raw")
    name = F.when(ty == 5, text(b, 112, 20)).when(ty == 19, text(b, 143, 20)).when(ty == 21, F.concat(text(b, 43, 20), text(b, 272, 14))).when((ty == 24) & (u(b, 38, 2) == 0), text(b, 40, 20))
    call = F.when(ty == 5, text(b, 70, 7)).when((ty == 24) & (u(b, 38, 2) == 1), text(b, 90, 7))
    d = d.withColumn("name", name).withColumn("call_sign", call).withColumn("destination", F.when(ty == 5, text(b, 302, 20)))
    c = F.col
    ok = (F.abs("_lon") <= 108000000) & (F.abs("_lat") <= 54000000)
    sog_na = F.when(ty == 9, c("_sog") == 10230).when(ty == 27, c("_sog") == 630).otherwise(c("_sog") == 1023)
    rot = c("_rot")
    turn = F.pow(rot / 4.733, 2) * F.signum(rot.cast("double"))
    known = ty.isin(1, 2, 3, 4, 5, 9, 18, 19, 21, 27) | ((ty == 24) & u(b, 38, 2).isin(0, 1))
    outcome = F.when(b.isNull() | (F.length(b) < 38), "error").when(known, "decoded").when(ty == 24, "error").otherwise("unsupported")
    d = d.withColumn("lat", F.when(ok, c("_lat") / 600000.0)).withColumn("lon", F.when(ok, c("_lon") / 600000.0))
    d = d.withColumn("sog_mps", F.when(~sog_na, c("_sog") / 10.0 * KNOT)).withColumn("cog_deg", F.when(c("_cog") < 3600, c("_cog") / 10.0))
    d = d.withColumn("heading_deg", F.when(c("_hdg") <= 359, c("_hdg")).cast("int")).withColumn("nav_status", F.when(c("_nav") != 15, c("_nav")).cast("int"))
    d = d.withColumn("rot_deg_min", F.when(~rot.isin(127, -127, -128), turn)).withColumn("turn_indicator", F.when(rot == 127, 1).when(rot == -127, -1))
    d = d.withColumn("ship_type", F.when(c("_ship") != 0, c("_ship")).cast("int")).withColumn("imo", F.when(c("_imo") != 0, c("_imo")))
    d = d.withColumn("draught_m", F.when(c("_draught") != 0, c("_draught") / 10.0)).withColumn("altitude_m", F.when(c("_alt") != 4095, c("_alt")).cast("int"))
    dim = c("_dim")
    d = d.withColumn("dims", F.when(dim != 0, F.struct(F.shiftright(dim, 21).cast("int").alias("bow"), (F.shiftright(dim, 12) % 512).cast("int").alias("stern"),
                                                       (F.shiftright(dim, 6) % 64).cast("int").alias("port"), (dim % 64).cast("int").alias("starboard"))))
    return d.withColumn("outcome", outcome).drop(*raw)


def kind_from_mmsi(mmsi: Column) -> Column:
    out = F.lit("vessel")
    for lo, hi, k in reversed(MMSI_KINDS):
        out = F.when(mmsi.between(lo, hi), k).otherwise(out)
    return out


def ship_type_text(t: Column) -> Column:
    """The tens digit names the family; a few codes have their own word."""
    own = {30: "Fishing", 31: "Towing", 32: "Towing", 33: "Dredging", 34: "Diving", 35: "Military", 36: "Sailing", 37: "Pleasure craft", 50: "Pilot", 51: "Search and rescue", 52: "Tug", 53: "Port tender", 55: "Law enforcement", 58: "Medical"}
    tens = {2: "Wing in ground", 4: "High speed craft", 6: "Passenger", 7: "Cargo", 8: "Tanker", 9: "Other"}
    out = F.lit("Unknown")
    for k, v in tens.items():
        out = F.when(F.floor(t / 10) == k, v).otherwise(out)
    for k, v in own.items():
        out = F.when(t == k, v).otherwise(out)
    return out


def with_cpa(df: DataFrame, now: str = "now") -> DataFrame:
    """Adds range_m, bearing_deg, cpa_m, tcpa_s for rows with own_* and target columns lat, lon, sog_mps, cog_deg, kind, t.

    A moving target is carried on from its position time; a fixed one is not; a target whose motion is
    unknown gets range and bearing only.
    """
    c = F.col
    fixed = c("kind").isin(*FIXED_KINDS)
    moving = ~fixed & (c("sog_mps") > 0)
    known = fixed | F.coalesce((c("sog_mps") == 0) | (moving & c("cog_deg").isNotNull()), F.lit(False))
    d = df.withColumn("_k", known).withColumn("_te", F.when(moving & c("_k"), c("sog_mps") * F.sin(F.radians("cog_deg"))).otherwise(0.0))
    d = d.withColumn("_tn", F.when(moving & c("_k"), c("sog_mps") * F.cos(F.radians("cog_deg"))).otherwise(0.0))
    dt = F.when(c("_k") & (c(now) > c("t")), c(now) - c("t")).otherwise(0.0)
    d = d.withColumn("_dt", dt).withColumn("_la", c("lat") + F.degrees(c("_tn") * c("_dt") / EARTH_R))
    d = d.withColumn("_lo", c("lon") + F.degrees(c("_te") * c("_dt") / (EARTH_R * F.cos(F.radians("_la")))))
    dl = c("_lo") - c("own_lon")
    d = d.withColumn("_dl", F.when(dl > 180, dl - 360).when(dl < -180, dl + 360).otherwise(dl))
    d = d.withColumn("_px", F.radians("_dl") * F.cos(F.radians((c("_la") + c("own_lat")) / 2)) * EARTH_R).withColumn("_py", F.radians(c("_la") - c("own_lat")) * EARTH_R)
    own = c("own_speed").isNotNull() & c("own_heading").isNotNull()
    d = d.withColumn("_wx", c("_te") - F.when(own, c("own_speed") * F.sin(F.radians("own_heading"))).otherwise(0.0))
    d = d.withColumn("_wy", c("_tn") - F.when(own, c("own_speed") * F.cos(F.radians("own_heading"))).otherwise(0.0)).withColumn("_w2", c("_wx") * c("_wx") + c("_wy") * c("_wy"))
    rng = F.sqrt(c("_px") * c("_px") + c("_py") * c("_py"))
    tc = F.when(c("_w2") < 1e-12, 0.0).otherwise(F.try_divide(-(c("_px") * c("_wx") + c("_py") * c("_wy")), c("_w2")))
    d = d.withColumn("range_m", rng).withColumn("bearing_deg", F.pmod(F.degrees(F.atan2("_px", "_py")), F.lit(360.0))).withColumn("tcpa_s", F.when(c("_k"), tc))
    x, y = c("_px") + c("_wx") * c("tcpa_s"), c("_py") + c("_wy") * c("tcpa_s")
    d = d.withColumn("cpa_m", F.explode(F.array(F.when(c("_w2") < 1e-12, F.when(c("_k"), c("range_m"))).otherwise(F.sqrt(x * x + y * y)))))
    return d.drop("_k", "_te", "_tn", "_dt", "_la", "_lo", "_dl", "_px", "_py", "_wx", "_wy", "_w2")


# --- building (fixtures and replays) ---------------------------------------------------------

def bit_text(v: Column, n: int) -> Column:
    """n bits of a whole number, two's complement when negative."""
    return F.lpad(F.conv(F.when(v < 0, v + 2 ** n).otherwise(v).cast("long").cast("string"), 10, 2), n, "0")


def text_bits(t: Column, chars: int) -> Column:
    padded = F.rpad(t, chars, "@")
    cs = F.filter(F.split(padded, ""), lambda c: c != "")
    return F.array_join(F.transform(cs, lambda c: F.lpad(F.conv((F.ascii(c) % 64).cast("string"), 10, 2), 6, "0")), "")


def armour(bits: Column) -> Column:
    """Bits (a multiple of six) to payload characters."""
    n = (F.length(bits) / 6).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1),
                                    lambda i: _armour_char(F.conv(F.substring(bits, (i * 6 + 1).cast("int"), F.lit(6)), 2, 10).cast("int"))), "")


def _armour_char(v: Column) -> Column:
    return F.char(v + F.when(v > 39, 56).otherwise(48))


def vdm(payload: Column, count: int = 1, number: int = 1, seq_id: str = "", channel: str = "A", fill: Column | int = 0) -> Column:
    body = F.concat(F.lit(f"AIVDM,{count},{number},{seq_id},{channel},"), payload, F.lit(","), lit(fill).cast("string"))
    return F.concat(F.lit("!"), body, F.lit("*"), checksum(body))
