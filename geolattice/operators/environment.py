"""Tide, wind, sun and beach windows."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .ordered import Ordered, asof, time_chunk

YEAR = 365.25 * 86400


def half_cycles(extremes: DataFrame, width_s: float = YEAR) -> DataFrame:
    """Each extreme paired with the next of its station: t0, t1, ha, hb, rising."""
    o = Ordered(extremes, ["station"], ["t"], time_chunk(F.col("t"), width_s)).following(t=F.col("t"), h=F.col("height"), high=F.col("high"))
    return o.result().filter(~F.col("is_last")).select("station", F.col("t").alias("t0"), F.col("next_t").alias("t1"),
                                                       F.col("height").alias("ha"), F.col("next_h").alias("hb"), F.col("next_high").alias("rising"))


def check_extremes(extremes: DataFrame, width_s: float = YEAR) -> DataFrame:
    """Rows that break a tide table: same kind twice, times not rising, a high not above its low."""
    o = Ordered(extremes, ["station"], ["t", "ok"], time_chunk(F.col("t"), width_s)).previous(t=F.col("t"), h=F.col("height"), high=F.col("high")).result()
    low_high = F.when(F.col("high"), F.col("height") <= F.col("prev_h")).otherwise(F.col("height") >= F.col("prev_h"))
    err = F.when(F.col("is_first"), None).when(F.col("t") <= F.col("prev_t"), "time not rising").when(
        F.col("high") == F.col("prev_high"), "same kind twice").when(low_high, "high not above low")
    return o.withColumn("error", err).filter(F.col("error").isNotNull()).select("station", "ok", "error")


def tide_at(probe: DataFrame, extremes: DataFrame, width_s: float = YEAR) -> DataFrame:
    """Height and trend at each probe time; null outside the table. At an extreme the coming trend counts."""
    hc = half_cycles(extremes, width_s).withColumnRenamed("t0", "t")
    last = hc.groupBy("station").agg(F.max("t1").alias("_until"), F.max_by(F.struct("t", "t1", "ha", "hb", "rising"), "t1").alias("_last"))
    j = asof(probe, hc, ["station"], "t", width_s, ["t1", "ha", "hb", "rising"]).join(last, "station", "left")
    inside = F.col("asof_t").isNotNull() & (F.col("t") <= F.col("_until"))
    u = (F.col("t") - F.col("asof_t")) / (F.col("asof_t1") - F.col("asof_t"))
    w = (1 + F.cos(math.pi * u)) / 2
    rate = -0.5 * (F.col("asof_ha") - F.col("asof_hb")) * math.pi / (F.col("asof_t1") - F.col("asof_t")) * F.sin(math.pi * u) * 3600.0
    return j.select(*probe.columns, F.when(inside, F.col("asof_ha") * w + F.col("asof_hb") * (1 - w)).alias("height"),
                    F.when(inside, F.col("asof_rising")).alias("rising"), F.when(inside, rate).alias("rate_m_per_h"))


def below_spans(hc: DataFrame, threshold: Column | float) -> DataFrame:
    """The part of each half-cycle at or below the threshold; a mere touch is none."""
    th = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    k_fall = F.try_divide(th - F.col("hb"), F.col("ha") - F.col("hb"))
    k_rise = F.try_divide(F.col("hb") - th, F.col("hb") - F.col("ha"))
    falling = F.col("ha") > F.col("hb")

    def frac(k):
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * k - 1))) / math.pi
    u0 = F.when(falling & (k_fall < 1), frac(k_fall)).otherwise(0.0)
    u1 = F.when(~falling & (k_rise > 0), frac(k_rise)).otherwise(1.0)
    span = F.col("t1") - F.col("t0")
    return hc.filter(F.when(falling, k_fall > 0).otherwise(k_rise < 1)).select(
        "station", (F.col("t0") + u0 * span).alias("begin"), (F.col("t0") + u1 * span).alias("end"))


def merge_spans(spans: DataFrame, keys: list[str], width_s: float = YEAR, gap: float = 0.0) -> DataFrame:
    """Spans that touch (or lie within ``gap``) become one; empty ones go."""
    o = Ordered(spans, keys, ["begin", "end"], time_chunk(F.col("begin"), width_s)).running(maxima={"_upto": F.col("end")}, inclusive=False)
    new = F.col("_upto").isNull() | (F.col("begin") > F.col("_upto") + gap)
    r = o.islands(new, "_i").result()
    return r.groupBy(*keys, "_i").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).filter(F.col("end") > F.col("begin")).drop("_i")


def windows_below(extremes: DataFrame, threshold: float, width_s: float = YEAR) -> DataFrame:
    # rounding to the microsecond joins the two halves of one low water, which meet in the same extreme
    spans = below_spans(half_cycles(extremes, width_s), threshold)
    return merge_spans(spans.select("station", F.round("begin", 6).alias("begin"), F.round("end", 6).alias("end")), ["station"], width_s)


def next_window(probe: DataFrame, windows: DataFrame, need_s: float, horizon_s: float, width_s: float = YEAR) -> DataFrame:
    """Earliest start at or after each probe time, within the horizon, of a window still long enough.

    Windows of a station do not overlap, so the running one and the next long-enough one are all that
    can answer: two as-of lookups, no range join.
    """
    w = windows.select("station", F.col("begin").alias("t"), F.col("end").alias("wend"))
    now = asof(probe, w, ["station"], "t", width_s, ["wend"])
    long = w.filter(F.col("wend") - F.col("t") >= need_s)
    pcols = [c for c in now.columns if c not in ("station", "t")]
    p = now.select("station", "t", F.lit(0).alias("_side"), F.struct(*pcols).alias("_p"))
    q = long.select("station", "t", F.lit(1).alias("_side"), F.col("t").alias("_b"))
    o = Ordered(p.unionByName(q, allowMissingColumns=True), ["station"], ["t", "_side"], time_chunk(F.col("t"), width_s)).running(
        lasts={"_next": F.col("_b")}, reverse=True).result().filter(F.col("_side") == 0)
    begin = F.when(F.col("_p.asof_wend") - F.col("t") >= need_s, F.col("t")).when(F.col("_next") <= F.col("t") + horizon_s, F.col("_next"))
    return o.select("station", "t", *[F.col(f"_p.{c}").alias(c) for c in probe.columns if c not in ("station", "t")], begin.alias("begin"))


def beach_verdicts(stretches: DataFrame, extremes: DataFrame, good_below: float, rideable_below: float, margin_s: float, width_s: float = YEAR) -> DataFrame:
    """good, marginal, poor or unknown for each stretch (id, station, enter, exit)."""
    ends = stretches.select("id", "station", F.explode(F.array(F.struct(F.lit("a").alias("at"), F.col("enter").alias("t")),
                                                             F.struct(F.lit("b").alias("at"), (F.col("exit") + margin_s).alias("t")))).alias("x")).select("id", "station", "x.*")
    h = tide_at(ends, extremes, width_s).groupBy("id").agg(F.max(F.when(F.col("at") == "a", F.col("height"))).alias("ha"),
                                                          F.max(F.when(F.col("at") == "b", F.col("height"))).alias("hb"))
    # a high water inside a stretch is found by the hours the stretch spans (stretches are short)
    span = stretches.select("id", "station", "enter", (F.col("exit") + margin_s).alias("leave")).withColumn(
        "_hour", F.explode(F.sequence(F.floor(F.col("enter") / 3600), F.floor(F.col("leave") / 3600))))
    highs = extremes.filter("high").select("station", F.col("t").alias("_t"), F.col("height").alias("_h"), F.floor(F.col("t") / 3600).alias("_hour"))
    # hours and ends are exploded rows, which size estimates do not see: no side is broadcast
    top = span.join(highs.hint("merge"), ["station", "_hour"]).filter((F.col("_t") >= F.col("enter")) & (F.col("_t") <= F.col("leave"))).groupBy("id").agg(F.max("_h").alias("_top"))
    j = stretches.join(h.hint("merge"), "id").join(top.hint("merge"), "id", "left")
    peak = F.greatest("ha", "hb", F.coalesce(F.col("_top"), F.col("ha")))
    v = F.when(F.col("ha").isNull() | F.col("hb").isNull(), "unknown").when(peak > rideable_below, "poor").when(peak > good_below, "marginal").otherwise("good")
    return j.select("id", "station", F.col("ha").alias("enter_height"), F.when(F.col("hb").isNotNull(), peak).alias("peak"), v.alias("verdict"))


def forecast_at(probe: DataFrame, series: DataFrame, keys: list[str], width_s: float = YEAR) -> DataFrame:
    """Value of the half-open interval [begin, end) that holds each probe time, else null."""
    s = series.withColumnRenamed("begin", "t")
    j = asof(probe, s, keys, "t", width_s, ["end", "value"])
    return j.select(*probe.columns, F.when(F.col("t") < F.col("asof_end"), F.col("asof_value")).alias("value"))


def tailwind(speed: Column, from_deg: Column, heading: Column) -> Column:
    return speed * F.cos(F.radians(from_deg + 180.0 - heading))


def onshore(speed: Column, from_deg: Column, seaward: Column) -> Column:
    return speed * F.cos(F.radians(from_deg - seaward))


def seaward(heading: Column, faces: Column) -> Column:
    """The side of a heading (right or left normal) nearer to where the beach faces; right on ties."""
    right, left = F.pmod(heading + 90.0, F.lit(360.0)), F.pmod(heading + 270.0, F.lit(360.0))

    def gap(x):
        return F.abs(F.pmod(x - faces + 540.0, F.lit(360.0)) - 180.0)
    return F.when(gap(right) <= gap(left), right).otherwise(left)


# Zenith of sunrise and sunset; solar coefficients of the standard low-precision almanac.
ZENITH = 90.833


@F.pandas_udf(T.StructType().add("decl", "double").add("eot", "double"))
def _solar(t: pd.Series) -> pd.DataFrame:
    """Declination (radians) and equation of time (minutes) at epoch seconds."""
    c = ((t.to_numpy() / 86400.0 + 2440587.5) - 2451545.0) / 36525.0
    l0 = np.radians(np.fmod(280.46646 + c * (36000.76983 + c * 0.0003032), 360.0))
    m = np.radians(357.52911 + c * (35999.05029 - 0.0001537 * c))
    e = 0.016708634 - c * (0.000042037 + 0.0000001267 * c)
    om = np.radians(125.04 - 1934.136 * c)
    center = (np.sin(m) * (1.914602 - c * (0.004817 + 0.000014 * c)) + np.sin(2 * m) * (0.019993 - 0.000101 * c) + np.sin(3 * m) * 0.000289)
    lam = l0 + np.radians(center - 0.00569 - 0.00478 * np.sin(om))
    tilt = 23.0 + (26.0 + (21.448 - c * (46.815 + c * (0.00059 - c * 0.001813))) / 60.0) / 60.0
    eps = np.radians(tilt + 0.00256 * np.cos(om))
    y = np.tan(eps / 2) ** 2
    eot = (y * np.sin(2 * l0) - 2 * e * np.sin(m) + 4 * e * y * np.sin(m) * np.cos(2 * l0) - 0.5 * y * y * np.sin(4 * l0) - 1.25 * e * e * np.sin(2 * m))
    return pd.DataFrame({"decl": np.arcsin(np.sin(eps) * np.sin(lam)), "eot": 4.0 * np.degrees(eot)})


def _with_sun(df: DataFrame, at: Column, tag: str) -> DataFrame:
    d = df.withColumn("_at", at).withColumn("_sun", _solar(F.col("_at")))
    return d.withColumn(f"decl{tag}", F.col("_sun.decl")).withColumn(f"eot{tag}", F.col("_sun.eot")).drop("_sun", "_at")


def _event(df: DataFrame, tag: str) -> DataFrame:
    la, de = F.radians("lat"), F.col(f"decl{tag}")
    cos_h = math.cos(math.radians(ZENITH)) / (F.cos(la) * F.cos(de)) - F.tan(la) * F.tan(de)
    noon = 720.0 - 4.0 * F.col("lon") - F.col(f"eot{tag}")
    d = df.withColumn("_ch", cos_h)
    h = F.when(F.abs("_ch") <= 1, F.degrees(F.acos("_ch")))
    # one-element explode: filters on the time are not pushed back through the formula
    return d.withColumn(f"t{tag}", F.explode(F.array(F.col("day") * 86400.0 + (noon + F.when(F.col("rise"), -4.0).otherwise(4.0) * h) * 60.0))).drop("_ch")


def sun_events(places: DataFrame) -> DataFrame:
    """Sunrise and sunset between t0 and t1 for each (id, lat, lon, t0, t1); polar days give none."""
    days = F.sequence(F.floor(F.col("t0") / 86400) - 1, F.floor(F.col("t1") / 86400) + 1)
    d = places.withColumn("day", F.explode(days)).withColumn("rise", F.explode(F.array(F.lit(True), F.lit(False))))
    noon = F.col("day") * 86400.0 + (720.0 - 4.0 * F.col("lon")) * 60.0
    d = d.withColumnRenamed("t0", "_from").withColumnRenamed("t1", "_to")
    d = _event(_with_sun(d, noon, "a"), "a").filter(F.col("ta").isNotNull())
    d = _event(_with_sun(d, F.col("ta"), "b"), "b").filter(F.col("tb").isNotNull())
    return d.filter((F.col("tb") >= F.col("_from")) & (F.col("tb") <= F.col("_to"))).select("id", F.col("tb").alias("t"), "rise")


def sun_position(df: DataFrame) -> DataFrame:
    """Solar elevation and azimuth (degrees) for rows with lat, lon, t."""
    d = _with_sun(df, F.col("t"), "s")
    minutes = F.pmod(F.col("t"), F.lit(86400.0)) / 60.0 + F.col("eots") + 4.0 * F.col("lon")
    d = d.withColumn("_ha", F.radians(minutes / 4.0 - 180.0)).withColumn("_la", F.radians("lat"))
    sin_el = F.sin("_la") * F.sin("decls") + F.cos("_la") * F.cos("decls") * F.cos("_ha")
    az = F.atan2(F.sin("_ha"), F.cos("_ha") * F.sin("_la") - F.tan("decls") * F.cos("_la"))
    return d.withColumn("elevation_deg", F.degrees(F.asin(sin_el))).withColumn("azimuth_deg", F.pmod(F.degrees(az) + 180.0, F.lit(360.0))).drop("_ha", "_la", "decls", "eots")
