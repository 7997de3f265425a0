"""Tracks: cleaning, motion, trip statistics and state at a time.

Fixes: track, seq, t (seconds, may be null), lat, lon, speed (may be null). Every operator takes the
chunk width used to spread a long track over tasks (see ``ordered``).
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo, geodesy
from ..session import cut_lineage
from .ordered import Ordered, fold, time_chunk
from .spatial import nearest_segment

SEQ_CHUNK = 2000
TIME_CHUNK = 86400.0


def by_seq(df: DataFrame, size: int = SEQ_CHUNK, keys=("track",)) -> Ordered:
    return Ordered(df, list(keys), ["seq"], F.floor(F.col("seq") / size))


def drop_non_monotonic(df: DataFrame, size: int = SEQ_CHUNK) -> DataFrame:
    """Drop a fix not later than the last kept one. An untimed fix is kept and forgets the comparison.

    Within a run between untimed fixes the last kept time is the largest so far, so a running maximum
    settles it; the run number is mixed into the maximum so one pass serves all runs.
    """
    o = by_seq(df, size).islands(F.col("t").isNull(), "_run")
    top = F.when(F.col("t").isNotNull(), F.struct("_run", "t"))
    o = o.running(maxima={"_top": top}, inclusive=False)
    stale = F.coalesce((F.col("_top._run") == F.col("_run")) & (F.col("t") <= F.col("_top.t")), F.lit(False))
    return o.result().filter(F.col("t").isNull() | ~stale).drop("_run", "_top")


def split_at_gaps(df: DataFrame, gap_s: float, size: int = SEQ_CHUNK) -> DataFrame:
    """Number the segments of each track: a new one starts after a time gap above ``gap_s``."""
    o = by_seq(df, size).previous(t=F.col("t"))
    cut = F.coalesce(F.col("t") - F.col("prev_t") > gap_s, F.lit(False)) | F.col("is_first")
    return o.islands(cut, "segment").result().drop("prev_t", "is_first")


def derive_motion(df: DataFrame, size: int = SEQ_CHUNK, keys=("track",)) -> DataFrame:
    """Speed from the previous fix and heading toward the next; reported speed wins; the last fix repeats
    the heading before it. Distances are ellipsoidal."""
    o = by_seq(df, size, keys).previous(t=F.col("t"), lat=F.col("lat"), lon=F.col("lon"))
    o = o._with(o.df.withColumn("_b", geodesy.range_bearing("prev_lat", "prev_lon", "lat", "lon")))
    o = o.following(bearing=F.col("_b.bearing_deg"))
    dt = F.col("t") - F.col("prev_t")
    speed = F.coalesce("speed", F.when((dt > 0) & ~F.col("is_first"), F.try_divide(F.col("_b.range_m"), dt)))
    heading = F.when(F.col("is_last"), F.when(~F.col("is_first"), F.col("_b.bearing_deg"))).otherwise(F.col("next_bearing"))
    return o.result().withColumn("speed_mps", speed).withColumn("heading_deg", geo.normalize_heading(heading)).withColumn(
        "heading_deg", F.when(F.col("is_first") & F.col("is_last"), None).otherwise(F.col("heading_deg"))).withColumn(
        "step_m", F.when(F.col("is_first"), 0.0).otherwise(F.col("_b.range_m"))).drop(
        "prev_t", "prev_lat", "prev_lon", "_b", "next_bearing", "is_first", "is_last")


def replayable(df: DataFrame, size: int = SEQ_CHUNK) -> DataFrame:
    """Positioned fixes in strictly rising time; a track with no times at all gets a 1 s clock."""
    d = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    timed = d.groupBy("track").agg(F.max(F.col("t").isNotNull()).alias("_timed"))
    o = by_seq(d, size).running(sums={"_n": F.lit(1).cast("long")}, maxima={"_before": F.col("t")}, inclusive=False)
    o = o.result().join(timed, "track")
    keep = ~F.col("_timed") | (F.col("t").isNotNull() & (F.col("_before").isNull() | (F.col("t") > F.col("_before"))))
    clock = F.when(F.col("_timed"), F.col("t")).otherwise(F.col("_n").cast("double"))
    return o.filter(keep).withColumn("t", clock).drop("_timed", "_n", "_before")


def path_lengths(df: DataFrame, size: int = SEQ_CHUNK, keys=("track",)) -> DataFrame:
    """Per vertex: leg range and bearing to it, and the distance so far (ellipsoidal)."""
    o = by_seq(df, size, keys).previous(lat=F.col("lat"), lon=F.col("lon"))
    o = o._with(o.df.withColumn("_b", geodesy.range_bearing("prev_lat", "prev_lon", "lat", "lon"))
                .withColumn("range_m", F.when(F.col("is_first"), 0.0).otherwise(F.col("_b.range_m")))
                .withColumn("bearing_deg", F.when(~F.col("is_first"), F.col("_b.bearing_deg"))))
    return o.running(sums={"cumulative_m": F.col("range_m")}).result().drop("prev_lat", "prev_lon", "_b", "is_first")


def bracket(probe: DataFrame, fixes: DataFrame, keys: list[str], t: str, width_s: float, values: list[str], chunk=None) -> DataFrame:
    """For each probe row the fix at or before its time and the first one after: structs ``a`` and ``b``."""
    pcols = [c for c in probe.columns if c not in keys and c != t]
    v = F.struct(F.col(t).alias("t"), *values)
    p = probe.select(*keys, t, F.lit(1).alias("_side"), F.struct(*pcols).alias("_p"))
    q = fixes.select(*keys, t, F.lit(0).alias("_side"), v.alias("_v"))
    u = p.unionByName(q, allowMissingColumns=True)
    o = Ordered(u, keys, [t, "_side"], chunk(F.col(t)) if chunk else time_chunk(F.col(t), width_s))
    o = o.running(lasts={"a": F.col("_v")}).running(lasts={"b": F.col("_v")}, reverse=True)
    return o.result().filter(F.col("_side") == 1).select(*keys, t, "_p.*", "a", "b")


def state_at(probe: DataFrame, fixes: DataFrame, width_s: float = TIME_CHUNK) -> DataFrame:
    """Track state at each probe time: before, during or after; interpolated between the bracketing fixes."""
    j = bracket(probe, fixes, ["track"], "t", width_s, ["lat", "lon", "alt", "speed"])
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    inside = a.isNotNull() & b.isNotNull()
    u = (t - a.t) / (b.t - a.t)
    phase = F.when(a.isNull(), "before").when(b.isNull() & (t > a.t), "after").otherwise("during")

    def mix(f):
        end = F.when(a.isNull(), b[f]).otherwise(a[f])
        both = a[f].isNotNull() & b[f].isNotNull()
        return F.when(inside & both, a[f] + u * (b[f] - a[f])).otherwise(end)
    return j.withColumn("phase", phase).select("track", "t", *[c for c in probe.columns if c not in ("track", "t")], "phase",
                                               mix("lat").alias("lat"), mix("lon").alias("lon"), mix("alt").alias("alt"), mix("speed").alias("speed"),
                                               F.when(inside, geo.bearing(a.lat, a.lon, b.lat, b.lon)).alias("bearing_deg"))


# --- ordered folds ----------------------------------------------------------------------------

TRIP_STATE = "lat double, lon double, t double, odometer double, speed double, avg double, avg_t double, seen boolean"
TRIP_OUT = "track long, seq long, odometer_m double, speed_mps double, average_mps double"


def trip_step(min_move_m: float, tau_s: float):
    """Odometer that moves its anchor only past the floor, with derived and smoothed speed."""
    def step(state, pdf):
        import pandas as pd
        lat, lon, t, odo, spd, avg, avg_t, seen = state
        out = []
        for r in pdf.itertuples(index=False):
            rt = None if r.t != r.t or r.t is None else r.t
            rs = None if r.speed is None or r.speed != r.speed else r.speed
            if not seen:
                lat, lon, t, seen = r.lat, r.lon, rt, True
            else:
                d = geodesy.inverse_m(lat, lon, r.lat, r.lon)
                dt = None if t is None or rt is None else rt - t
                if d >= min_move_m:
                    odo += d
                    lat, lon, t = r.lat, r.lon, rt
                if rs is None and dt is not None and dt > 0:
                    spd = d / dt
            if rs is not None:
                spd = rs
            if spd is not None:
                if avg is None or avg_t is None or rt is None:
                    avg = spd
                elif rt > avg_t:
                    avg += (1 - math.exp(-(rt - avg_t) / max(tau_s, 1e-9))) * (spd - avg)
                if rt is not None:
                    avg_t = rt
            out.append((r.track, r.seq, odo, spd, avg))
        return (lat, lon, t, odo, spd, avg, avg_t, seen), pd.DataFrame(out, columns=["track", "seq", "odometer_m", "speed_mps", "average_mps"])
    return step


def trip(df: DataFrame, min_move_m: float = 2.0, tau_s: float = 30.0, size: int = SEQ_CHUNK) -> DataFrame:
    """Odometer, speed and smoothed speed after every fix."""
    return fold(df.select("track", "seq", "t", "lat", "lon", "speed"), ["track"], ["seq"], F.floor(F.col("seq") / size),
                TRIP_STATE, TRIP_OUT, trip_step(min_move_m, tau_s), lambda: (None, None, None, 0.0, None, None, None, False))


def thin_step(min_gap_s: float):
    def step(state, pdf):
        lat, lon, t = state
        keep = []
        for r in pdf.itertuples(index=False):
            moved = lat is None or r.lat != lat or r.lon != lon
            ok = t is None or (r.t - t >= min_gap_s and moved)
            keep.append(ok)
            if ok:
                lat, lon, t = r.lat, r.lon, r.t
        return (lat, lon, t), pdf[keep][["track", "seq", "t", "lat", "lon"]]
    return step


def thin_trail(df: DataFrame, min_gap_s: float = 10.0, max_points: int = 120, max_age_s: float = 1800.0, size: int = SEQ_CHUNK) -> DataFrame:
    """Trail points at least 10 s apart and moved; then at most 120, at most 1800 s before the newest fix."""
    kept = fold(df.select("track", "seq", "t", "lat", "lon"), ["track"], ["seq"], F.floor(F.col("seq") / size),
                "lat double, lon double, t double", "track long, seq long, t double, lat double, lon double",
                thin_step(min_gap_s), lambda: (None, None, None))
    last = df.groupBy("track").agg(F.max("t").alias("_now"))
    o = by_seq(kept.join(last, "track").filter(F.col("t") >= F.col("_now") - max_age_s), size)
    o = o.running(sums={"_from_end": F.lit(1).cast("long")}, reverse=True)
    return o.result().filter(F.col("_from_end") <= max_points).drop("_now", "_from_end")


def derived_heading(df: DataFrame, size: int = SEQ_CHUNK, reported: str | None = None) -> DataFrame:
    """Heading of each fix: the one it reports (column ``reported``), else the bearing from the fix before if that lies elsewhere, else the last known one."""
    o = by_seq(df, size).previous(lat=F.col("lat"), lon=F.col("lon"))
    moved = ~F.col("is_first") & ((F.col("lat") != F.col("prev_lat")) | (F.col("lon") != F.col("prev_lon")))
    h = F.when(moved, geo.bearing(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon")))
    if reported:
        h = F.coalesce(F.col(reported), h)
    return o.running(lasts={"heading_deg": h}).result().drop("prev_lat", "prev_lon", "is_first").withColumn(
        "known", F.col("heading_deg").isNotNull()).withColumn("heading_deg", F.coalesce("heading_deg", F.lit(0.0)))


def remaining_on_route(fixes: DataFrame, route: DataFrame, first_radius_m: float = 2000.0) -> DataFrame:
    """Metres left along a route (vertices n, lat, lon) from the nearest place on it.

    Fixes are matched by the nearest-segment join within a radius; those with nothing in reach are
    tried again with a radius eight times as large, so no fix meets every segment of the route.
    """
    legs = Ordered(route.withColumn("g", F.lit(0)).withColumn("seq", F.col("n")), ["g"], ["seq"], F.floor(F.col("seq") / 10000)).following(
        lat=F.col("lat"), lon=F.col("lon")).result().filter(~F.col("is_last"))
    legs = legs.withColumn("len", geo.sphere_m(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon")))
    tail = Ordered(legs.drop("is_last"), ["g"], ["seq"], F.floor(F.col("seq") / 10000)).running(sums={"rest": F.col("len")}, reverse=True).result()
    segs = cut_lineage(tail.select(F.col("n").alias("seg"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.col("next_lat").alias("blat"), F.col("next_lon").alias("blon"), "rest"))
    left = fixes.select(F.struct("track", "seq").alias("pid"), "lat", "lon")
    radius, out = first_radius_m, None
    while radius < 2.1e7:
        hit = cut_lineage(nearest_segment(left, segs.drop("rest"), radius))
        out = hit if out is None else out.unionByName(hit)
        left = cut_lineage(left.join(hit.select("pid"), "pid", "left_anti"))
        if left.isEmpty():
            break
        radius *= 8
    return out.join(segs.select("seg", "rest"), "seg").select("pid.track", "pid.seq", F.col("seg").alias("leg"), (F.col("rest") - F.col("along_m")).alias("remaining_m"), F.col("distance_m").alias("off_m"))


def densify(df: DataFrame, step_m: float, size: int = SEQ_CHUNK, keys=("track",)) -> DataFrame:
    """Vertices kept, each longer leg cut into equal parts no longer than the step."""
    o = by_seq(df.select(*keys, "seq", "lat", "lon"), size, keys).previous(lat=F.col("lat"), lon=F.col("lon")).result()
    o = o.withColumn("_b", geodesy.range_bearing("prev_lat", "prev_lon", "lat", "lon"))
    n = F.when(F.col("is_first"), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("_b.range_m") / step_m))).cast("int")
    o = o.withColumn("_n", n).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    e = geodesy.end_point("prev_lat", "prev_lon", F.col("_b.range_m") * F.col("part") / F.col("_n"), F.col("_b.bearing_deg"))
    o = o.withColumn("_e", e)
    end = F.col("part") == F.col("_n")
    return o.select(*keys, "seq", "part", F.when(end, F.col("lat")).otherwise(F.col("_e.lat")).alias("lat"),
                    F.when(end, F.col("lon")).otherwise(F.col("_e.lon")).alias("lon"), end.alias("is_vertex"))


def runs(df: DataFrame, keys: list[str], same: list[str], sums: dict[str, Column], size: int = SEQ_CHUNK) -> DataFrame:
    """Consecutive rows (by seq) with equal ``same`` columns as one row each, with sums."""
    o = by_seq(df, size, keys).previous(**{c: F.col(c) for c in same})
    change = F.col("is_first")
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    r = o.islands(change, "run").result()
    return r.groupBy(*keys, "run", *same).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), *[c.alias(n) for n, c in sums.items()])


def path_area(df: DataFrame, size: int = SEQ_CHUNK, keys=("track",)) -> DataFrame:
    """Area of each vertex ring on the plane about its first vertex; fewer than three vertices give 0."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct("lat", "lon"), "seq").alias("_o"), F.count("*").alias("_n"))
    d = df.join(first, list(keys)).withColumn("_b", geodesy.range_bearing("_o.lat", "_o.lon", "lat", "lon"))
    a = F.radians("_b.bearing_deg")
    d = d.withColumn("_x", F.col("_b.range_m") * F.sin(a)).withColumn("_y", F.col("_b.range_m") * F.cos(a))
    o = by_seq(d, size, keys).previous(x=F.col("_x"), y=F.col("_y")).result()
    cross = F.col("prev_x") * F.col("_y") - F.col("_x") * F.col("prev_y")
    return o.groupBy(*keys).agg(F.when(F.max("_n") < 3, 0.0).otherwise(F.abs(F.coalesce(F.sum(cross), F.lit(0.0)) / 2)).alias("area_m2"))


def track_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("track").agg(F.count("*").alias("points"), F.min("seq").alias("first_seq"))


def longest_track(df: DataFrame) -> DataFrame:
    """The track with most points; the first in file order on ties."""
    return track_counts(df).agg(F.max_by(F.struct("track", "points"), F.struct("points", -F.col("first_seq"))).alias("m")).select("m.*")
