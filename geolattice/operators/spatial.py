"""Bucket joins: boxes, nearest neighbours and radius candidates as equi joins on grid cells.

Hot cells: both sides of a cell join are dealt out by the cell for that join alone (no aggregate stands between), so
adaptive execution splits the partition of a crowded cell on either side, by its measured size. Settings in ``session``
switch this on.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo


def with_cells(df: DataFrame, box: tuple, size: float) -> DataFrame:
    """One row per grid cell a (s, w, n, e) box touches; crossing boxes are split at +-180 first."""
    part = df.withColumn("_part", F.explode(geo.box_parts(*[F.col(c) for c in box])))
    rows = F.sequence(F.floor(F.col("_part.s") / size), F.floor(F.col("_part.n") / size))
    cols = F.sequence(F.floor(F.col("_part.w") / size), F.floor(F.col("_part.e") / size))
    return (part.withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(cols)).drop("_part"))


def box_join(a: DataFrame, b: DataFrame, a_box: tuple, b_box: tuple, size: float, also: list[str] | None = None) -> DataFrame:
    """Pairs of overlapping boxes, each once: an equi join on cells, then the exact inclusive test.

    A pair meets in every shared cell; it is kept only in the lowest shared one of its first
    overlapping parts, so no distinct (and no shuffle for one) is needed. Columns must not collide, but for those
    named in ``also``, which must be equal and join the key.
    """
    def parts(df, box, tag):
        d = df.select("*", F.posexplode(geo.box_parts(*[F.col(c) for c in box])).alias(f"_i{tag}", f"_b{tag}"))
        bx = F.col(f"_b{tag}")
        return (d.withColumn("_row", F.explode(F.sequence(F.floor(bx.s / size), F.floor(bx.n / size))))
                .withColumn("_col", F.explode(F.sequence(F.floor(bx.w / size), F.floor(bx.e / size)))))
    j = parts(a, a_box, "a").join(parts(b, b_box, "b"), ["_row", "_col", *(also or [])])
    s, w = F.greatest("_ba.s", "_bb.s"), F.greatest("_ba.w", "_bb.w")
    hit = (s <= F.least("_ba.n", "_bb.n")) & (w <= F.least("_ba.e", "_bb.e"))
    home = (F.col("_row") == F.floor(s / size)) & (F.col("_col") == F.floor(w / size))
    j = j.filter(hit & home)
    # two crossing boxes overlap in both halves: keep the eastern-hemisphere half (part 0 of each)
    both = ((F.col(a_box[1]) > F.col(a_box[3])) & (F.col(b_box[1]) > F.col(b_box[3])))
    j = j.filter(~both | ((F.col("_ia") == 0) & (F.col("_ib") == 0)))
    # one crossing box against one plain box may still meet in both halves
    one = (F.col(a_box[1]) > F.col(a_box[3])) != (F.col(b_box[1]) > F.col(b_box[3]))
    east_too = F.when(F.col(a_box[1]) > F.col(a_box[3]), F.col(b_box[3]) >= F.col(a_box[1])
                      ).otherwise(F.col(a_box[3]) >= F.col(b_box[1]))
    second = (F.col("_ia") == 1) | (F.col("_ib") == 1)
    return j.filter(~(one & second & east_too)).drop("_row", "_col", "_ia", "_ba", "_ib", "_bb")


def _degrees(radius_m: float, lat: Column) -> Column:
    return radius_m / geo.plane_m_per_deg_lon(lat)


def radius_join(points: DataFrame, others: DataFrame, radius_m: float, lat: str, lon: str,
                box: tuple) -> DataFrame:
    """Candidate pairs: points whose radius box touches another row's (s, w, n, e) box.

    Cells are one radius tall; a point probes the cells under its circle box, and the other side is
    entered in the cells under its own box. The caller applies the exact distance.
    """
    size = max(radius_m / geo.M_PER_DEG, 1e-4)
    around = geo.box_around(F.col(lat), F.col(lon), radius_m)
    p = points.withColumn("_bx", around).select("*", F.col("_bx.s").alias("_ps"), F.col("_bx.w").alias("_pw"),
                                                F.col("_bx.n").alias("_pn"), F.col("_bx.e").alias("_pe")).drop("_bx")
    return box_join(p, others, ("_ps", "_pw", "_pn", "_pe"), box, size).drop("_ps", "_pw", "_pn", "_pe")


def nearest(points: DataFrame, targets: DataFrame, point_id: str, lat: str, lon: str, target_id: str,
            t_lat: str, t_lon: str, radius_m: float, levels: int = 6) -> DataFrame:
    """The nearest target within a radius, ties (to the micrometre) to the lowest id; unmatched points are left out.

    Each point is searched only on the finest grid level whose own cell already holds a target: that
    target bounds the distance by the cell diagonal, so the ring of cells within a diagonal holds the
    answer. Dense places are therefore searched in tiny cells and empty ones in large cells, and no
    cell pairs all of its points with all of its targets. Coincident targets collapse beforehand.
    """
    top = radius_m / geo.M_PER_DEG
    uniq = targets.groupBy(F.col(t_lat).alias("_tlat"), F.col(t_lon).alias("_tlon")).agg(F.min(target_id).alias("_tid"))
    pts = points.select(F.col(point_id).alias("_pid"), F.col(lat).alias("_plat"), F.col(lon).alias("_plon"))
    spots = pts.select("_plat", "_plon").distinct()

    def cell(c: Column, lv: Column) -> Column:
        return F.floor(c / (F.lit(top) * F.pow(F.lit(0.5), lv)))

    lv = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    t_cells = (uniq.withColumn("_lv", lv).withColumn("_row", cell(F.col("_tlat"), F.col("_lv")))
               .withColumn("_col", cell(F.col("_tlon"), F.col("_lv"))))
    occupied = t_cells.select("_lv", "_row", "_col").distinct()
    s_cells = (spots.withColumn("_lv", lv).withColumn("_row", cell(F.col("_plat"), F.col("_lv")))
               .withColumn("_col", cell(F.col("_plon"), F.col("_lv"))))
    if levels:
        home = (s_cells.join(occupied.withColumn("_occ", F.lit(1)), ["_lv", "_row", "_col"], "left")
                .groupBy("_plat", "_plon").agg(F.coalesce(F.max(F.when(F.col("_occ") == 1, F.col("_lv"))), F.lit(0)).alias("_lv")))
    else:
        home = spots.withColumn("_lv", F.lit(0))
    # a longitude degree is shorter than a latitude degree, so the ring in degrees widens with latitude
    size = F.lit(top) * F.pow(F.lit(0.5), F.col("_lv"))
    reach = F.when(F.col("_lv") > 0, 1.4143).otherwise(1.0)
    lon_reach = F.least(F.lit(180.0), size * reach / F.greatest(F.lit(1e-6), F.cos(F.radians(F.col("_plat")))))
    west, east = F.col("_plon") - lon_reach, F.col("_plon") + lon_reach
    spans = F.array(F.struct(west.alias("w"), east.alias("e")),
                    F.struct((west + 360).alias("w"), F.when(west < -180, 180.0).otherwise(east - 1e9).alias("e")),
                    F.struct(F.lit(-180.0).alias("w"), F.when(east > 180, east - 360).otherwise(F.lit(-1e9)).alias("e")))
    probe = (home.withColumn("_row", F.explode(F.sequence(F.floor((F.col("_plat") - size * reach) / size),
                                                          F.floor((F.col("_plat") + size * reach) / size))))
             .withColumn("_sp", F.explode(F.filter(spans, lambda x: x.w <= x.e)))
             .withColumn("_col", F.explode(F.sequence(F.floor(F.col("_sp.w") / size), F.floor(F.col("_sp.e") / size))))
             .drop("_sp"))
    d = geo.plane_m(F.col("_plat"), F.col("_plon"), F.col("_tlat"), F.col("_tlon"))
    best = (probe.join(t_cells, ["_lv", "_row", "_col"]).withColumn("_d", d).filter(F.col("_d") <= radius_m)
            .groupBy("_plat", "_plon").agg(F.min(F.struct(F.round("_d", 6).alias("_k"), "_tid", "_d")).alias("_m")))
    return (pts.join(best, ["_plat", "_plon"])
            .select(F.col("_pid").alias(point_id), F.col("_m._tid").alias(target_id), F.col("_m._d").alias("distance_m")))


def segment_cells(segs: DataFrame, top: float, levels: int) -> DataFrame:
    """Grid cells (of ``top`` degrees halved per level) under the pieces of each segment, a little padded."""
    size = F.lit(top) * F.pow(F.lit(0.5), F.col("_lv"))
    span = F.greatest(F.abs(F.col("blat") - F.col("alat")), F.abs(F.col("blon") - F.col("alon")))
    cut = (segs.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(levels))))
           .withColumn("_n", F.greatest(F.lit(1), F.ceil(span / size)).cast("int"))
           .withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))

    def at(a, b, k):
        return F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")
    la, lb = at("alat", "blat", F.col("_i")), at("alat", "blat", F.col("_i") + 1)
    oa, ob = at("alon", "blon", F.col("_i")), at("alon", "blon", F.col("_i") + 1)
    eps = 1e-9
    rows = F.sequence(F.floor((F.least(la, lb) - eps) / size), F.floor((F.greatest(la, lb) + eps) / size))
    cols = F.sequence(F.floor((F.least(oa, ob) - eps) / size), F.floor((F.greatest(oa, ob) + eps) / size))
    return (cut.withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(cols))
            .select("_lv", "_row", "_col", "seg", "alat", "alon", "blat", "blon").distinct())


def segments_in_radius(points: DataFrame, segs: DataFrame, radius_m: float) -> DataFrame:
    """Every (pid, seg) within the radius, each once, with its projection ``p``.

    A pair is kept only in the cell that holds the nearest point of the segment, which both sides are
    entered in, so no distinct over pairs is needed.
    """
    top = radius_m / geo.M_PER_DEG
    reach_lon = top / F.greatest(F.lit(1e-6), F.cos(F.radians(F.col("lat")))) + 1e-9
    probe = (points.withColumn("_row", F.explode(F.sequence(F.floor((F.col("lat") - top - 1e-9) / top), F.floor((F.col("lat") + top + 1e-9) / top))))
             .withColumn("_col", F.explode(F.sequence(F.floor((F.col("lon") - reach_lon) / top), F.floor((F.col("lon") + reach_lon) / top)))))
    # cells are exploded rows, which size estimates do not see
    j = probe.join(segment_cells(segs, top, 0).drop("_lv").hint("merge"), ["_row", "_col"])
    j = geo.with_projection(j, "p", "lat", "lon", "alat", "alon", "blat", "blon")
    here = (F.floor(F.col("p.lat") / top) == F.col("_row")) & (F.floor(F.col("p.lon") / top) == F.col("_col"))
    return j.filter(here & (F.col("p.distance_m") <= radius_m)).select("pid", "seg", "p")


def nearest_segment(points: DataFrame, segs: DataFrame, radius_m: float, levels: int = 4) -> DataFrame:
    """The nearest segment of each point within a radius: (pid, seg, distance_m, along_m, lat, lon).

    ``points`` has pid, lat, lon; ``segs`` has seg, alat, alon, blat, blon. Works as ``nearest``: at
    each grid level a segment is entered in the cells its pieces (no longer than a cell) touch, and a
    point is searched at the finest level whose own cell holds a piece. Such a piece is at most two
    cell diagonals away, so a ring of three cells holds the answer. Ties go to the lowest id.
    """
    top = radius_m / geo.M_PER_DEG
    size = F.lit(top) * F.pow(F.lit(0.5), F.col("_lv"))
    t_cells = segment_cells(segs, top, levels)
    occupied = t_cells.select("_lv", "_row", "_col").distinct()
    spots = points.select("lat", "lon").distinct()
    s_cells = (spots.withColumn("_lv", F.explode(F.sequence(F.lit(0), F.lit(levels))))
               .withColumn("_row", F.floor(F.col("lat") / size)).withColumn("_col", F.floor(F.col("lon") / size)))
    if levels:
        home = (s_cells.join(occupied.withColumn("_occ", F.lit(1)), ["_lv", "_row", "_col"], "left")
                .groupBy("lat", "lon").agg(F.max(F.when(F.col("_occ") == 1, F.col("_lv"))).alias("_found"))
                .withColumn("_lv", F.coalesce("_found", F.lit(0))))
    else:
        home = spots.withColumn("_found", F.lit(0)).withColumn("_lv", F.lit(0))
    ring = F.when(F.col("_found") > 1, 3.0).otherwise(F.pow(F.lit(2.0), F.col("_lv")))
    lat_reach = size * ring
    lon_reach = lat_reach / F.greatest(F.lit(1e-6), F.cos(F.radians(F.col("lat"))))
    probe = (home.withColumn("_row", F.explode(F.sequence(F.floor((F.col("lat") - lat_reach) / size), F.floor((F.col("lat") + lat_reach) / size))))
             .withColumn("_col", F.explode(F.sequence(F.floor((F.col("lon") - lon_reach) / size), F.floor((F.col("lon") + lon_reach) / size)))))
    near = geo.with_projection(probe.join(t_cells, ["_lv", "_row", "_col"]), "_p", "lat", "lon", "alat", "alon", "blat", "blon")
    best = (near.filter(F.col("_p.distance_m") <= radius_m)
            .groupBy("lat", "lon").agg(F.min(F.struct(F.round("_p.distance_m", 6).alias("k"), "seg", F.col("_p.distance_m").alias("d"),
                                                      F.col("_p").alias("p"))).alias("_m")))
    return points.join(best, ["lat", "lon"]).select(
        "pid", F.col("_m.seg").alias("seg"), F.col("_m.d").alias("distance_m"), F.col("_m.p.along_m").alias("along_m"),
        F.col("_m.p.lat").alias("on_lat"), F.col("_m.p.lon").alias("on_lon"))


def tile_cover(df: DataFrame, box: tuple, z: int) -> DataFrame:
    """One row per web tile a box touches, both sides of +-180, each tile once per row."""
    from ..functions import tiles
    part = df.withColumn("_part", F.explode(geo.box_parts(*[F.col(c) for c in box])))
    p = F.col("_part")
    out = part.withColumn("_t", F.explode(tiles.tiles_covering(p.s, p.w, p.n, p.e, F.lit(z))))
    return out.select(*df.columns, F.col("_t.x").alias("x"), F.col("_t.y").alias("y")).distinct()
