"""Terrain over an elevation-post table: posts(row, col, elev), row 0 in the south, elev null when void.

Neighbour lookups are one shuffle: each post is sent to the cells it is a corner of and the corners
meet in a partial-free aggregate on (row, col), whose groups have at most four rows.
"""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..session import cut_lineage
from .components import components


def corners(posts: DataFrame) -> DataFrame:
    """Cells (row, col) with the elevations of their corners sw, se, nw, ne (null when absent or void)."""
    offs = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(n).alias("n"))
                     for dr, dc, n in ((0, 0, "sw"), (0, -1, "se"), (-1, 0, "nw"), (-1, -1, "ne"))])
    e = posts.withColumn("_o", F.explode(offs)).select((F.col("row") + F.col("_o.dr")).alias("row"), (F.col("col") + F.col("_o.dc")).alias("col"), F.col("_o.n").alias("n"), "elev")
    return e.groupBy("row", "col").agg(*[F.max(F.when(F.col("n") == n, F.col("elev"))).alias(n) for n in ("sw", "se", "nw", "ne")],
                                       F.max(F.col("n") == "sw").alias("has_sw"))


def nearest_post(points: DataFrame, posts: DataFrame, lat0: float, lon0: float, step: float) -> DataFrame:
    """Elevation of the post nearest each (id, lat, lon)."""
    p = points.withColumn("row", F.floor((F.col("lat") - lat0) / step + 0.5)).withColumn("col", F.floor((F.col("lon") - lon0) / step + 0.5))
    return p.join(posts.select("row", "col", "elev"), ["row", "col"], "left").drop("row", "col")


def bilinear(points: DataFrame, posts: DataFrame, lat0: float, lon0: float, step: float, keep_missing: bool = True) -> DataFrame:
    """Bilinear elevation; when a corner is void the nearest post answers. Each point fetches its four posts
    by equi join and they meet again on the point's own id."""
    y, x = (F.col("lat") - lat0) / step, (F.col("lon") - lon0) / step
    p = points.withColumn("_r", F.floor(y)).withColumn("_c", F.floor(x)).withColumn("_fy", y - F.floor(y)).withColumn("_fx", x - F.floor(x))
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    q = p.select("id", "_r", "_c", "_fy", "_fx", F.explode(offs).alias("_o")).withColumn("row", F.col("_r") + F.col("_o.a")).withColumn("col", F.col("_c") + F.col("_o.b"))
    w = F.when(F.col("_o.a") == 1, F.col("_fy")).otherwise(1 - F.col("_fy")) * F.when(F.col("_o.b") == 1, F.col("_fx")).otherwise(1 - F.col("_fx"))
    near = (F.col("_o.a") == F.floor(F.col("_fy") + 0.5)) & (F.col("_o.b") == F.floor(F.col("_fx") + 0.5))
    # points may come out of exploded legs, which size estimates do not see: neither side is broadcast
    j = q.join(posts.select("row", "col", "elev").hint("merge"), ["row", "col"])
    # corners of zero weight do not matter to the value
    a = j.groupBy("id").agg(F.count_if(F.col("elev").isNotNull()).alias("_n"), F.sum(w * F.col("elev")).alias("_v"), F.max(F.when(near, F.col("elev"))).alias("_near"))
    out = points.join(a.hint("merge"), "id", "left" if keep_missing else "inner")
    return out.withColumn("elev", F.when(F.col("_n") == 4, F.col("_v")).otherwise(F.col("_near"))).drop("_n", "_v", "_near")


def stack(points: DataFrame, sources: list[DataFrame]) -> DataFrame:
    """First source (id, elev) with a value wins."""
    out = points
    for i, s in enumerate(sources):
        out = out.join(s.select("id", F.col("elev").alias(f"_e{i}")), "id", "left")
    return out.withColumn("elev", F.coalesce(*[F.col(f"_e{i}") for i in range(len(sources))])).drop(*[f"_e{i}" for i in range(len(sources))])


def sample_grid(spark, box: tuple, width: int, height: int) -> DataFrame:
    """Posts of a grid over a box: id, row, col, lat, lon (a range, so it is made in parallel)."""
    s, w, n, e = box
    i = F.col("id")
    r, c = F.floor(i / width), i % width
    return spark.range(width * height).select("id", r.alias("grow"), c.alias("gcol"), (s + r * ((n - s) / max(1, height - 1))).alias("lat"), (w + c * ((e - w) / max(1, width - 1))).alias("lon"))


def profile_summary(samples: DataFrame, keys: list[str], chunk: int = 2000) -> DataFrame:
    """Min, max, gain and loss over known samples (key, seq, elev), voids counted and skipped."""
    from .ordered import Ordered
    known = samples.filter(F.col("elev").isNotNull())
    o = Ordered(known, keys, ["seq"], F.floor(F.col("seq") / chunk)).previous(elev=F.col("elev")).result()
    d = F.col("elev") - F.col("prev_elev")
    a = o.groupBy(*keys).agg(F.min("elev").alias("min_m"), F.max("elev").alias("max_m"), F.coalesce(F.sum(F.when(d > 0, d)), F.lit(0.0)).alias("gain_m"),
                             F.coalesce(F.sum(F.when(d < 0, -d)), F.lit(0.0)).alias("loss_m"))
    n = samples.groupBy(*keys).agg(F.count("*").alias("samples"), F.count_if(F.col("elev").isNull()).alias("no_data"))
    return n.join(a, keys, "left")


def contour_segments(posts: DataFrame, interval: float | None = None, levels: list[float] | None = None) -> DataFrame:
    """Marching squares: one row per segment (level, a, b) joining two cell edges.

    An edge is struct(row, col, k): k = 0 along the row from (row, col) east, 1 up the column north. A
    corner is above only when strictly greater; void cells are skipped; the cell mean settles saddles.
    """
    c = corners(posts).filter(F.col("sw").isNotNull() & F.col("se").isNotNull() & F.col("nw").isNotNull() & F.col("ne").isNotNull())
    lo, hi = F.least("sw", "se", "nw", "ne"), F.greatest("sw", "se", "nw", "ne")
    if levels is None:
        ks = F.sequence(F.floor(lo / interval), F.ceil(hi / interval))
        lv = F.transform(ks, lambda k: k.cast("double") * interval)
    else:
        lv = F.array(*[F.lit(float(v)) for v in sorted(set(levels))])
    d = c.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("level", F.explode(lv)).filter((F.col("level") >= F.col("_lo")) & (F.col("level") < F.col("_hi")))
    v = F.col("level")
    code = sum((F.when(F.col(n) > v, b).otherwise(0) for n, b in (("sw", 1), ("se", 2), ("ne", 4), ("nw", 8))), F.lit(0))
    d = d.withColumn("_code", code).withColumn("_up", (F.col("sw") + F.col("se") + F.col("ne") + F.col("nw")) * 0.25 > v)

    def edge(dr, dc, k):
        return F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(k).alias("k"))
    S, N, W, E = edge(0, 0, 0), edge(1, 0, 0), edge(0, 0, 1), edge(0, 1, 1)

    def seg(a, b):
        return F.struct(a.alias("a"), b.alias("b"))
    one = {(1, 14): (S, W), (2, 13): (S, E), (3, 12): (W, E), (4, 11): (E, N), (6, 9): (S, N), (7, 8): (W, N)}
    out = F.when(((F.col("_code") == 5) & F.col("_up")) | ((F.col("_code") == 10) & ~F.col("_up")), F.array(seg(S, E), seg(W, N))).when(
        F.col("_code").isin(5, 10), F.array(seg(S, W), seg(E, N)))
    for codes, (a, b) in one.items():
        out = out.when(F.col("_code").isin(*codes), F.array(seg(a, b)))
    return d.select("level", "row", "col", F.explode(out).alias("s")).select("level", "row", "col", "s.a", "s.b")


def contour_lines(segments: DataFrame) -> DataFrame:
    """Segments joined into lines: (line, level, seq, from_node, to_node, closed), in order along each line.

    Lines are found as connected pieces; order comes from pointer doubling over directed segments, so a
    line of n segments takes log2(n) rounds and is never gathered in one task. An open line runs from
    its lower end; a ring is cut at its lowest node and runs towards the lower of that node's neighbours.
    """
    def node(c):
        return F.concat_ws(":", F.col("level").cast("string"), F.col(f"{c}.row"), F.col(f"{c}.col"), F.col(f"{c}.k"))
    s = cut_lineage(segments.select("level", node("a").alias("u"), node("b").alias("v")))
    ids = cut_lineage(components(s))
    deg = s.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    head = ids.join(deg, "node").groupBy("label").agg(F.min(F.when(F.col("deg") == 1, F.col("node"))).alias("end"), F.min("node").alias("low")).select(
        F.col("label").alias("line"), F.coalesce("end", "low").alias("head"), F.col("end").isNull().alias("closed"))
    d = s.union(s.select("level", F.col("v").alias("u"), F.col("u").alias("v"))).join(ids.select(F.col("node").alias("u"), F.col("label").alias("line")), "u").join(head, "line")
    d = cut_lineage(d)
    # the step before u->v is w->u with w other than v; steps out of the head have none. Following it back
    # either reaches the head (the right direction) or runs off the far end (the wrong one).
    back = d.select(F.col("u").alias("w"), F.col("v").alias("u"))
    prior = d.join(back, "u").filter((F.col("w") != F.col("v")) & (F.col("u") != F.col("head"))).select("u", "v", "w")
    a = d.join(prior, ["u", "v"], "left").select(
        "level", "line", "closed", "u", "v", F.when(F.col("w").isNotNull(), F.struct(F.col("w").alias("u"), F.col("u").alias("v"))).alias("ptr"),
        F.when(F.col("w").isNotNull(), 1).otherwise(0).cast("long").alias("dist"), F.when(F.col("u") == F.col("head"), F.col("v")).alias("root"))
    a = cut_lineage(a)
    while not a.filter("ptr is not null").isEmpty():
        b = a.select(F.struct("u", "v").alias("ptr"), F.col("ptr").alias("_p"), F.col("dist").alias("_d"), F.col("root").alias("_r"))
        a = cut_lineage(a.join(b, "ptr", "left").select("level", "line", "closed", "u", "v", F.col("_p").alias("ptr"),
                                                        (F.col("dist") + F.coalesce("_d", F.lit(0))).alias("dist"), F.coalesce("root", "_r").alias("root")))
    way = a.filter("root is not null").groupBy("line").agg(F.min("root").alias("_go"))
    return a.join(way, "line").filter(F.col("root") == F.col("_go")).select("line", "level", "closed", F.col("dist").alias("seq"), F.col("u").alias("from_node"), F.col("v").alias("to_node"))


def hillshade(posts: DataFrame, light: tuple, spacing_lat: float, spacing_lon: float, exaggeration: float = 1.0) -> DataFrame:
    """Cosine between the ground normal and the light at each post, from it and the two posts south of it."""
    lx, ly, lz = light
    c = corners(posts)
    # the cell south of a post has it as its north-west corner
    d = c.select((F.col("row") + 1).alias("row"), "col", F.col("nw").alias("up"), F.coalesce("sw", "nw").alias("left"), F.coalesce("se", "sw", "nw").alias("right")).filter(F.col("up").isNotNull())
    vb, vr = exaggeration * (F.col("up") - F.col("left")), exaggeration * (F.col("right") - F.col("left"))
    nx, ny, nz = spacing_lat * vr, vb * spacing_lon, -spacing_lat * spacing_lon
    dot = (nx * lx + ny * ly + nz * lz) / F.sqrt(nx * nx + ny * ny + nz * nz)
    return d.select("row", "col", F.col("up").alias("elev"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)).alias("shade"), (F.col("up") == 0).alias("sea"))


def light_vector(azimuth_deg: float, elevation_deg: float) -> tuple:
    """Direction of travel of the light for a sun azimuth and elevation."""
    a, e = math.radians(azimuth_deg), math.radians(elevation_deg)
    return -math.sin(a) * math.cos(e), -math.cos(a) * math.cos(e), -math.sin(e)


# Elevation band limits in feet.
BAND_FEET = [2500, 5000, 7500, 10000, 12500]


def band(elev_m: Column, limits_ft=BAND_FEET) -> Column:
    """Index of the first limit above the elevation."""
    out = F.lit(len(limits_ft))
    for i, ft in reversed(list(enumerate(limits_ft))):
        out = F.when(elev_m < ft * 0.3048, i).otherwise(out)
    return out


def slope_percent(posts: DataFrame, spacing_lat: float, spacing_lon: float) -> DataFrame:
    d = corners(posts).select((F.col("row") + 1).alias("row"), "col", F.col("nw").alias("up"), F.coalesce("sw", "nw").alias("left"), F.coalesce("se", "sw", "nw").alias("right")).filter(F.col("up").isNotNull())
    gy, gx = (F.col("up") - F.col("left")) / spacing_lat, (F.col("right") - F.col("left")) / spacing_lon
    return d.select("row", "col", (100 * F.sqrt(gx * gx + gy * gy)).alias("slope"))


def clearance(elev: Column, warn=None, caution=None, ok=None) -> Column:
    """Band by altitude limits (metres); a limit of None is switched off and falls to the next."""
    out = F.lit("none")
    for name, v in (("ok", ok), ("caution", caution), ("warn", warn)):
        if v is not None:
            out = F.when(elev >= v, name).otherwise(out)
    return F.when(elev.isNull(), "no data").otherwise(out)


def highest(posts: DataFrame) -> DataFrame:
    return posts.agg(F.max_by(F.struct("row", "col", "elev"), F.struct("elev", -F.col("row"), -F.col("col"))).alias("m")).select("m.*")


def running_extreme(posts: DataFrame, half: int, take_max: bool, block: int = 256) -> DataFrame:
    """Separable running minimum or maximum of a (2*half+1) square window; voids are skipped.

    Lines are cut into blocks and each block is sent its halo, so no task holds a whole line.
    """
    fn = F.max if take_max else F.min

    def axis(df, line, along):
        blocks = F.array_distinct(F.transform(F.array(F.lit(-half), F.lit(0), F.lit(half)), lambda d: F.floor((F.col(along) + d) / block)))
        d = df.withColumn("_b", F.explode(blocks))
        w = Window.partitionBy(line, "_b").orderBy(along).rangeBetween(-half, half)
        return d.withColumn("_e", fn("elev").over(w)).filter(F.col("_b") == F.floor(F.col(along) / block)).withColumn("elev", F.when(F.col("elev").isNotNull(), F.col("_e"))).drop("_b", "_e")
    return axis(axis(posts.select("row", "col", "elev"), "row", "col"), "col", "row")


def ground_filter(posts: DataFrame, open_half: int, close_half: int) -> DataFrame:
    """Opening takes off what stands up narrower than its window, then closing fills narrow pits."""
    d = posts
    if open_half:
        d = running_extreme(running_extreme(d, open_half, False), open_half, True)
    if close_half:
        d = running_extreme(running_extreme(d, close_half, True), close_half, False)
    return d


def overview(posts: DataFrame, n: int) -> DataFrame:
    """Means over n by n boxes of posts."""
    return posts.groupBy(F.floor(F.col("row") / n).alias("row"), F.floor(F.col("col") / n).alias("col")).agg(F.avg("elev").alias("elev"))


def climb_descent(profile: Column, hysteresis: float) -> Column:
    """Struct(climb, descent) of an elevation array: a change counts once it reaches the hysteresis from the
    last counted level; the remainder to the last entry is counted outright. Voids are passed over; the other direction's are these swapped."""
    profile = F.filter(profile, lambda e: e.isNotNull())
    inner = F.slice(profile, F.lit(2), F.greatest(F.lit(0), F.size(profile) - 2))
    zero = F.struct(F.get(profile, F.lit(0)).alias("ref"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"))

    def step(s, e):
        d = e - s.ref
        return F.struct(F.when(F.abs(d) >= hysteresis, e).otherwise(s.ref).alias("ref"), (s.up + F.when(d >= hysteresis, d).otherwise(0.0)).alias("up"),
                        (s.down + F.when(-d >= hysteresis, -d).otherwise(0.0)).alias("down"))
    last = F.try_element_at(profile, F.lit(-1))
    return F.aggregate(inner, zero, step, lambda s: F.struct((s.up + F.greatest(last - s.ref, F.lit(0.0))).alias("climb"), (s.down + F.greatest(s.ref - last, F.lit(0.0))).alias("descent")))


def fill_nodes(nodes: DataFrame, links: DataFrame, tol: float = 0.005) -> DataFrame:
    """Elevations of unsampled nodes: 1/length-weighted mean of neighbours, iterated until nothing moves 5 mm.

    Nodes: node, elev (null to fill), fallback. Links: u, v, length. Only the nodes being filled move.
    """
    w = 1 / F.greatest(F.lit(1e-3), F.col("length"))
    both = links.select("u", "v", w.alias("w")).union(links.select(F.col("v").alias("u"), F.col("u").alias("v"), w.alias("w")))
    free = cut_lineage(nodes.filter(F.col("elev").isNull()).select("node"))
    both = both.join(free.select(F.col("node").alias("u")), "u", "left_semi")
    known = nodes.filter(F.col("elev").isNotNull()).select(F.col("node").alias("v"), "elev")
    # what fixed neighbours contribute never changes; only links between free nodes are visited again
    base = both.join(known, "v").groupBy("u").agg(F.sum(F.col("w") * F.col("elev")).alias("n0"), F.sum("w").alias("d0"))
    inner = cut_lineage(both.join(free.select(F.col("node").alias("v")), "v", "left_semi"))
    start = free.withColumnRenamed("node", "u").join(base, "u", "left").select("u", F.coalesce("n0", F.lit(0.0)).alias("n0"), F.coalesce("d0", F.lit(0.0)).alias("d0"))
    cur = cut_lineage(start.withColumn("e", F.try_divide("n0", "d0")))
    while True:
        old = cur
        for _sweep in range(4):
            nb = inner.join(cur.select(F.col("u").alias("v"), "e"), "v").filter(F.col("e").isNotNull()).groupBy("u").agg(F.sum(F.col("w") * F.col("e")).alias("n1"), F.sum("w").alias("d1"))
            before = cur
            cur = before.join(nb, "u", "left").select("u", "n0", "d0", F.try_divide(F.col("n0") + F.coalesce("n1", F.lit(0.0)), F.col("d0") + F.coalesce("d1", F.lit(0.0))).alias("e"))
        cur = cut_lineage(cur)
        top = cur.join(old.select("u", F.col("e").alias("_o")), "u").agg(F.max(F.abs(F.col("e") - F.coalesce("_o", F.lit(1e9))))).first()[0]
        if top is None or top < tol:
            break
    cur = nodes.join(cur.select(F.col("u").alias("node"), "e"), "node", "left").select("node", F.coalesce("elev", "e").alias("elev"), "fallback")
    return cur.select("node", F.coalesce("elev", "fallback", F.lit(0.0)).alias("elev"))


_SIGHT = ("min", "max", "interp")


def _wedge(spacing_m: float, band: int):
    """One band of rings of one side and sector of an observer: heights at which its posts are seen, and the sight lines of its last ring.

    A side is the ring's posts with one coordinate at the ring's distance r and the other one, k, from -r to r. The sight line to (r, k) passes
    ring r - 1 at k * (r - 1) / r, between two posts of the same side. Outside the sector a margin that shrinks by one post a ring is worked out as well.
    """
    def run(pdf):
        import numpy as np
        import pandas as pd
        head = pdf.iloc[0]
        eye, r0, n, s = float(head.eye), int(head.r0), int(head.sectors), int(head.sector)
        r1 = min(r0 + band, int(head.steps))
        u0, u1 = -1 + 2 * s / n, -1 + 2 * (s + 1) / n

        def reach(r):
            margin = r1 - r + 1
            return max(-r, int(np.floor(u0 * r)) - margin), min(r, int(np.ceil(u1 * r)) + margin)
        carried = pdf[pdf.ring == r0]
        lo, hi = reach(r0) if r0 else (0, 0)
        los = {m: np.full(hi - lo + 1, -np.inf) for m in _SIGHT}
        inside = carried[(carried.k >= lo) & (carried.k <= hi)]
        for m in _SIGHT:
            los[m][inside.k.to_numpy(int) - lo] = inside[f"l_{m}"].to_numpy(float)
        posts = pdf[pdf.ring > r0].sort_values("ring")
        rings, at, heights = posts.ring.to_numpy(int), posts.k.to_numpy(int), posts.elev.to_numpy(float)
        out = []
        for r in range(r0 + 1, r1 + 1):
            was, (lo, hi) = lo, reach(r)
            k = np.arange(lo, hi + 1)
            z = np.full(len(k), np.nan)
            x, y = np.searchsorted(rings, [r, r + 1])
            mine = (at[x:y] >= lo) & (at[x:y] <= hi)
            z[at[x:y][mine] - lo] = heights[x:y][mine]
            dist = np.hypot(r, k) * spacing_m
            rise = np.where(np.isnan(z), 0.0, z) - dist ** 2 / (2 * geo.CURVATURE_R) - eye
            a, part = k * (r - 1) // r, k * (r - 1) % r
            t, b = part / r, a + (part > 0)
            vh, line = {}, {}
            for m in _SIGHT:
                pa, pb = los[m][a - was], los[m][b - was]
                with np.errstate(invalid="ignore"):
                    ray = np.maximum(pa, pb) if m == "max" else np.minimum(pa, pb) if m == "min" else np.where(part == 0, pa, pa * (1 - t) + pb * t)
                    ray = np.where(np.isnan(ray), -np.inf, ray)
                    seen = ray * dist < rise
                vh[m] = np.where(seen, 0.0, ray * dist - rise)
                line[m] = np.where(seen, rise / dist, ray)
            los = line
            own = np.minimum(n - 1, np.floor((k / r + 1) / 2 * n).astype(int)) == s
            keep = own & (~np.isnan(z) | (r == r1))
            out.append(pd.DataFrame({"id": int(head.id), "side": int(head.side), "ring": r, "k": k[keep], "known": ~np.isnan(z)[keep],
                                     **{f"vh_{m}": vh[m][keep] for m in _SIGHT}, **{f"l_{m}": line[m][keep] for m in _SIGHT}}))
        return pd.concat(out)
    return run


def viewshed(observers: DataFrame, posts: DataFrame, spacing_m: float, circle: bool = False, band: int = 256, width: int = 1024) -> DataFrame:
    """For each observer (id, row, col, height_m, steps) the height at which each post in range is first seen, 0 for one in sight.

    Rings grow outwards: the line of sight of a post comes from the two posts nearer the observer it lies between (min, max and interpolated). Every post in range is judged,
    whatever the range. A range is cut into bands of ``band`` rings and, on each of its four sides, into sectors of about ``width`` posts: each band is one job in which an observer is many tasks; its
    last ring's sight lines are written down for the next. A task holds about band * (width + 2 * band) posts.

    ``circle``: only posts within ``steps`` as the crow flies. Observers may have ``bearing`` and ``angle`` (degrees, null: all round; 270 or more: no crop): only posts in that wedge, rows growing northward, are
    returned. Observers on a post without elevation see nothing.
    """
    crop = "bearing" in observers.columns
    cols = ["id", "row", "col", "height_m", "steps", *(["bearing", "angle"] if crop else [])]
    eyes = posts.filter("elev is not null").select("row", "col", F.col("elev").alias("_z"))
    o = cut_lineage(observers.select(*cols).join(eyes, ["row", "col"]).withColumn("eye", F.col("_z") + F.col("height_m")).withColumnRenamed("row", "orow").withColumnRenamed("col", "ocol").drop("_z"))
    most = o.agg(F.max("steps")).first()[0] or 0
    size = 64
    p = posts.select("row", "col", "elev", F.floor(F.col("row") / size).alias("_br"), F.floor(F.col("col") / size).alias("_bc"))
    carried, found = None, []
    schema = "id long, side int, ring int, k int, known boolean, " + ", ".join(f"{a}_{m} double" for a in ("vh", "l") for m in _SIGHT)
    for r0 in range(0, int(most), band):
        here = o.filter(F.col("steps") > r0).withColumn("r1", F.least(F.col("steps"), F.lit(r0 + band)))
        # blocks of posts that the band's square ring meets
        lo = lambda c: F.floor((F.col(c) - F.col("r1")) / size)
        hi = lambda c: F.floor((F.col(c) + F.col("r1")) / size)
        ob = here.withColumn("_br", F.explode(F.sequence(lo("orow"), hi("orow")))).withColumn("_bc", F.explode(F.sequence(lo("ocol"), hi("ocol"))))
        far = F.greatest(*[F.greatest(F.abs(F.col(b) * size - F.col(c)), F.abs(F.col(b) * size + size - 1 - F.col(c))) for b, c in (("_br", "orow"), ("_bc", "ocol"))])
        j = ob.filter(far > r0).join(p, ["_br", "_bc"]).withColumn("dr", (F.col("row") - F.col("orow")).cast("int")).withColumn("dc", (F.col("col") - F.col("ocol")).cast("int"))
        j = j.withColumn("ring", F.greatest(F.abs("dr"), F.abs("dc"))).filter((F.col("ring") > r0) & (F.col("ring") <= F.col("r1")))
        # a corner is on two sides, which both need it
        on = F.array(*[F.when(F.col(c) == sign * F.col("ring"), F.struct(F.lit(i).alias("side"), F.col(k).alias("k"))) for i, (c, sign, k) in
                       enumerate([("dr", -1, "dc"), ("dr", 1, "dc"), ("dc", -1, "dr"), ("dc", 1, "dr")])])
        rows = j.withColumn("_on", F.explode(F.array_compact(on))).select("id", "eye", "steps", "r1", "_on.side", "ring", "_on.k", "elev", *[F.lit(None).cast("double").alias(f"l_{m}") for m in _SIGHT])
        if carried is not None:
            rows = rows.unionByName(carried.join(here.select("id", "eye", "steps", "r1"), "id").select("id", "eye", "steps", "r1", "side", "ring", "k", F.lit(None).cast("double").alias("elev"), *[f"l_{m}" for m in _SIGHT]))
        n = F.ceil((2 * F.col("r1") + 1) / width).cast("int")
        margin = F.col("r1") - F.col("ring") + 2
        at = lambda k: F.greatest(F.lit(0), F.least(F.col("sectors") - 1, F.floor((k / F.col("ring") + 1) / 2 * F.col("sectors")).cast("int")))
        rows = rows.withColumn("sectors", n).withColumn("sector", F.explode(F.sequence(at(F.col("k") - margin), at(F.col("k") + margin))))
        # every sector has its task, also where the table holds no post of it
        none = F.lit(None).cast("double")
        base = here.withColumn("sectors", n).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("sector", F.explode(F.sequence(F.lit(0), F.col("sectors") - 1)))
        rows = rows.unionByName(base.select("id", "eye", "steps", "r1", "side", F.lit(-1).alias("ring"), F.lit(0).alias("k"), none.alias("elev"), *[none.alias(f"l_{m}") for m in _SIGHT], "sectors", "sector")).withColumn("r0", F.lit(r0))
        made = cut_lineage(rows.drop("r1").groupBy("id", "side", "sector").applyInPandas(_wedge(spacing_m, band), schema))
        carried = made.filter(F.col("ring") == r0 + band).select("id", "side", "ring", "k", *[f"l_{m}" for m in _SIGHT])
        found.append(made.filter("known and (side < 2 or abs(k) < ring)"))   # corners come once
    # the observer's own post
    own = o.select("id", F.lit(0).alias("side"), F.lit(0).alias("ring"), F.lit(0).alias("k"), F.lit(True).alias("known"), *[F.lit(0.0).alias(f"{a}_{m}") for a in ("vh", "l") for m in _SIGHT])
    seen = reduce(DataFrame.unionByName, [own, *found]).join(o.select("id", "orow", "ocol", "steps", *cols[5:]), "id")
    sign = F.when(F.col("side") % 2 == 0, -F.col("ring")).otherwise(F.col("ring"))
    dr, dc = F.when(F.col("side") < 2, sign).otherwise(F.col("k")), F.when(F.col("side") < 2, F.col("k")).otherwise(sign)
    if circle:
        seen = seen.filter(F.hypot(dr, dc) <= F.col("steps"))
    if crop:
        off = geo.angle_between(geo.normalize_heading(F.degrees(F.atan2(dc.cast("double"), dr.cast("double")))), F.col("bearing"))
        seen = seen.filter(F.col("angle").isNull() | F.col("bearing").isNull() | (F.col("angle") >= 270.0) | (F.col("ring") == 0) | (off <= F.col("angle") / 2))
    return seen.select("id", (F.col("orow") + dr).cast("long").alias("row"), (F.col("ocol") + dc).cast("long").alias("col"), *[f"vh_{m}" for m in _SIGHT])
