"""Terrain queries over posts derived from orders (one post per order)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import terrain as te
from .derived import derived, table, with_ctes
from .registry import query

P = with_ctes("posts")


def posts(spark, sf):
    return derived(spark, sf, "posts").withColumn("elev", F.col("elev").cast("double"))


def spots(spark, sf):
    """Points scattered over the post grid: lat and lon are in grid steps of 0.001 degree."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), (30 + (k * 7919 % 120000) / 1e6).alias("lat"), (-80 + (k * 104729 % 118000) / 1e6).alias("lon"))


SPOTS = "spots AS (SELECT c_custkey AS id, 30 + (c_custkey*7919 % 120000)/1e6 AS lat, -80 + (c_custkey*104729 % 118000)/1e6 AS lon FROM customer)"
BIL = P + f""", {SPOTS}, g AS (SELECT id, CAST(floor((lat - 30)/0.001e0) AS BIGINT) AS r, CAST(floor((lon + 80)/0.001e0) AS BIGINT) AS c, (lat - 30)/0.001e0 - floor((lat - 30)/0.001e0) AS fy, (lon + 80)/0.001e0 - floor((lon + 80)/0.001e0) AS fx FROM spots),
 b AS (SELECT id, (SELECT elev FROM posts WHERE row = r AND col = c) AS e00, (SELECT elev FROM posts WHERE row = r AND col = c + 1) AS e01, (SELECT elev FROM posts WHERE row = r + 1 AND col = c) AS e10, (SELECT elev FROM posts WHERE row = r + 1 AND col = c + 1) AS e11,
 (SELECT elev FROM posts WHERE row = r + CAST(floor(fy + 0.5e0) AS BIGINT) AND col = c + CAST(floor(fx + 0.5e0) AS BIGINT)) AS near, fy, fx FROM g),
 bil AS (SELECT id, coalesce(e00*(1 - fy)*(1 - fx) + e01*(1 - fy)*fx + e10*fy*(1 - fx) + e11*fy*fx, near) AS elev FROM b) """


@query("J20_nearest_post", P + f", {SPOTS} SELECT id, elev FROM spots LEFT JOIN posts ON row = CAST(floor((lat - 30)/0.001e0 + 0.5e0) AS BIGINT) AND col = CAST(floor((lon + 80)/0.001e0 + 0.5e0) AS BIGINT)")
def _(spark, sf):
    return te.nearest_post(spots(spark, sf), posts(spark, sf), 30.0, -80.0, 0.001).select("id", "elev")


@query("J21_bilinear", BIL + "SELECT id, round(elev, 4) AS elev FROM bil")
def _(spark, sf):
    return te.bilinear(spots(spark, sf), posts(spark, sf), 30.0, -80.0, 0.001).select("id", F.round("elev", 4).alias("elev"))


@query("J22_elevation_stack", P + f", {SPOTS}, n AS (SELECT id, elev FROM spots LEFT JOIN posts ON row = CAST(floor((lat - 30)/0.001e0 + 0.5e0) AS BIGINT) AND col = CAST(floor((lon + 80)/0.001e0 + 0.5e0) AS BIGINT)) SELECT id, CASE WHEN id % 3 = 0 AND elev IS NOT NULL THEN elev ELSE id % 7 END AS elev FROM n")
def _(spark, sf):
    s = spots(spark, sf)
    fine = te.nearest_post(s.filter("id % 3 = 0"), posts(spark, sf), 30.0, -80.0, 0.001)
    coarse = s.select("id", (F.col("id") % 7).cast("double").alias("elev"))
    return te.stack(s, [fine, coarse]).select("id", "elev")


@query("R1_sample_grid", P + """, g AS (SELECT i // 50 AS grow, i % 50 AS gcol, 30.001e0 + (i // 50)*(0.1e0/39) AS lat, -79.999e0 + (i % 50)*(0.1e0/49) AS lon FROM range(0, 2000) r(i))
 SELECT grow, gcol, elev IS NOT NULL AS covered, elev FROM g LEFT JOIN posts ON row = CAST(floor((lat - 30)/0.001e0 + 0.5e0) AS BIGINT) AND col = CAST(floor((lon + 80)/0.001e0 + 0.5e0) AS BIGINT)""")
def _(spark, sf):
    g = te.sample_grid(spark, (30.001, -79.999, 30.101, -79.899), 50, 40)
    return te.nearest_post(g, posts(spark, sf), 30.0, -80.0, 0.001).select("grow", "gcol", F.col("elev").isNotNull().alias("covered"), "elev")


@query("A16_profile_summary", P + """, s AS (SELECT row, col, elev, lag(elev) OVER (PARTITION BY row ORDER BY col) AS p FROM posts WHERE elev IS NOT NULL), a AS (SELECT row, min(elev) AS min_m, max(elev) AS max_m, coalesce(sum(CASE WHEN elev > p THEN elev - p END), 0) AS gain_m, coalesce(sum(CASE WHEN elev < p THEN p - elev END), 0) AS loss_m FROM s GROUP BY row)
 SELECT p.row, count(*) AS samples, count(*) FILTER (WHERE elev IS NULL) AS no_data, any_value(min_m) AS min_m, any_value(max_m) AS max_m, CAST(any_value(gain_m) AS DOUBLE) AS gain_m, CAST(any_value(loss_m) AS DOUBLE) AS loss_m FROM posts p LEFT JOIN a USING (row) GROUP BY p.row""")
def _(spark, sf):
    return te.profile_summary(posts(spark, sf).withColumn("seq", F.col("col")), ["row"])


@query("R2_terrain_profile", None)
def _(spark, sf):
    from ..operators import tracks as tr
    v = spots(spark, sf).select((F.col("id") % 60).alias("track"), F.col("id").alias("seq"), "lat", "lon")
    d = tr.densify(v, 500.0).withColumn("id", F.struct("track", "seq", "part"))
    e = te.bilinear(d, posts(spark, sf), 30.0, -80.0, 0.001)
    return te.profile_summary(e.select("track", (F.col("seq") * 4096 + F.col("part")).alias("seq"), "elev"), ["track"]).select(
        "track", "samples", "no_data", *[F.round(c, 3).alias(c) for c in ("min_m", "max_m", "gain_m", "loss_m")])


CELLS = P + """, c AS (SELECT a.row, a.col, a.elev AS sw, b.elev AS se, d.elev AS nw, e.elev AS ne FROM posts a JOIN posts b ON b.row = a.row AND b.col = a.col + 1 JOIN posts d ON d.row = a.row + 1 AND d.col = a.col JOIN posts e ON e.row = a.row + 1 AND e.col = a.col + 1
 WHERE a.elev IS NOT NULL AND b.elev IS NOT NULL AND d.elev IS NOT NULL AND e.elev IS NOT NULL), l AS (SELECT *, k*50e0 AS level FROM c, range(0, 12) r(k)), x AS (SELECT *, CAST(sw > level AS INT) + 2*CAST(se > level AS INT) + 4*CAST(ne > level AS INT) + 8*CAST(nw > level AS INT) AS code, (sw + se + ne + nw)/4 > level AS up FROM l) """


@query("R3_contour_segments", CELLS + """, e AS (SELECT level, row, col, unnest(CASE WHEN code IN (1, 14) THEN ['SW'] WHEN code IN (2, 13) THEN ['SE'] WHEN code IN (3, 12) THEN ['WE'] WHEN code IN (4, 11) THEN ['EN'] WHEN code IN (6, 9) THEN ['SN'] WHEN code IN (7, 8) THEN ['WN']
 WHEN (code = 5 AND up) OR (code = 10 AND NOT up) THEN ['SE', 'WN'] WHEN code IN (5, 10) THEN ['SW', 'EN'] ELSE [] END) AS s FROM x)
 SELECT level, row, col, CASE WHEN s[1] = 'E' THEN row ELSE row END AS a_row, CASE WHEN s[1] = 'E' THEN col + 1 ELSE col END AS a_col, CASE WHEN s[1] = 'S' THEN 0 ELSE 1 END AS a_k,
 CASE WHEN s[2] = 'N' THEN row + 1 ELSE row END AS b_row, CASE WHEN s[2] = 'E' THEN col + 1 ELSE col END AS b_col, CASE WHEN s[2] = 'N' THEN 0 ELSE 1 END AS b_k FROM e""")
def _(spark, sf):
    s = te.contour_segments(posts(spark, sf), interval=50.0)
    return s.select("level", "row", "col", *[F.col(f"{e}.{f}").alias(f"{e}_{f}") for e in "ab" for f in ("row", "col", "k")])


@query("R3_contours_at_levels", CELLS.replace("k*50e0 AS level FROM c, range(0, 12) r(k)", "k AS level FROM c, (VALUES (105e0), (333e0), (250e0)) r(k)") + "SELECT level, count(*) AS segments FROM (SELECT level, unnest(CASE WHEN code IN (5, 10) THEN [1, 2] WHEN code NOT IN (0, 15) THEN [1] ELSE [] END) FROM x) GROUP BY level")
def _(spark, sf):
    return te.contour_segments(posts(spark, sf), levels=[333.0, 105.0, 250.0]).groupBy("level").agg(F.count("*").alias("segments"))


@query("R4_contour_lines", None)
def _(spark, sf):
    return te.contour_lines(te.contour_segments(posts(spark, sf), interval=50.0))


NB = P + ", n AS (SELECT a.row, a.col, a.elev AS up, coalesce(b.elev, a.elev) AS lf, coalesce(c.elev, b.elev, a.elev) AS rt FROM posts a LEFT JOIN posts b ON b.row = a.row - 1 AND b.col = a.col LEFT JOIN posts c ON c.row = a.row - 1 AND c.col = a.col + 1 WHERE a.elev IS NOT NULL) "
LIGHT = te.light_vector(315.0, 45.0)


@query("R5_hillshade", NB + f"SELECT row, col, round(greatest(-1, least(1, (110*2*(rt - lf)*{LIGHT[0]!r}e0 + 2*(up - lf)*95*{LIGHT[1]!r}e0 - 110*95*{LIGHT[2]!r}e0)/sqrt(pow(110*2*(rt - lf), 2) + pow(2*(up - lf)*95, 2) + pow(110e0*95, 2)))), 6) AS shade, up = 0 AS sea FROM n")
def _(spark, sf):
    return te.hillshade(posts(spark, sf), LIGHT, 110.0, 95.0, 2.0).select("row", "col", F.round("shade", 6).alias("shade"), "sea")


@query("R6_bands", NB + "SELECT row, col, CASE WHEN up*10 < 762 THEN 0 WHEN up*10 < 1524 THEN 1 WHEN up*10 < 2286 THEN 2 WHEN up*10 < 3048 THEN 3 WHEN up*10 < 3810 THEN 4 ELSE 5 END AS band, round(100*sqrt(pow((rt - lf)/95, 2) + pow((up - lf)/110, 2)), 4) AS slope FROM n")
def _(spark, sf):
    p = posts(spark, sf)
    s = te.slope_percent(p, 110.0, 95.0)
    return s.join(p, ["row", "col"]).select("row", "col", te.band(F.col("elev") * 10).alias("band"), F.round("slope", 4).alias("slope"))


@query("R7_clearance", P + "SELECT row, col, CASE WHEN elev IS NULL THEN 'no data' WHEN elev >= 400 THEN 'warn' WHEN elev >= 150 THEN 'ok' ELSE 'none' END AS band FROM posts")
def _(spark, sf):
    return posts(spark, sf).select("row", "col", te.clearance(F.col("elev"), warn=400.0, ok=150.0).alias("band"))


@query("A19_clearance_totals", P + "SELECT CASE WHEN elev IS NULL THEN 'no data' WHEN elev >= 400 THEN 'warn' WHEN elev >= 300 THEN 'caution' WHEN elev >= 150 THEN 'ok' ELSE 'none' END AS band, count(*) AS n FROM posts GROUP BY 1")
def _(spark, sf):
    return posts(spark, sf).groupBy(te.clearance(F.col("elev"), 400.0, 300.0, 150.0).alias("band")).agg(F.count("*").alias("n"))


@query("A18_highest_post", P + "SELECT row, col, elev FROM posts WHERE elev IS NOT NULL ORDER BY elev DESC, row, col LIMIT 1")
def _(spark, sf):
    return te.highest(posts(spark, sf))


@query("W13_running_max", P + "SELECT a.row, a.col, CASE WHEN a.elev IS NOT NULL THEN (SELECT max(elev) FROM posts b WHERE b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 AND EXISTS (SELECT 1 FROM posts c WHERE c.row = b.row AND c.col = a.col AND c.elev IS NOT NULL)) END AS elev FROM posts a")
def _(spark, sf):
    return te.running_extreme(posts(spark, sf), 2, True, 32).select("row", "col", "elev")


def _opening(name, src, half, fn):
    mid = f"{name}_a AS (SELECT row, col, CASE WHEN elev IS NOT NULL THEN {fn}(elev) OVER (PARTITION BY row ORDER BY col RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING) END AS elev FROM {src})"
    return mid + f", {name} AS (SELECT row, col, CASE WHEN elev IS NOT NULL THEN {fn}(elev) OVER (PARTITION BY col ORDER BY row RANGE BETWEEN {half} PRECEDING AND {half} FOLLOWING) END AS elev FROM {name}_a)"


@query("R10_ground_filter", P + ", " + ", ".join([_opening("o1", "posts", 2, "min"), _opening("o2", "o1", 2, "max"), _opening("c1", "o2", 1, "max"), _opening("c2", "c1", 1, "min")]) + " SELECT row, col, elev FROM c2")
def _(spark, sf):
    return te.ground_filter(posts(spark, sf), 2, 1).select("row", "col", "elev")


@query("R11_overview", P + "SELECT row // 4 AS row, col // 4 AS col, round(avg(elev), 6) AS elev FROM posts GROUP BY 1, 2")
def _(spark, sf):
    return te.overview(posts(spark, sf), 4).select("row", "col", F.round("elev", 6).alias("elev"))


@query("R9_elevation_tiles", P + "SELECT row // 16 AS tile_row, col // 16 AS tile_col, count(elev) AS posts FROM posts GROUP BY 1, 2")
def _(spark, sf):
    return posts(spark, sf).groupBy(F.floor(F.col("row") / 16).alias("tile_row"), F.floor(F.col("col") / 16).alias("tile_col")).agg(F.count("elev").alias("posts"))


# DTED longitude spacing multiplier by latitude zone.
@query("R12_post_spacing", with_ctes("points") + f"SELECT id, round(3/36e2*{geo.M_PER_DEG!r}e0, 4) AS north_m, round(CASE WHEN abs(lat) < 50 THEN 1 WHEN abs(lat) < 70 THEN 2 WHEN abs(lat) < 75 THEN 3 WHEN abs(lat) < 80 THEN 4 ELSE 6 END*3/36e2*{geo.M_PER_DEG!r}e0*cos(radians(lat)), 4) AS east_m FROM points")
def _(spark, sf):
    la = F.abs("lat")
    zone = F.when(la < 50, 1).when(la < 70, 2).when(la < 75, 3).when(la < 80, 4).otherwise(6)
    return derived(spark, sf, "points").select("id", F.round(F.lit(3 / 3600.0 * geo.M_PER_DEG), 4).alias("north_m"), F.round(zone * 3 / 3600.0 * geo.plane_m_per_deg_lon(F.col("lat")), 4).alias("east_m"))


@query("F36_elevation_drop", "SELECT l_orderkey AS k, l_linenumber AS n, round(l_quantity*1000*l_quantity*1000/(2*6378135e0), 6) AS drop_m FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(geo.elevation_drop(F.col("l_quantity") * 1000), 6).alias("drop_m"))


@query("A17_G10_climb_descent", with_ctes("posts", recursive=True) + """, p AS (SELECT row, col, elev, row_number() OVER w AS n, count(*) OVER (PARTITION BY row) AS k FROM posts WHERE elev IS NOT NULL WINDOW w AS (PARTITION BY row ORDER BY col)),
 s(row, n, k, ref, up, down) AS (SELECT row, n, k, elev::DOUBLE, 0e0, 0e0 FROM p WHERE n = 1
  UNION ALL SELECT p.row, p.n, p.k, CASE WHEN abs(elev - ref) >= 3 THEN elev ELSE ref END, up + CASE WHEN elev - ref >= 3 THEN elev - ref ELSE 0 END, down + CASE WHEN ref - elev >= 3 THEN ref - elev ELSE 0 END FROM s JOIN p ON p.row = s.row AND p.n = s.n + 1 WHERE p.n < p.k),
 f AS (SELECT s.row, s.ref, up, down, p.elev FROM s JOIN p ON p.row = s.row AND p.n = p.k WHERE s.n = greatest(1, s.k - 1))
 SELECT row, round(up + greatest(elev - ref, 0), 3) AS climb_m, round(down + greatest(ref - elev, 0), 3) AS descent_m, round(down + greatest(ref - elev, 0), 3) AS back_climb_m FROM f""")
def _(spark, sf):
    # every row of the grid as one road, voids and all; driven back, what fell rises
    a = posts(spark, sf).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "elev"))), lambda x: x.elev).alias("profile")).filter(F.exists("profile", lambda e: e.isNotNull()))
    a = a.withColumn("c", te.climb_descent(F.col("profile"), 3.0))
    return a.select("row", F.round("c.climb", 3).alias("climb_m"), F.round("c.descent", 3).alias("descent_m"), F.round("c.descent", 3).alias("back_climb_m"))


@query("W20_fill_nodes", None)
def _(spark, sf):
    p = posts(spark, sf)
    key = F.col("row") * 120 + F.col("col")
    nodes = p.select(key.alias("node"), F.when(F.col("col") % 6 == 0, F.col("elev")).alias("elev"), F.lit(0.0).alias("fallback"))
    links = p.filter("col < 119").select(key.alias("u"), (key + 1).alias("v"), (10.0 + F.col("col") % 5).alias("length")).union(
        p.select(key.alias("u"), (key + 120).alias("v"), (10.0 + F.col("row") % 5).alias("length")))
    return te.fill_nodes(nodes, links.join(nodes.select(F.col("node").alias("v")), "v", "left_semi"), tol=0.005).select("node", F.round("elev", 2).alias("elev"))


_RAY = {"mn": "least(a.mn, b.mn)", "mx": "greatest(a.mx, b.mx)", "ip": "CASE WHEN fr = 0 THEN a.ip ELSE a.ip*(1 - fr) + b.ip*fr END"}
VIEWS = with_ctes("posts", recursive=True) + f""", ob AS MATERIALIZED (SELECT row*120 + col AS id, row AS r0, col AS c0, elev + 10 AS eye FROM posts WHERE (row*120 + col) % 997 = 5 AND elev IS NOT NULL),
 rg AS MATERIALIZED (SELECT r, dr, dc, floor(dr*(r - 1)/r)::INT AS ar, floor(dc*(r - 1)/r)::INT AS ac, ceil(dr*(r - 1)/r)::INT AS br, ceil(dc*(r - 1)/r)::INT AS bc, greatest((dr*(r - 1)) - r*floor(dr*(r - 1)/r), (dc*(r - 1)) - r*floor(dc*(r - 1)/r))/r AS fr, sqrt(dr*dr + dc*dc)*90e0 AS d
   FROM (SELECT r::BIGINT AS r, dr::BIGINT AS dr, dc::BIGINT AS dc FROM range(1, 21) a(r), range(-20, 21) b(dr), range(-20, 21) c(dc) WHERE greatest(abs(dr), abs(dc)) = r)),
 hz AS MATERIALIZED (SELECT id, rg.*, elev, coalesce(elev, 0) - d*d/(2*{geo.CURVATURE_R!r}) - eye AS rise FROM ob, rg LEFT JOIN posts ON posts.row = r0 + dr AND posts.col = c0 + dc),
 v(id, r, dr, dc, mn, mx, ip, vmn, vmx, vip, known) AS (SELECT id, 0::BIGINT, 0::BIGINT, 0::BIGINT, '-Infinity'::DOUBLE, '-Infinity'::DOUBLE, '-Infinity'::DOUBLE, 0e0, 0e0, 0e0, true FROM ob
  UNION ALL SELECT id, r, dr, dc, {', '.join(f"CASE WHEN {m}*d < rise THEN rise/d ELSE {m} END" for m in _RAY)}, {', '.join(f"CASE WHEN {m}*d < rise THEN 0 ELSE {m}*d - rise END" for m in _RAY)}, elev IS NOT NULL
   FROM (SELECT h.id, h.r, h.dr, h.dc, h.d, h.rise, h.elev, {', '.join(f"{e} AS {m}" for m, e in _RAY.items())} FROM hz h JOIN v a ON a.id = h.id AND a.r = h.r - 1 AND a.dr = h.ar AND a.dc = h.ac JOIN v b ON b.id = h.id AND b.r = h.r - 1 AND b.dr = h.br AND b.dc = h.bc) x)
 SELECT v.id, CAST(r0 + dr AS BIGINT) AS row, CAST(c0 + dc AS BIGINT) AS col, round(vmn, 3) AS vh_min, round(vmx, 3) AS vh_max, round(vip, 3) AS vh_interp FROM v JOIN ob USING (id) WHERE known"""


@query("R8_viewshed", VIEWS)
def _(spark, sf):
    o = posts(spark, sf).filter("(row * 120 + col) % 997 = 5 and elev is not null").select((F.col("row") * 120 + F.col("col")).alias("id"), "row", "col", F.lit(10.0).alias("height_m"), F.lit(20).alias("steps"))
    v = te.viewshed(o, posts(spark, sf), 90.0)
    return v.select("id", "row", "col", *[F.round(c, 3).alias(c) for c in ("vh_min", "vh_max", "vh_interp")])
