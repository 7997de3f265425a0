"""Spatial joins, catalog, tiles, search and name queries."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import geo, tiles
from ..operators import catalog as cat, search as srch, spatial as sp, tilepack
from ..operators.components import components
from .derived import derived, table, with_ctes
from .registry import query

RAD = "6371008.8e0"
HAV = "2*6371008.8e0*asin(sqrt(least(1e0, pow(sin(radians({b} - {a})/2), 2) + cos(radians({a}))*cos(radians({b}))*pow(sin(radians({d} - {c})/2), 2))))"


def sql_norm(x):
    return f"(CASE WHEN (({x}) + 180) - 360*floor((({x}) + 180)/360) = 0 THEN 180e0 ELSE (({x}) + 180) - 360*floor((({x}) + 180)/360) - 180 END)"


def sql_plane(lat, lon, lat2, lon2):
    return (f"sqrt(pow({sql_norm(f'{lon2} - {lon}')}*111195.08023353292e0*cos(radians({lat})), 2) + pow(({lat2} - {lat})*111195.08023353292e0, 2))")


def sql_lon_overlap(w1, e1, w2, e2):
    return f"""CASE WHEN {w1} > {e1} AND {w2} > {e2} THEN true WHEN {w1} > {e1} OR {w2} > {e2} THEN {w1} <= {e2} OR {w2} <= {e1} ELSE {w1} <= {e2} AND {w2} <= {e1} END"""


@query("F1_F4_distance_bearing", with_ctes("points") + f""", p AS (SELECT a.id, a.lat, a.lon, b.lat AS lat2, b.lon AS lon2 FROM points a JOIN points b ON b.id = (a.id*7 + 1) % 1000)
 SELECT id, round({HAV.format(a='lat', b='lat2', c='lon', d='lon2')}, 2) AS sphere_m,
 round(CASE WHEN lat = lat2 AND lon = lon2 THEN 0 ELSE degrees(atan2(sin(radians(lon2 - lon))*cos(radians(lat2)), cos(radians(lat))*sin(radians(lat2)) - sin(radians(lat))*cos(radians(lat2))*cos(radians(lon2 - lon)))) +
 CASE WHEN atan2(sin(radians(lon2 - lon))*cos(radians(lat2)), cos(radians(lat))*sin(radians(lat2)) - sin(radians(lat))*cos(radians(lat2))*cos(radians(lon2 - lon))) < 0 THEN 360 ELSE 0 END END, 5) AS bearing_deg,
 round({sql_plane('lat', 'lon', 'lat2', 'lon2')}, 2) AS plane_m, round({sql_norm('lon + lon2')}, 6) AS lon_sum FROM p""")
def _(spark, sf):
    a = derived(spark, sf, "points").select("id", "lat", "lon")
    b = a.select(F.col("id").alias("k"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    p = a.withColumn("k", (F.col("id") * 7 + 1) % 1000).join(b, "k")
    c = [F.col(x) for x in ("lat", "lon", "lat2", "lon2")]
    return p.select("id", F.round(geo.sphere_m(*c), 2).alias("sphere_m"), F.round(geo.bearing(*c), 5).alias("bearing_deg"),
                    F.round(geo.plane_m(*c), 2).alias("plane_m"), F.round(geo.normalize_lon(c[1] + c[3]), 6).alias("lon_sum"))


@query("F2_rhumb", with_ctes("points") + """, p AS (SELECT id, radians(lat) AS p1, radians(lat + 3 + id % 7) AS p2, radians(CASE WHEN ((id % 11) - 5)*20e0 > 180 THEN 1e0 ELSE ((id % 11) - 5)*20e0 END) AS dx FROM points),
 q AS (SELECT id, p1, p2, dx, (p2 - p1)/ln(tan(p2/2 + pi()/4)/tan(p1/2 + pi()/4)) AS q FROM p)
 SELECT id, round(6371007.1809e0*sqrt(q*q*dx*dx + (p2 - p1)*(p2 - p1)), 2) AS range_m,
 round(CASE WHEN atan2(dx, ln(tan(p2/2 + pi()/4)/tan(p1/2 + pi()/4))) < 0 THEN 360 ELSE 0 END + degrees(atan2(dx, ln(tan(p2/2 + pi()/4)/tan(p1/2 + pi()/4)))), 5) AS bearing_deg FROM q""")
def _(spark, sf):
    p = derived(spark, sf, "points")
    r = geo.rhumb(F.col("lat"), F.col("lon"), F.col("lat") + 3 + F.col("id") % 7, F.col("lon") + (F.col("id") % 11 - 5) * 20.0)
    return p.select("id", F.round(r.range_m, 2).alias("range_m"), F.round(r.bearing_deg, 5).alias("bearing_deg"))


@query("F5_boxes", with_ctes("boxes") + """SELECT cov_id, round((c_s + c_n)/2, 6) AS mid_lat, round(c_s - 50000/111195.08023353292e0, 6) AS around_s FROM boxes""")
def _(spark, sf):
    b = derived(spark, sf, "boxes")
    box = [F.col(c) for c in ("c_s", "c_w", "c_n", "c_e")]
    return b.select("cov_id", F.round(geo.box_center(*box).lat, 6).alias("mid_lat"),
                    F.round(geo.box_around(F.col("c_s"), F.col("c_w"), 50000.0).s, 6).alias("around_s"))


@query("F6_geocentric", with_ctes("points") + """SELECT id, round(cos(radians(lat))*cos(radians(lon)), 9) AS x, round(cos(radians(lat))*sin(radians(lon)), 9) AS y, round(sin(radians(lat)), 9) AS z, round(lat, 6) AS back_lat, round(lon, 6) AS back_lon FROM points""")
def _(spark, sf):
    p = derived(spark, sf, "points").withColumn("v", geo.unit_xyz(F.col("lat"), F.col("lon")))
    back = geo.xyz_to_geo(F.col("v.x"), F.col("v.y"), F.col("v.z"))
    return p.select("id", *[F.round(f"v.{c}", 9).alias(c) for c in "xyz"], F.round(back.lat, 6).alias("back_lat"), F.round(back.lon, 6).alias("back_lon"))


@query("F7_tiles", with_ctes("points") + """, t AS (SELECT id, lat, lon, 3 + id % 15 AS z FROM points),
 u AS (SELECT id, CAST(z AS BIGINT) AS z, CAST(least(greatest(floor((lon + 180)/360*pow(2, z)), 0), pow(2, z) - 1) AS INT) AS x,
 CAST(least(greatest(floor((1 - asinh(tan(radians(lat)))/pi())/2*pow(2, z)), 0), pow(2, z) - 1) AS INT) AS y, lat FROM t)
 SELECT id, z, x, y, CAST(pow(2, z) - 1 - y AS INT) AS tms, x // 2 AS parent_x, round(x/pow(2, z)*360 - 180, 6) AS west, round(degrees(atan(sinh(pi()*(1 - 2*y/pow(2, z))))), 6) AS north,
 round(156543.03392804097e0*cos(radians(lat))/pow(2, z), 4) AS m_px FROM u""")
def _(spark, sf):
    z = F.col("z")
    t = derived(spark, sf, "points").withColumn("z", 3 + F.col("id") % 15)
    t = t.withColumn("x", tiles.tile_x(F.col("lon"), z)).withColumn("y", tiles.tile_y(F.col("lat"), z))
    b = tiles.tile_bounds(F.col("x"), F.col("y"), z)
    return t.select("id", "z", "x", "y", tiles.tms_row(F.col("y"), z).alias("tms"), tiles.parent(F.col("x")).alias("parent_x"),
                    F.round(b.w, 6).alias("west"), F.round(b.n, 6).alias("north"), F.round(tiles.m_per_pixel(z, F.col("lat")), 4).alias("m_px"))


@query("J1_coverage_overlap", with_ctes("boxes", "areas") + f"""SELECT cov_id, area_id FROM boxes, areas WHERE c_s <= q_n AND q_s <= c_n AND {sql_lon_overlap('c_w', 'c_e', 'q_w', 'q_e')}""")
def _(spark, sf):
    return cat.coverage_overlap(derived(spark, sf, "boxes"), derived(spark, sf, "areas")).select("cov_id", "area_id")


@query("U4_antimeridian_split", with_ctes("boxes") + """SELECT cov_id, round(c_w, 6) AS w, CASE WHEN c_w > c_e THEN 180e0 ELSE round(c_e, 6) END AS e FROM boxes
 UNION ALL SELECT cov_id, -180e0, round(c_e, 6) FROM boxes WHERE c_w > c_e""")
def _(spark, sf):
    return derived(spark, sf, "boxes").select("cov_id", F.inline(geo.box_parts(*[F.col(c) for c in ("c_s", "c_w", "c_n", "c_e")]))).select(
        "cov_id", F.round("w", 6).alias("w"), F.round("e", 6).alias("e"))


POST = with_ctes("town", "stops")


@query("J3_nearest_node", POST + f""", d AS (SELECT sid, id, {sql_plane('slat', 'slon', 'lat', 'lon')} AS d FROM stops, town)
 SELECT sid, id, round(d, 3) AS distance_m FROM d WHERE d <= 400 QUALIFY row_number() OVER (PARTITION BY sid ORDER BY round(d, 6), id) = 1""")
def _(spark, sf):
    n = sp.nearest(derived(spark, sf, "stops"), derived(spark, sf, "town"), "sid", "slat", "slon", "id", "lat", "lon", 400.0)
    return n.select("sid", "id", F.round("distance_m", 3).alias("distance_m"))


def segments(spark, sf):
    """Streets of all lengths: each town point to the point 37 keys on."""
    t = derived(spark, sf, "town")
    b = t.select((F.col("id") - 37).alias("id"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    return t.select("id", F.col("lat").alias("alat"), F.col("lon").alias("alon")).join(b.hint("merge"), "id").withColumnRenamed("id", "seg")


SEGS = POST + """, segs AS (SELECT a.id AS seg, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon FROM town a JOIN town b ON b.id = a.id + 37), v AS (SELECT sid, seg, (alon - slon)*111195.08023353292e0*cos(radians(slat)) AS ax, (alat - slat)*111195.08023353292e0 AS ay,
 (blon - slon)*111195.08023353292e0*cos(radians(slat)) AS bx, (blat - slat)*111195.08023353292e0 AS by_ FROM stops, segs),
 t AS (SELECT *, least(1e0, greatest(0e0, -(ax*(bx - ax) + ay*(by_ - ay))/((bx - ax)*(bx - ax) + (by_ - ay)*(by_ - ay)))) AS t FROM v),
 d AS (SELECT sid, seg, sqrt(pow(ax + t*(bx - ax), 2) + pow(ay + t*(by_ - ay), 2)) AS d, t*sqrt((bx - ax)*(bx - ax) + (by_ - ay)*(by_ - ay)) AS along FROM t) """


@query("J2_F3_nearest_road", SEGS + "SELECT sid, seg, round(d, 3) AS distance_m, round(along, 2) AS along_m FROM d WHERE d <= 150 QUALIFY row_number() OVER (PARTITION BY sid ORDER BY round(d, 7), seg) = 1")
def _(spark, sf):
    pts = derived(spark, sf, "stops").select(F.col("sid").alias("pid"), F.col("slat").alias("lat"), F.col("slon").alias("lon"))
    n = sp.nearest_segment(pts, segments(spark, sf), 150.0)
    return n.select(F.col("pid").alias("sid"), "seg", F.round("distance_m", 3).alias("distance_m"), F.round("along_m", 2).alias("along_m"))


@query("J4_roads_in_radius", SEGS + "SELECT sid, seg, round(d, 3) AS distance_m FROM d WHERE d <= 40")
def _(spark, sf):
    return cat.roads_in_radius(derived(spark, sf, "stops"), segments(spark, sf), 40.0).select("sid", "seg", F.round("distance_m", 3).alias("distance_m"))


@query("J25_U5_tiles_covering", with_ctes("boxes") + """, p AS (SELECT cov_id, c_s AS s, c_w AS w, c_n AS n, CASE WHEN c_w > c_e THEN 180e0 ELSE c_e END AS e FROM boxes UNION ALL SELECT cov_id, c_s, -180e0, c_n, c_e FROM boxes WHERE c_w > c_e),
 r AS (SELECT cov_id, CAST(floor((w + 180)/360*128) AS INT) AS x0, CAST(least(floor((e + 180)/360*128), 127) AS INT) AS x1,
 CAST(floor((1 - asinh(tan(radians(n)))/pi())/2*128) AS INT) AS y0, CAST(floor((1 - asinh(tan(radians(s)))/pi())/2*128) AS INT) AS y1 FROM p)
 SELECT DISTINCT cov_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM r, range(0, 128) a(x), range(0, 128) b(y) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def _(spark, sf):
    return sp.tile_cover(derived(spark, sf, "boxes"), ("c_s", "c_w", "c_n", "c_e"), 7).select("cov_id", "x", "y")


# --- catalog --------------------------------------------------------------------------------------

@query("A8_source_counts", with_ctes("boxes") + """SELECT CAST(n_nationkey AS INT) AS source_id, count(cov_id) AS frames FROM nation LEFT JOIN boxes ON source_id = n_nationkey GROUP BY 1""")
def _(spark, sf):
    return cat.frames_per_source(table(spark, sf, "nation").select(F.col("n_nationkey").alias("source_id")), derived(spark, sf, "boxes"))


SERIES = """s AS (SELECT n_nationkey AS series_id, CASE WHEN n_nationkey % 6 = 0 THEN 0 ELSE (n_nationkey + 1)*25000 END AS denom FROM nation)"""


@query("O4_best_series", f"""WITH {SERIES}, q AS (SELECT o_orderkey AS qid, 10000 + (o_orderkey*37) % 900000 AS target FROM orders)
 SELECT qid, CAST(series_id AS INT) AS series_id FROM q, s WHERE denom > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(abs(ln(denom/CAST(target AS DOUBLE))), 12), series_id) = 1""")
def _(spark, sf):
    s = table(spark, sf, "nation").select(F.col("n_nationkey").alias("series_id"), F.when(F.col("n_nationkey") % 6 == 0, 0).otherwise((F.col("n_nationkey") + 1) * 25000).alias("denom"))
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), (10000 + (F.col("o_orderkey") * 37) % 900000).alias("target"))
    return cat.best_series(s, q)


@query("F33_series_scale", """SELECT n_nationkey AS series_id, CASE n_nationkey % 4 WHEN 0 THEN 'GNC' WHEN 1 THEN 'JNC 1:2 M' WHEN 2 THEN 'TPC 1:500 K' ELSE 'ATC 1:50 K' END AS title,
 CASE n_nationkey % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 2e6 WHEN 2 THEN 5e5 ELSE 5e4 END AS denom FROM nation""")
def _(spark, sf):
    k = F.col("n_nationkey") % 4
    key = F.element_at(F.array(*[F.lit(x) for x in ("GNC", "JNC", "TPC", "ATC")]), (k + 1).cast("int"))
    scale = F.element_at(F.array(*[F.lit(x) for x in (0.0, 2e6, 5e5, 5e4)]), (k + 1).cast("int"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("series_id"), cat.series_title(key, scale).alias("title"),
                                             cat.scale_denom(scale, F.lit("denominator")).alias("denom"))


@query("M6_register_sources", """WITH a AS (SELECT DISTINCT 'src' || CAST(p_size % 20 AS VARCHAR) AS path, p_type AS format FROM part), e AS (SELECT path, format, row_number() OVER (ORDER BY path, format) AS id FROM a WHERE format <> 'PROMO')
 SELECT id, path, format FROM e UNION ALL SELECT (SELECT max(id) FROM e) + row_number() OVER (ORDER BY path, format), path, format FROM a WHERE format = 'PROMO'""")
def _(spark, sf):
    a = table(spark, sf, "part").select(F.concat(F.lit("src"), (F.col("p_size") % 20).cast("string")).alias("path"), F.col("p_type").alias("format"))
    have = cat.register(a.filter("format <> 'PROMO'").sparkSession.createDataFrame([], "id long, path string, format string"), a.filter("format <> 'PROMO'"), ["path", "format"])
    return cat.register(have, a, ["path", "format"])


@query("U7_replace_source", with_ctes("boxes") + """SELECT cov_id, source_id FROM boxes WHERE source_id <> 3 UNION ALL SELECT cov_id + 1000000, 3 FROM boxes WHERE source_id = 5""")
def _(spark, sf):
    b = derived(spark, sf, "boxes").select("cov_id", "source_id")
    fresh = b.filter("source_id = 5").select((F.col("cov_id") + 1000000).alias("cov_id"), F.lit(3).cast("long").alias("source_id"))
    return cat.replace_source(b, fresh, 3)


@query("J33_usage_band", """WITH t AS (SELECT CAST(o_orderkey % 97 AS BIGINT) AS x, CAST((o_orderkey // 97) % 89 AS BIGINT) AS y, 1 + o_orderkey % 4 AS band, o_orderkey AS cell FROM orders)
 SELECT x, y, band, cell FROM t WHERE band <= 3 QUALIFY rank() OVER (PARTITION BY x, y ORDER BY band DESC) = 1""")
def _(spark, sf):
    k = F.col("o_orderkey")
    c = table(spark, sf, "orders").select((k % 97).alias("x"), (F.floor(k / 97) % 89).alias("y"), (1 + k % 4).alias("band"), k.alias("cell"))
    return cat.cells_for_band(c, 3)


# --- search ---------------------------------------------------------------------------------------

def search_rows(spark, sf):
    p = derived(spark, sf, "points")
    return p.select("provider", F.col("provider").alias("provider_rank"), F.col("id").alias("seq"), F.concat(F.col("layer"), F.lit(" "), F.col("title")).alias("title"), "lat", "lon")


@query("O2_O3_W16_search", with_ctes("points") + f""", r AS (SELECT provider, id AS seq, layer || ' ' || title AS title, lat, lon FROM points),
 m AS (SELECT *, CASE WHEN starts_with(lower(title), 'mach') THEN 1 ELSE -1 END AS q FROM r), c AS (SELECT * FROM m WHERE q >= 0 QUALIFY row_number() OVER (PARTITION BY provider ORDER BY seq) <= 50)
 SELECT provider, seq, title, CAST(q AS INT) AS match_quality, round({sql_plane('10e0', '20e0', 'lat', 'lon')}, 1) AS distance_m FROM c ORDER BY q, {sql_plane('10e0', '20e0', 'lat', 'lon')}, provider, seq LIMIT 60""")
def _(spark, sf):
    r = srch.search(search_rows(spark, sf), "Mach ", near=(10.0, 20.0), per_provider=50, limit=60)
    return r.select("provider", "seq", "title", "match_quality", F.round("distance_m", 1).alias("distance_m"))


@query("P10_radius_cut", with_ctes("points") + f"""SELECT id AS seq, round({sql_plane('-5e0', '178e0', 'lat', 'lon')}, 1) AS distance_m FROM points WHERE {sql_plane('-5e0', '178e0', 'lat', 'lon')} <= 2e6""")
def _(spark, sf):
    return srch.search(search_rows(spark, sf), "", near=(-5.0, 178.0), radius_m=2e6).select("seq", F.round("distance_m", 1).alias("distance_m"))


@query("P9_area_test", with_ctes("points") + "SELECT id FROM points WHERE lat BETWEEN -10 AND 30 AND (lon >= 160 OR lon <= -150)")
def _(spark, sf):
    return derived(spark, sf, "points").filter(geo.box_contains(F.col("lat"), F.col("lon"), -10.0, 160.0, 30.0, -150.0)).select("id")


@query("U2_provider_union", with_ctes("points", "town") + """SELECT 'world' AS provider, id AS feature, title FROM points UNION ALL SELECT 'town', id, title FROM town""")
def _(spark, sf):
    return srch.union_providers({"world": derived(spark, sf, "points").select(F.col("id").alias("feature"), "title"),
                                 "town": derived(spark, sf, "town").select(F.col("id").alias("feature"), "title")})


@query("O5_name_lookup", with_ctes("points") + "SELECT id, layer || title AS name, id % 9 AS min_zoom FROM points WHERE starts_with(lower(layer || title), 'fur') ORDER BY id % 9, layer || title LIMIT 40")
def _(spark, sf):
    n = derived(spark, sf, "points").select("id", F.concat("layer", "title").alias("name"), (F.col("id") % 9).alias("min_zoom"))
    return srch.name_lookup(n, "fur", 40)


def dup_rows(spark, sf):
    t = derived(spark, sf, "town")
    return t.select(F.col("id").alias("rank"), F.col("layer").alias("kind"), F.concat(F.lit("Name  "), (F.col("id") % 5).cast("string")).alias("title"), "lat", "lon",
                    F.col("lat").alias("s"), F.col("lon").alias("w"), (F.col("lat") + 0.0005).alias("n"), (F.col("lon") + 0.0005).alias("e"))


@query("J30_drop_duplicates", None)
def _(spark, sf):
    return srch.drop_duplicates(dup_rows(spark, sf), 150.0).select("rank", "kind", "title")


def pieces(spark, sf):
    o = derived(spark, sf, "stops")
    k = F.col("sid")
    return o.select(k.alias("seq"), F.concat(F.lit("Road "), (k % 40).cast("string")).alias("title"), F.lit("roads").alias("layer"),
                    F.col("slat").alias("s"), F.col("slon").alias("w"), (F.col("slat") + 0.0001).alias("n"), (F.col("slon") + 0.0001 * (1 + k % 3)).alias("e"),
                    F.col("slat").alias("anchor_lat"), F.col("slon").alias("anchor_lon"), (k % 4).alias("quality"), (k % 11).alias("rank"))


@query("A11_merge_pieces", None)
def _(spark, sf):
    return srch.merge_pieces(pieces(spark, sf), 60.0, ["title", "layer"])


@query("A12_chart_names", None)
def _(spark, sf):
    return srch.chart_names(pieces(spark, sf).withColumn("band", F.col("seq") % 6), 200.0)


@query("G7_components", """WITH RECURSIVE e AS (SELECT DISTINCT a.id AS u, a.id + 37 AS v FROM (SELECT c_custkey AS id FROM customer) a WHERE a.id % 37 < 9 AND a.id + 37 IN (SELECT c_custkey FROM customer)),
 b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(node, label) AS (SELECT u, u FROM b UNION SELECT b.v, least(r.label, b.v) FROM r JOIN b ON b.u = r.node)
 SELECT node, min(label) AS label FROM r GROUP BY node""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    e = c.filter(F.col("id") % 37 < 9).select(F.col("id").alias("u"), (F.col("id") + 37).alias("v")).join(c.select(F.col("id").alias("v")).hint("merge"), "v", "left_semi")
    return components(e)


# --- tile packs -------------------------------------------------------------------------------------

def tile_table(spark, sf):
    k = F.col("o_orderkey")
    z = (2 + k % 8).cast("int")
    n = tiles.per_axis(z).cast("long")
    return table(spark, sf, "orders").select(z.alias("z"), (F.pmod(k * 7919, n)).cast("int").alias("x"), (F.pmod(k * 104729, n)).cast("int").alias("y"), k.alias("fid"))


TT = "tt AS (SELECT CAST(2 + o_orderkey % 8 AS INT) AS z, CAST(o_orderkey*7919 % CAST(pow(2, 2 + o_orderkey % 8) AS BIGINT) AS INT) AS x, CAST(o_orderkey*104729 % CAST(pow(2, 2 + o_orderkey % 8) AS BIGINT) AS INT) AS y, o_orderkey AS fid FROM orders)"


@query("S12_tms_rows", f"WITH {TT} SELECT z, x, CAST(pow(2, z) - 1 - y AS INT) AS tms_row, count(*) AS n FROM tt GROUP BY ALL")
def _(spark, sf):
    return tilepack.from_tms(tile_table(spark, sf).withColumnRenamed("y", "tile_row")).groupBy("z", "x", F.col("y").alias("tms_row")).agg(F.count("*").alias("n"))


@query("A9_zoom_extent", f"WITH {TT} SELECT z, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS tiles FROM (SELECT DISTINCT z, x, y FROM tt) GROUP BY z")
def _(spark, sf):
    return tilepack.zoom_extent(tile_table(spark, sf).select("z", "x", "y").distinct())


@query("S21_cut_tiles", f"""WITH {TT}, d AS (SELECT DISTINCT z, x, y FROM tt) SELECT z, x, y FROM d WHERE z BETWEEN 3 AND 8 AND
 x BETWEEN floor((-100 + 180)/360e0*pow(2, z)) AND floor((-20 + 180)/360e0*pow(2, z)) AND y BETWEEN floor((1 - asinh(tan(radians(50e0)))/pi())/2*pow(2, z)) AND floor((1 - asinh(tan(radians(10e0)))/pi())/2*pow(2, z))""")
def _(spark, sf):
    return tilepack.cut(tile_table(spark, sf).select("z", "x", "y").distinct(), (10.0, -100.0, 50.0, -20.0), 3, 8)


@query("J26_tile_membership", f"""WITH {TT}, old AS (SELECT z, x, y, fid % 900 AS fid FROM tt WHERE fid % 2 = 0), fresh AS (SELECT z, x, y, fid % 900 AS fid FROM tt WHERE fid % 3 = 0),
 done AS (SELECT DISTINCT z, x, y FROM fresh), kept AS (SELECT o.* FROM old o ANTI JOIN done USING (z, x, y)), m AS (SELECT fid FROM kept UNION SELECT fid FROM fresh)
 SELECT DISTINCT fid FROM old WHERE fid NOT IN (SELECT fid FROM m)""")
def _(spark, sf):
    t = tile_table(spark, sf)
    old, fresh = [t.filter(F.col("fid") % k == 0).withColumn("fid", F.col("fid") % 900) for k in (2, 3)]
    return tilepack.dropped_features(old, fresh)


@query("M10_tile_upkeep", None)
def _(spark, sf):
    t = tile_table(spark, sf)
    state = t.groupBy("z", "x", "y").agg(F.max("fid").alias("fetched_at"), F.count("*").alias("pages"), F.max(F.col("fid") % 10 == 0).alias("failed"))
    return tilepack.resolve(state, t.select((F.col("z") + 1).alias("z"), (F.col("x") * 2).alias("x"), (F.col("y") * 2 + 1).alias("y")).distinct(), now=15000, stale_after=9000, retry_after=60)


@query("T18_tile_refresh", f"""WITH {TT}, s AS (SELECT z, x, y, max(fid) AS fetched_at, max(CASE WHEN fid % 10 = 0 THEN 1 ELSE 0 END) = 1 AS failed FROM tt GROUP BY ALL)
 SELECT z, x, y, CASE WHEN failed THEN 'retry' ELSE 'stale' END AS reason FROM s WHERE (failed AND fetched_at <= 15000 - 60) OR (NOT failed AND fetched_at < 15000 - 9000)""")
def _(spark, sf):
    t = tile_table(spark, sf).groupBy("z", "x", "y").agg(F.max("fid").alias("fetched_at"), F.max(F.col("fid") % 10 == 0).alias("failed"))
    return tilepack.to_refresh(t, now=15000, stale_after=9000, retry_after=60)


@query("G8_adaptive_tiles", None)
def _(spark, sf):
    return tilepack.adaptive_tiles(derived(spark, sf, "points"), limit=40, z_min=0, z_max=8)


@query("A27_pack_completeness", f"""WITH {TT}, s AS (SELECT z, x, y, count(DISTINCT fid) AS f FROM tt GROUP BY ALL) SELECT count(*) AS tiles, CAST(sum(f) AS BIGINT) AS features, bool_or(f >= 5) AS capped FROM s""")
def _(spark, sf):
    return tilepack.completeness(tile_table(spark, sf), cap=5)
