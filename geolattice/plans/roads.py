"""Road graph, routing and legend queries over a street grid derived from orders."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cost as co, geo, tags as tg
from ..operators import arc_routes as ar, osm, routing as rt, tracks as tr
from ..session import written
from .derived import derived, rounded, table, with_ctes
from .registry import query

HIGHWAYS = ["motorway", "primary", "residential", "cycleway", "footway", "service", "track", "secondary", "trunk"]


def osm_ways(spark, sf):
    k = F.col("o_orderkey")
    horiz, row, col = k % 2 == 0, F.floor(k / 60), (k * 7) % 97
    refs = F.transform(F.sequence(F.lit(0), (2 + k % 5).cast("int")), lambda i: ((row + F.when(horiz, 0).otherwise(i)) * 128 + col + F.when(horiz, i).otherwise(0)).cast("long"))

    def pick(n, *words):
        out = F.lit(None).cast("string")
        for i, w in enumerate(words):
            out = F.when(k % n == i, w).otherwise(out)
        return out
    cells = {"highway": pick(9, *HIGHWAYS), "oneway": pick(11, "yes", "-1", "no"), "access": pick(13, "no", "private"),
             "maxspeed": pick(7, "30 mph", "50", "walk"), "toll": pick(17, "yes"), "surface": pick(5, "asphalt", "gravel", "mud"),
             "lanes": pick(6, "2", "4;5"), "bicycle": pick(8, "yes"), "cycleway:right": pick(10, "lane", "track")}
    pairs = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(n).alias("key"), v.alias("value"))) for n, v in cells.items()]))
    # one-element explode keeps the derived map from being rebuilt inside every tag reader
    return table(spark, sf, "orders").repartition("o_orderkey").select(k.alias("way"), refs.alias("refs"), F.explode(F.array(F.map_from_entries(pairs))).alias("tags"))


def osm_nodes(spark, sf):
    """Every referenced node but one in 53 (a clipped extract)."""
    n = osm_ways(spark, sf).select(F.explode("refs").alias("node")).distinct().filter("node % 53 <> 0")
    return n.select("node", (32 + F.floor(F.col("node") / 128) * 0.001).alias("lat"), (-80 + (F.col("node") % 128) * 0.0012).alias("lon"))


HW = "CASE k % 9 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HIGHWAYS)) + " END"
WAYS = f"""WITH w0 AS (SELECT o_orderkey AS k FROM orders), ways AS (SELECT k AS way, {HW} AS klass, CASE k % 11 WHEN 0 THEN 'forward' WHEN 1 THEN 'backward' WHEN 2 THEN 'both' ELSE CASE WHEN k % 9 = 0 THEN 'forward' ELSE 'both' END END AS dir,
 k % 13 = 0 AS shut, k % 13 = 1 AS private, k % 8 = 0 AS bike_yes FROM w0),
 refs AS (SELECT k AS way, CAST(i AS INT) AS pos, CAST((k // 60 + CASE WHEN k % 2 = 0 THEN 0 ELSE i END)*128 + (k*7) % 97 + CASE WHEN k % 2 = 0 THEN i ELSE 0 END AS BIGINT) AS node, 3 + k % 5 AS n FROM w0, range(0, 7) r(i) WHERE i < 3 + k % 5),
 nodes AS (SELECT DISTINCT node, 32 + (node // 128)*0.001e0 AS lat, -80 + (node % 128)*0.0012e0 AS lon FROM refs WHERE node % 53 <> 0),
 kept AS (SELECT * FROM ways WHERE NOT (shut AND NOT bike_yes)), krefs AS (SELECT * FROM refs WHERE way IN (SELECT way FROM kept)),
 use AS (SELECT node, count(*) AS uses, bool_or(pos = 0 OR pos = n - 1) AS is_end FROM krefs GROUP BY node),
 pts AS (SELECT way, pos, k.node, lat, lon, CAST(sum(CASE WHEN lat IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY way ORDER BY pos) AS BIGINT) AS run FROM krefs k LEFT JOIN nodes USING (node)),
 seg AS (SELECT way, run, pos, pts.node, lat, lon, uses > 1 OR is_end AS j, lead(pts.node) OVER w AS tn, lead(lat) OVER w AS tlat, lead(lon) OVER w AS tlon FROM pts JOIN use USING (node) WHERE lat IS NOT NULL WINDOW w AS (PARTITION BY way, run ORDER BY pos)),
 cut AS (SELECT *, sum(CASE WHEN j THEN 1 ELSE 0 END) OVER (PARTITION BY way, run ORDER BY pos) AS piece FROM seg WHERE tn IS NOT NULL),
 edges AS MATERIALIZED (SELECT way, way*1048576 + min(pos) AS edge, arg_min(node, pos) AS src, arg_max(tn, pos) AS dst, round(sum(2*6371008.8e0*asin(sqrt(pow(sin(radians(tlat - lat)/2), 2) + cos(radians(lat))*cos(radians(tlat))*pow(sin(radians(tlon - lon)/2), 2)))), 3) AS length_m FROM cut GROUP BY way, run, piece),
 arcs AS MATERIALIZED (SELECT edge*2 AS arc, edge, way, src, dst, length_m, klass FROM edges JOIN kept USING (way) WHERE dir <> 'backward' UNION ALL SELECT edge*2 + 1, edge, way, dst, src, length_m, klass FROM edges JOIN kept USING (way) WHERE dir <> 'forward') """


def kept(spark, sf):
    return osm.kept_ways(osm_ways(spark, sf))


def edges(spark, sf):
    return osm.build_edges(kept(spark, sf), osm_nodes(spark, sf))


def grid_arcs(spark, sf):
    """The street graph as a stored table."""
    return written(osm.build_arcs(edges(spark, sf), kept(spark, sf)), "arcs")


TAGS = with_ctes("tags")


def tag_rows(spark, sf):
    t = derived(spark, sf, "tags")
    keys = [c for c in t.columns if c != "way"]
    pairs = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))) for c in keys]))
    return t.select("way", F.explode(F.array(F.map_from_entries(pairs))).alias("tags"))


@query("F25_tag_readers", TAGS + """SELECT way, CASE WHEN maxspeed = '30 mph' THEN 48 WHEN maxspeed = '50' THEN 50 WHEN maxspeed = 'walk' THEN 5 WHEN maxspeed = '400' THEN 255 WHEN maxspeed = '55 mph' THEN 89 ELSE 0 END AS kph,
 CASE lanes WHEN '2' THEN 2 WHEN '4;5' THEN 4 ELSE 0 END AS lanes, CASE duration WHEN '00:30' THEN 1800 WHEN '01:10:05' THEN 4205 WHEN '45' THEN 2700 ELSE 0 END AS duration_s,
 CASE surface WHEN 'asphalt' THEN 'paved' WHEN 'cobblestone' THEN 'compacted' WHEN 'gravel' THEN 'rough' WHEN 'mud' THEN 'rough' ELSE 'unknown' END AS surface,
 CASE coalesce(bicycle, access) WHEN 'no' THEN 'no' WHEN 'private' THEN 'private' WHEN NULL THEN NULL ELSE CASE WHEN coalesce(bicycle, access) IS NOT NULL THEN 'allowed' END END AS bicycle,
 CASE coalesce(foot, access) WHEN 'no' THEN 'no' WHEN 'private' THEN 'private' ELSE CASE WHEN coalesce(foot, access) IS NOT NULL THEN 'allowed' END END AS foot,
 CASE WHEN oneway = 'yes' THEN 'forward' WHEN oneway = '-1' THEN 'backward' WHEN oneway = 'no' THEN 'both' WHEN route IS DISTINCT FROM 'ferry' AND highway = 'motorway' THEN 'forward' ELSE 'both' END AS dir FROM tags""")
def _(spark, sf):
    t, e = F.col("tags"), F.lit("")
    return tag_rows(spark, sf).select(
        "way", tg.maxspeed_kph(F.coalesce(tg.tag(t, "maxspeed"), e)).alias("kph"), tg.lanes(F.coalesce(tg.tag(t, "lanes"), e)).alias("lanes"),
        tg.duration_s(F.coalesce(tg.tag(t, "duration"), e)).alias("duration_s"), tg.surface_class(tg.tag(t, "surface")).alias("surface"),
        tg.access(t, "bicycle", "vehicle", "access").alias("bicycle"), tg.access(t, "foot", "access").alias("foot"), tg.direction(t, tg.road_class(t)).alias("dir"))


@query("P17_way_verdict", TAGS + """SELECT way, CASE WHEN route IS DISTINCT FROM 'ferry' AND highway IS NULL THEN 'not road'
 WHEN coalesce(bicycle, access) = 'no' AND coalesce(foot, access) = 'no' AND coalesce(motor_vehicle, access) = 'no' THEN 'no access' WHEN area = 'yes' THEN 'not road' ELSE 'kept' END AS verdict FROM tags""")
def _(spark, sf):
    return tag_rows(spark, sf).select("way", tg.verdict(F.col("tags")).alias("verdict"))


@query("A7_build_stats", TAGS + """, v AS (SELECT CASE WHEN route IS NOT DISTINCT FROM 'ferry' THEN 'ferry' ELSE coalesce(highway, 'none') END AS klass, CASE WHEN route IS DISTINCT FROM 'ferry' AND highway IS NULL THEN 'x'
 WHEN coalesce(bicycle, access) = 'no' AND coalesce(foot, access) = 'no' AND coalesce(motor_vehicle, access) = 'no' THEN 'n' WHEN area = 'yes' THEN 'x' ELSE 'k' END AS v,
 oneway IN ('yes', '-1') OR (oneway IS NULL AND highway = 'motorway' AND route IS DISTINCT FROM 'ferry') AS ow, coalesce(bicycle, access) = 'private' AS pb FROM tags)
 SELECT klass, count(*) AS ways, count(*) FILTER (WHERE v = 'k') AS kept, count(*) FILTER (WHERE v = 'n') AS no_access, count(*) FILTER (WHERE ow) AS oneway, count(*) FILTER (WHERE pb) AS private_bicycle FROM v GROUP BY ROLLUP (klass)""")
def _(spark, sf):
    return osm.build_stats(tag_rows(spark, sf))


@query("F27_J34_class_constants", TAGS + """SELECT way, CASE klass WHEN 'motorway' THEN 110 WHEN 'primary' THEN 80 WHEN 'residential' THEN 35 WHEN 'cycleway' THEN 15 WHEN 'footway' THEN 5 WHEN 'service' THEN 20 WHEN 'track' THEN 20 WHEN 'trunk' THEN 90 WHEN 'ferry' THEN 20 END AS kph,
 klass IN ('motorway', 'primary', 'residential', 'service', 'track', 'trunk', 'ferry') AS driveable, CASE klass WHEN 'trunk' THEN 3 WHEN 'primary' THEN 2 ELSE 0 END AS met, CASE klass WHEN 'trunk' THEN 3 WHEN 'motorway' THEN 3 WHEN 'primary' THEN 2 ELSE 0 END AS ridden
 FROM (SELECT way, CASE WHEN route IS NOT DISTINCT FROM 'ferry' THEN 'ferry' ELSE highway END AS klass FROM tags) WHERE klass IS NOT NULL""")
def _(spark, sf):
    k = F.col("klass")
    t = tag_rows(spark, sf).select("way", tg.road_class(F.col("tags")).alias("klass")).filter(k.isNotNull())
    return t.select("way", tg.default_kph(k).alias("kph"), tg.driveable(k).alias("driveable"), tg.crossing_level(k, False).alias("met"), tg.crossing_level(k, True).alias("ridden"))


@query("J28_tag_disagreements", TAGS + """, r AS (SELECT way, CASE coalesce(bicycle, access) WHEN 'no' THEN 'no' WHEN 'private' THEN 'private' ELSE CASE WHEN coalesce(bicycle, access) IS NOT NULL THEN 'allowed' END END AS a,
 CASE coalesce(access, bicycle) WHEN 'no' THEN 'no' WHEN 'private' THEN 'private' ELSE CASE WHEN coalesce(access, bicycle) IS NOT NULL THEN 'allowed' END END AS b FROM tags) SELECT way, 'bicycle' AS field, a, b FROM r WHERE a IS DISTINCT FROM b""")
def _(spark, sf):
    t = F.col("tags")
    return osm.tag_disagreements(tag_rows(spark, sf), {"bicycle": tg.access(t, "bicycle", "vehicle", "access"), "foot": tg.access(t, "foot", "access")},
                                 {"bicycle": tg.access(t, "access", "vehicle", "bicycle"), "foot": tg.access(t, "foot", "access")})


@query("J5_way_points", WAYS + "SELECT way, pos, node, run FROM pts WHERE lat IS NOT NULL")
def _(spark, sf):
    return osm.way_points(kept(spark, sf), osm_nodes(spark, sf)).select("way", "pos", "node", "run")


@query("A13_vertex_use", WAYS + "SELECT node, uses, is_end FROM use")
def _(spark, sf):
    return osm.vertex_use(kept(spark, sf)).select("node", "uses", "is_end")


@query("G1_road_graph", WAYS + "SELECT arc, edge, way, src, dst, length_m, klass FROM arcs")
def _(spark, sf):
    a = osm.build_arcs(edges(spark, sf), kept(spark, sf))
    return a.select("arc", "edge", "way", "src", "dst", F.round("length_m", 3).alias("length_m"), "klass")


@query("J10_twin_arcs", WAYS + "SELECT a.arc, max(CASE WHEN b.arc <> a.arc THEN b.arc END) AS twin FROM arcs a JOIN (SELECT arc, edge FROM arcs) b ON b.edge = a.edge GROUP BY a.arc")
def _(spark, sf):
    return osm.twin_arcs(grid_arcs(spark, sf))


@query("G2_crossings", WAYS + """, lv AS (SELECT *, CASE klass WHEN 'trunk' THEN 3 WHEN 'primary' THEN 2 WHEN 'secondary' THEN 1 ELSE 0 END AS met, CASE klass WHEN 'trunk' THEN 3 WHEN 'motorway' THEN 3 WHEN 'primary' THEN 2 WHEN 'secondary' THEN 1 ELSE 0 END AS own FROM arcs),
 sg AS (SELECT arc FROM arcs WHERE dst % 10 = 0), en AS (SELECT DISTINCT src AS node, edge, met FROM lv UNION SELECT dst, edge, met FROM lv), o AS (SELECT a.arc, max(b.met) AS m FROM lv a JOIN en b ON b.node = a.dst AND b.edge <> a.edge GROUP BY a.arc)
 SELECT arc, arc IN (SELECT arc FROM sg) AS signal, CASE WHEN arc NOT IN (SELECT arc FROM sg) AND m > own THEN m ELSE 0 END AS crossing FROM lv LEFT JOIN o USING (arc)""")
def _(spark, sf):
    a = grid_arcs(spark, sf)
    return osm.crossings(a, a.filter("dst % 10 = 0").select("arc"))


@query("J8_signal_arcs", WAYS + """, sh AS (SELECT way*1048576 + min(pos) OVER (PARTITION BY way, run, piece) AS edge, way, pos, node, tn, 2*6371008.8e0*asin(sqrt(pow(sin(radians(tlat - lat)/2), 2) + cos(radians(lat))*cos(radians(tlat))*pow(sin(radians(tlon - lon)/2), 2))) AS m FROM cut),
 ac AS (SELECT edge, edge*2 AS arc, node, tn, sum(m) OVER (PARTITION BY edge ORDER BY pos DESC) AS d, pos, min(pos) OVER (PARTITION BY edge) AS lo, 1 AS fwd FROM sh JOIN kept USING (way) WHERE dir <> 'backward'
 UNION ALL SELECT edge, edge*2 + 1, tn, node, sum(m) OVER (PARTITION BY edge ORDER BY pos), -pos, min(-pos) OVER (PARTITION BY edge), 0 FROM sh JOIN kept USING (way) WHERE dir <> 'forward')
 SELECT arc FROM arcs WHERE dst % 10 = 0 UNION SELECT arc FROM ac WHERE node % 10 = 0 AND pos > lo AND d <= 120""")
def _(spark, sf):
    n = osm_nodes(spark, sf)
    return osm.signal_arcs(grid_arcs(spark, sf), n.filter("node % 10 = 0").select("node"), 120.0)


@query("J7_barrier_edges", WAYS + """, b AS (SELECT node, CASE node % 3 WHEN 0 THEN 2 ELSE 0 END AS motor, CASE WHEN node % 4 = 1 THEN 1 ELSE 0 END AS bike FROM nodes WHERE node % 7 = 1), role AS (SELECT node, way, bool_and(pos = 0 OR pos = n - 1) AS ends FROM krefs WHERE node IN (SELECT node FROM b) GROUP BY node, way),
 mix AS (SELECT node, bool_or(ends) AND bool_or(NOT ends) AS m FROM role GROUP BY node), g AS (SELECT node, way FROM role JOIN mix USING (node) WHERE NOT m OR ends), e AS (SELECT edge, way, src AS node FROM edges UNION SELECT edge, way, dst FROM edges)
 SELECT edge, CASE max(greatest(bike, 0)) WHEN 1 THEN 'private' ELSE 'allowed' END AS bicycle, CASE max(greatest(motor, bike)) WHEN 2 THEN 'no' WHEN 1 THEN 'private' ELSE 'allowed' END AS motor FROM e JOIN g USING (node, way) JOIN b USING (node) GROUP BY edge""")
def _(spark, sf):
    n = osm_nodes(spark, sf).filter("node % 7 = 1")
    k = F.col("node")
    t = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("barrier").alias("key"), F.when(k % 3 == 0, "bollard").otherwise("gate").alias("value")),
                                                   F.when(k % 4 == 1, F.struct(F.lit("access").alias("key"), F.lit("private").alias("value"))),
                                                   F.when((k % 4 == 1) & (k % 3 == 0), F.struct(F.lit("motor_vehicle").alias("key"), F.lit("no").alias("value"))))))
    b = n.select("node", tg.barrier_access(t).alias("imposed"))
    w = kept(spark, sf)
    return osm.barrier_edges(osm.build_edges(w, osm_nodes(spark, sf)), w, b).select("edge", "bicycle", "motor")


@query("J6_bike_routes", WAYS + """, rel AS (SELECT k AS id, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 1 END AS rank FROM w0 WHERE k % 3 = 0), m AS (SELECT rank, (id*5 + i*7) % 4000 AS way, (id + i) % 3 AS role FROM rel, range(0, 4) r(i))
 SELECT way, coalesce(max(CASE WHEN role <> 2 THEN rank END), 0) AS route_fwd, coalesce(max(CASE WHEN role <> 1 THEN rank END), 0) AS route_bwd FROM m WHERE way IN (SELECT way FROM kept) GROUP BY way""")
def _(spark, sf):
    k = F.col("o_orderkey")
    net = F.when(k % 4 == 0, "ncn").when(k % 4 == 1, "rcn").when(k % 4 == 2, "lcn")
    tags = F.when(net.isNotNull(), F.create_map(F.lit("route"), F.lit("bicycle"), F.lit("network"), net)).otherwise(F.create_map(F.lit("route"), F.lit("bicycle")))
    mem = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.lit("way").alias("type"), ((k * 5 + i * 7) % 4000).alias("ref"),
                                                                         F.when((k + i) % 3 == 1, "forward").when((k + i) % 3 == 2, "backward").otherwise("").alias("role")))
    r = table(spark, sf, "orders").filter(k % 3 == 0).select(k.alias("id"), tags.alias("tags"), mem.alias("members"))
    return osm.bike_routes(r, kept(spark, sf))


def restriction_relations(spark, sf):
    """One relation for each way's last node and the next way's id."""
    w = osm_ways(spark, sf)
    k = F.col("way")
    tags = F.create_map(F.lit("type"), F.lit("restriction"), F.lit("restriction"), F.when(k % 2 == 0, "no_left_turn").otherwise("only_straight_on"),
                        F.lit("except"), F.when(k % 10 == 3, "bicycle; motorcar").otherwise("psv"))

    def m(typ, ref, role):
        return F.struct(F.lit(typ).alias("type"), ref.alias("ref"), F.lit(role).alias("role"))
    via = F.when(k % 12 == 5, m("way", k, "via")).otherwise(m("node", F.element_at("refs", -1), "via"))
    return w.filter(k % 6 == 5).select(k.alias("id"), tags.alias("tags"), F.array(m("way", k, "from"), via, m("way", k + 60 * (F.size("refs") - 1), "to"), m("way", k + 1, "other")).alias("members"))


RES = WAYS + """, rel AS (SELECT way AS id, way AS fw, max(CASE WHEN pos = n - 1 THEN node END) AS via, way + 60*(max(n) - 1) AS tw FROM refs WHERE way % 6 = 5 GROUP BY way),
 live AS (SELECT * FROM rel WHERE id % 10 <> 3 AND id % 12 <> 5), prs AS (SELECT id, via, f.arc AS from_arc, t.arc AS to_arc, CASE WHEN id % 2 = 0 THEN 'no' ELSE 'only' END AS kind FROM live JOIN arcs f ON f.way = fw AND f.dst = via JOIN arcs t ON t.way = tw AND t.src = via) """


@query("J9_turn_restrictions", RES + "SELECT DISTINCT via, from_arc, to_arc, kind FROM prs")
def _(spark, sf):
    return osm.turn_restrictions(restriction_relations(spark, sf), grid_arcs(spark, sf))[0]


@query("J9_restriction_counts", RES + "SELECT (SELECT count(*) FROM rel WHERE id % 10 = 3) AS exempt, (SELECT count(*) FROM rel WHERE id % 10 <> 3 AND id % 12 = 5) AS via_way, (SELECT count(*) FROM live WHERE id NOT IN (SELECT id FROM prs)) AS unresolved")
def _(spark, sf):
    return osm.turn_restrictions(restriction_relations(spark, sf), grid_arcs(spark, sf))[1]


@query("G11_arcs_in_box", WAYS + ", ext AS (SELECT way*1048576 + min(pos) AS edge, least(min(lat), min(tlat)) AS s, greatest(max(lat), max(tlat)) AS n, least(min(lon), min(tlon)) AS w, greatest(max(lon), max(tlon)) AS e FROM cut GROUP BY way, run, piece) SELECT arc FROM arcs JOIN ext USING (edge) WHERE s <= 32.05e0 AND n >= 32.02e0 AND w <= -79.95e0 AND e >= -79.98e0")
def _(spark, sf):
    return osm.in_box(grid_arcs(spark, sf), (32.02, -79.98, 32.05, -79.95)).select("arc")


@query("U3_S8_merge_extracts", """WITH a AS (SELECT o_orderkey % 5000 AS id, 0 AS src, o_orderkey AS v FROM orders WHERE o_orderkey < 4000 UNION ALL SELECT o_orderkey AS id, 1, -o_orderkey FROM orders WHERE o_orderkey >= 2000)
 SELECT id, arg_min(v, src) AS v FROM a GROUP BY id""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return osm.merge_inputs([o.filter("o_orderkey < 4000").select((k % 5000).alias("id"), k.alias("v")), o.filter("o_orderkey >= 2000").select(k.alias("id"), (-k).alias("v"))])


# --- cost and routes over a dense random graph --------------------------------------------------------

def arcs(spark, sf):
    """Line items as arcs between suppliers."""
    n = table(spark, sf, "supplier").agg(F.count("*").alias("n_supp"))
    a = derived(spark, sf, "arcs").crossJoin(F.broadcast(n))
    names = F.array(*[F.lit(x) for x in ("primary", "residential", "cycleway", "ferry", "track", "service")])
    klass = F.get(names, F.col("klass"))
    c = F.col
    return (a.withColumn("dst", c("v_raw") % c("n_supp")).filter(c("dst") != c("u")).groupBy("edge").agg(*[F.min_by(x, F.struct("length_m", "v_raw", "u")).alias(x) for x in
            ("u", "dst", "length_m", "klass", "private_way", "toll", "speed_kph", "climb_dm", "descent_dm", "status")])
            .select(c("edge").alias("arc"), "edge", c("u").alias("src"), "dst", "length_m", klass.alias("klass"), "speed_kph", (c("speed_kph") > 40).alias("speed_posted"),
                    F.when(c("private_way"), "private").otherwise("allowed").alias("bicycle_access"), F.when(c("status") == "F", "no").otherwise("allowed").alias("motor_access"),
                    F.lit("allowed").alias("foot_access"), "toll", "climb_dm", "descent_dm", F.when(c("speed_kph") > 60, "paved").otherwise("rough").alias("surface"),
                    (c("edge") % 5 == 0).alias("signal"), (c("edge") % 4).cast("int").alias("crossing"), (c("edge") % 3).cast("int").alias("crossing_from")))


ARCS = with_ctes("arcs").replace("arcs AS (", "arcs0 AS (") + """, ns AS (SELECT count(*) AS n FROM supplier), arcs AS (SELECT edge AS arc, u AS src, v_raw % n AS dst, length_m, ['primary', 'residential', 'cycleway', 'ferry', 'track', 'service'][klass + 1] AS klass, speed_kph,
 private_way, toll, climb_dm, descent_dm, status FROM arcs0, ns WHERE v_raw % n <> u QUALIFY row_number() OVER (PARTITION BY edge ORDER BY length_m, v_raw, u) = 1) """
BIKE = {**co.PROFILE, "class_weight": {"primary": 2.5, "residential": 0.8, "cycleway": 0.6, "ferry": 1.0, "track": 1.5}, "unlisted": 0.0, "private_penalty": 3.0, "toll_penalty": 2.0,
        "class_kph": {"track": 9.0}, "surface_factor": {"rough": 1.4}, "speed_factor": [(45, 1.0), (70, 1.3), (255, 1.7)], "signal_seconds": 20.0, "crossing_seconds": {1: 5.0, 2: 10.0, 3: 20.0},
        "hills": {"climb_s_per_m": 6.0, "descent_s_per_m": 1.0, "steep_grade": 0.001, "steep_descent_s_per_m": 2.0, "max_kph": 30.0}}
FLAT = "length_m/(CASE WHEN klass = 'track' THEN 9 ELSE 14e0 END/3.6e0)"
SECS = f"""CASE WHEN klass = 'ferry' THEN length_m/(speed_kph/3.6e0) WHEN climb_dm = 0 AND descent_dm = 0 THEN {FLAT} ELSE greatest(0, greatest({FLAT} + climb_dm/1e1*6 + CASE WHEN descent_dm/1e1/length_m > 0.001e0 THEN descent_dm/1e1*2 ELSE -descent_dm/1e1 END,
 least({FLAT}, length_m/(30/3.6e0)))) END"""
FACT = """CASE klass WHEN 'primary' THEN 2.5e0 WHEN 'residential' THEN 0.8e0 WHEN 'cycleway' THEN 0.6e0 WHEN 'ferry' THEN 1e0 WHEN 'track' THEN 1.5e0 ELSE 0e0 END*CASE WHEN private_way THEN 3e0 ELSE 1e0 END*CASE WHEN toll THEN 2e0 ELSE 1e0 END
 *CASE WHEN speed_kph > 60 THEN 1e0 ELSE 1.4e0 END*CASE WHEN speed_kph > 40 THEN CASE WHEN speed_kph <= 45 THEN 1e0 WHEN speed_kph <= 70 THEN 1.3e0 ELSE 1.7e0 END ELSE 1e0 END"""


_HALF = "CASE {} WHEN 1 THEN 2.5e0 WHEN 2 THEN 5e0 WHEN 3 THEN 10e0 ELSE 0e0 END"
WAIT = f"CASE WHEN arc % 5 = 0 THEN 20e0 ELSE {_HALF.format('arc % 4')} END + {_HALF.format('arc % 3')}"


@query("P18_usable_arcs", ARCS + "SELECT arc FROM arcs WHERE klass <> 'service'")
def _(spark, sf):
    return arcs(spark, sf).filter(co.usable(BIKE)).select("arc")


@query("F28_F29_arc_cost", ARCS + f"""SELECT arc, round({SECS}, 3) AS seconds, round(({SECS})*({FACT}), 3) AS cost, round(CASE WHEN arc % 5 = 0 THEN 20 ELSE CASE arc % 4 WHEN 1 THEN 2.5e0 WHEN 2 THEN 5 WHEN 3 THEN 10 ELSE 0 END END + CASE arc % 3 WHEN 1 THEN 2.5e0 WHEN 2 THEN 5 ELSE 0 END, 3) AS delay FROM arcs""")
def _(spark, sf):
    return arcs(spark, sf).select("arc", F.round(co.seconds(BIKE), 3).alias("seconds"), F.round(co.arc_cost(BIKE), 3).alias("cost"), F.round(co.node_delay(BIKE), 3).alias("delay"))


@query("F30_cost_breakdown", ARCS + f"""SELECT arc, round({FACT}, 6) AS factor, CASE WHEN ({FACT}) <= 0.9e0*(1 + 1e-9) THEN 0 WHEN ({FACT}) <= 1.5e0*(1 + 1e-9) THEN 1 ELSE 2 END AS tier,
 CASE WHEN private_way THEN 1 ELSE 0 END + CASE WHEN toll THEN 1 ELSE 0 END + CASE WHEN klass <> 'ferry' THEN 1 ELSE 0 END + CASE WHEN speed_kph > 60 THEN 0 ELSE 1 END + CASE WHEN speed_kph > 45 THEN 1 ELSE 0 END AS n_terms FROM arcs""")
def _(spark, sf):
    return arcs(spark, sf).select("arc", *co.breakdown(BIKE, [0.9, 1.5, 3.0])).select("arc", F.round("factor", 6).alias("factor"), "tier", F.size("terms").alias("n_terms"))


@query("F31_profiles", """SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'bicycle' WHEN n_nationkey % 3 = 1 THEN CASE WHEN (n_nationkey - 1) % 3 = 0 THEN 'bicycle' END ELSE 'foot' END AS mode, CASE WHEN n_nationkey % 3 = 1 THEN 10e0 + n_nationkey - 1 ELSE 10e0 + n_nationkey END AS fixed_kph,
 CASE WHEN n_nationkey % 3 = 1 THEN 9e0 ELSE 1e0 + n_nationkey END AS track_weight, CASE WHEN n_nationkey % 3 = 1 THEN 1e0 + (n_nationkey - 1) ELSE NULL END AS inherited FROM nation""".replace("CASE WHEN n_nationkey % 3 = 1 THEN 1e0 + (n_nationkey - 1) ELSE NULL END", "CASE WHEN n_nationkey % 3 = 1 THEN 2e0 ELSE 2e0 END"))
def _(spark, sf):
    k = F.col("n_nationkey")
    child = k % 3 == 1
    raw = table(spark, sf, "nation").select(
        F.col("n_name").alias("name"), F.when(child, F.concat(F.lit("NATION_"), (k - 1).cast("string"))).alias("extends"),
        F.when(k % 3 == 0, "bicycle").when(k % 3 == 2, "foot").alias("mode"), F.when(~child, 10.0 + k).alias("fixed_kph"),
        F.when(child, F.create_map(F.lit("track"), F.lit(9.0))).otherwise(F.create_map(F.lit("track"), 1.0 + k, F.lit("path"), F.lit(2.0))).alias("class_weight"))
    return co.profile_table(raw).select("name", "mode", "fixed_kph", F.element_at("class_weight", "track").alias("track_weight"), F.element_at("class_weight", "path").alias("inherited"))


def usable_arcs(spark, sf):
    return arcs(spark, sf).filter(co.usable(BIKE))


COSTD = ARCS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", cst AS (SELECT src, dst, min(round(({SECS})*({FACT}) + ({WAIT}), 6)) AS w FROM arcs WHERE klass <> 'service' GROUP BY src, dst),
 d(origin, node, cost, round) AS (SELECT s_suppkey, s_suppkey, 0e0, 0 FROM supplier WHERE s_suppkey < 6
 UNION ALL SELECT origin, dst, min(c), r FROM (SELECT d.origin, cst.dst, round(d.cost + w, 6) AS c, d.round + 1 AS r FROM d JOIN cst ON cst.src = d.node WHERE d.round < 12) x GROUP BY origin, dst, r) """


@query("G3_cost_distance", COSTD + "SELECT origin, node, round(min(cost), 3) AS cost FROM d GROUP BY origin, node")
def _(spark, sf):
    seeds = table(spark, sf, "supplier").filter("s_suppkey < 6").select(F.col("s_suppkey").alias("origin"), F.col("s_suppkey").alias("node"))
    st = rt.cost_distance(seeds, usable_arcs(spark, sf), co.travel_cost(BIKE))
    return rt.node_costs(st).select("origin", "node", F.round("cost", 3).alias("cost"))


def trips(spark, sf):
    k = F.col("c_custkey")
    n = table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    return table(spark, sf, "customer").crossJoin(F.broadcast(n)).select(k.alias("trip"), (k % 5).alias("origin"), F.when(k % 50 == 7, -5).otherwise((k * 13) % F.col("n")).alias("dest"))


@query("G4_routes", COSTD + """, b AS (SELECT origin, node, min(cost) AS cost FROM d GROUP BY 1, 2), t AS (SELECT c_custkey AS trip, c_custkey % 5 AS origin, CASE WHEN c_custkey % 50 = 7 THEN -5 ELSE (c_custkey*13) % n END AS dest FROM customer, ns)
 SELECT trip, cost IS NOT NULL AS found, round(cost, 3) AS cost FROM t LEFT JOIN b ON b.origin = t.origin AND b.node = t.dest""")
def _(spark, sf):
    r = rt.routes(trips(spark, sf), usable_arcs(spark, sf), co.travel_cost(BIKE))
    return r.groupBy("trip").agg(F.max("found").alias("found"), F.round(F.max("cost"), 3).alias("cost"))


@query("A21_route_summary", None)
def _(spark, sf):
    a = usable_arcs(spark, sf)
    return rt.route_summary(rt.routes(trips(spark, sf), a, co.travel_cost(BIKE)), a, co.seconds(BIKE))


@query("G3_turn_restricted", None)
def _(spark, sf):
    a = usable_arcs(spark, sf)
    x = a.select("arc", "src", "dst").filter("arc % 40 = 1")
    res = x.select(F.col("dst").alias("via"), F.col("arc").alias("from_arc")).join(a.filter("arc % 7 = 2").select(F.col("src").alias("via"), F.col("arc").alias("to_arc")), "via").filter("via % 9 = 4")
    res = res.groupBy("via", "from_arc").agg(F.min("to_arc").alias("to_arc")).withColumn("kind", F.when(F.col("from_arc") % 2 == 0, "only").otherwise("no"))
    seeds = table(spark, sf, "supplier").filter("s_suppkey < 4").select(F.col("s_suppkey").alias("origin"), F.col("s_suppkey").alias("node"))
    return rt.node_costs(rt.cost_distance(seeds, a, co.travel_cost(BIKE), res)).select("origin", "node", F.round("cost", 3).alias("cost"))


@query("G5_ordered_stops", None)
def _(spark, sf):
    n = table(spark, sf, "supplier").agg(F.count("*").alias("k"))
    s = table(spark, sf, "supplier").crossJoin(F.broadcast(n)).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2))))
    s = s.select(F.col("s_suppkey").alias("trip"), "n", ((F.col("s_suppkey") * 7 + F.col("n") * 29) % F.col("k")).alias("node"))
    a = usable_arcs(spark, sf)
    # two in three arcs can be driven back as well
    back = a.filter("arc % 3 <> 0").withColumn("src0", F.col("src")).withColumn("src", F.col("dst")).withColumn("dst", F.col("src0")).withColumn("arc", -F.col("arc")).drop("src0")
    a = written(a.unionByName(back), "arcs")
    twins = a.filter("abs(arc) % 3 <> 0").select("arc", (-F.col("arc")).alias("twin"))
    return rt.ordered_stops(s, a, co.travel_cost(BIKE), twins).select("trip", "leg", "found", F.round("cost", 3).alias("cost"))


@query("G6_heading_penalty", WAYS + """, e2 AS (SELECT way, way*1048576 + min(pos) AS edge, arg_min(node, pos) AS src, arg_max(tn, pos) AS dst, arg_min(lat, pos) AS a1, arg_min(lon, pos) AS o1, arg_min(tlat, pos) AS a2, arg_min(tlon, pos) AS o2,
 arg_max(tlat, pos) AS b1, arg_max(tlon, pos) AS p1, arg_max(lat, pos) AS b2, arg_max(lon, pos) AS p2 FROM cut GROUP BY way, run, piece),
 x AS (SELECT edge*2 AS arc, src, a1, o1, a2, o2 FROM e2 JOIN kept USING (way) WHERE dir <> 'backward' UNION ALL SELECT edge*2 + 1, dst, b1, p1, b2, p2 FROM e2 JOIN kept USING (way) WHERE dir <> 'forward'),
 y AS (SELECT src AS origin, arc, degrees(atan2(sin(radians(o2 - o1))*cos(radians(a2)), cos(radians(a1))*sin(radians(a2)) - sin(radians(a1))*cos(radians(a2))*cos(radians(o2 - o1)))) - (src*37 % 360) AS d FROM x)
 SELECT origin, arc, CASE WHEN abs(d - 360*round(d/360)) > 90 THEN 45e0 ELSE 0e0 END AS penalty FROM y""")
def _(spark, sf):
    a = grid_arcs(spark, sf)
    seeds = a.select(F.col("src").alias("node")).distinct().select(F.col("node").alias("origin"), "node", (F.col("node") * 37 % 360).cast("double").alias("heading"))
    return rt.heading_penalty(seeds, a)


#: From a quarter of one street to the middle of one some blocks on, for every customer; searches through windows and tides end at a cost.
ROUTE_LIMIT = 300.0


def street_trips(spark, sf, a):
    first = a.groupBy("way").agg(F.min("arc").alias("arc"))
    t = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("trip")).agg(F.min("o_orderkey").alias("way"))
    t = t.join(first.withColumnRenamed("arc", "from_arc"), "way").join(first.select((F.col("way") - 194).alias("way"), F.col("arc").alias("to_arc")), "way")
    none = F.lit(None)
    return t.select("trip", none.cast("long").alias("from_node"), "from_arc", F.lit(0.25).alias("from_at"), none.cast("long").alias("to_node"), "to_arc", F.lit(0.5).alias("to_at"),
                    (F.col("trip") * 37 % 360 + 0.5).alias("heading"))


def street_turns(a):
    """At every ninth junction, crossing over from a northward or southward street to another road costs 15 s; at every tenth one it may not be made."""
    inn = a.filter("way % 2 = 1").select(F.col("arc").alias("in_arc"), F.col("dst").alias("node"), F.col("edge").alias("_e"))
    out = a.filter("way % 2 = 0").select("arc", F.col("src").alias("node"), F.col("edge").alias("_f"))
    t = inn.join(out, "node").filter("_e <> _f and (node % 9 = 0 or node % 10 = 0)")
    return t.select("in_arc", "arc", F.when(F.col("node") % 10 != 0, 15.0).alias("extra"))


def street_routes(spark, sf):
    a = grid_arcs(spark, sf)
    return a, *ar.arc_routes(street_trips(spark, sf, a), a, F.round(F.round("length_m", 3) * 0.2, 3), street_turns(a))


STREETS = WAYS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", ra AS MATERIALIZED (SELECT a.*, round(a.length_m*0.2e0, 3) AS w, b.arc AS twin, round(b.length_m*0.2e0, 3) AS tw, CASE WHEN a.way % 2 = 0 THEN 90 ELSE 0 END + CASE WHEN a.arc % 2 = 1 THEN 180 ELSE 0 END AS brg
  FROM (SELECT arc, edge, way, src, dst, length_m FROM arcs) a LEFT JOIN (SELECT arc, edge, length_m FROM arcs) b ON b.edge = a.edge AND b.arc <> a.arc),
 fa AS (SELECT way, min(arc) AS arc FROM ra GROUP BY way), tr AS MATERIALIZED (SELECT trip, f.arc AS fa, g.arc AS ta, trip*37 % 360 + 0.5e0 AS h FROM (SELECT o_custkey AS trip, min(o_orderkey) AS way FROM orders GROUP BY 1) t JOIN fa f USING (way) JOIN fa g ON g.way = t.way + 194),
 st AS (SELECT trip, arc, 0.25e0 AS pos_, h FROM tr JOIN ra ON arc = fa UNION ALL SELECT trip, twin, 0.75e0, h FROM tr JOIN ra ON arc = fa WHERE twin IS NOT NULL),
 seed AS MATERIALIZED (SELECT trip, st.arc, pos_, w, CASE WHEN least((h - brg + 720) % 360, 360 - (h - brg + 720) % 360) > 90 THEN 45e0 ELSE 0e0 END AS pen FROM st JOIN ra ON ra.arc = st.arc),
 mv AS MATERIALIZED (SELECT a.arc AS in_arc, b.arc, b.w, CASE WHEN a.way % 2 = 1 AND b.way % 2 = 0 AND a.dst % 9 = 0 THEN 15e0 ELSE 0e0 END AS extra FROM ra a JOIN ra b ON b.src = a.dst AND b.edge <> a.edge
   WHERE NOT (a.way % 2 = 1 AND b.way % 2 = 0 AND a.dst % 10 = 0)),
 goal AS MATERIALIZED (SELECT trip, ta AS arc, 0.5e0 AS pos_, w FROM tr JOIN ra ON arc = ta UNION ALL SELECT trip, twin, 0.5e0, tw FROM tr JOIN ra ON arc = ta WHERE twin IS NOT NULL),
 fin AS MATERIALIZED (SELECT g.trip, mv.in_arc, min(extra + pos_*g.w) AS e FROM goal g JOIN mv ON mv.arc = g.arc GROUP BY 1, 2),
 fwd(arc) AS (SELECT * FROM (SELECT arc FROM seed ORDER BY trip, arc LIMIT 20) UNION SELECT mv.arc FROM fwd JOIN mv ON mv.in_arc = fwd.arc), fw AS MATERIALIZED (SELECT arc FROM fwd),
 lost AS MATERIALIZED (SELECT trip FROM tr WHERE trip NOT IN (SELECT trip FROM fin JOIN fw ON fw.arc = fin.in_arc)),
 lab(trip, arc, cost) USING KEY (trip, arc) AS (SELECT trip, arc, round((1 - pos_)*w + pen, 6) FROM seed UNION ALL SELECT g.trip, -1, min(round((g.pos_ - s.pos_)*s.w + pen, 6)) FROM goal g JOIN seed s ON s.trip = g.trip AND s.arc = g.arc WHERE s.pos_ <= g.pos_ GROUP BY g.trip
   UNION (SELECT x.trip, x.arc, min(c) FROM (SELECT l.trip, mv.arc, round(l.cost + w + extra, 6) AS c FROM lab l JOIN mv ON mv.in_arc = l.arc UNION ALL SELECT l.trip, -1, round(l.cost + e, 6) FROM lab l JOIN fin ON fin.trip = l.trip AND fin.in_arc = l.arc) x
     LEFT JOIN recurring.lab r ON r.trip = x.trip AND r.arc = x.arc LEFT JOIN recurring.lab b ON b.trip = x.trip AND b.arc = -1 LEFT JOIN fw ON fw.arc = x.arc LEFT JOIN lost ON lost.trip = x.trip WHERE (fw.arc IS NULL OR lost.trip IS NULL) AND (r.cost IS NULL OR c < r.cost) AND (b.cost IS NULL OR c <= b.cost) GROUP BY x.trip, x.arc)) """


# what a trip costs in all is the label of arc -1; no label dearer than it is driven on, and none on arcs that lead nowhere but to others of ``fw``, where no end of the trip is
@query("G4_G6_arc_ends", STREETS + """SELECT tr.trip, cost IS NOT NULL AS found, round(cost, 3) AS cost FROM tr LEFT JOIN lab ON lab.trip = tr.trip AND lab.arc = -1""")
def _(spark, sf):
    _, found, _ = street_routes(spark, sf)
    return found.select("trip", "found", rounded(F.col("cost"), 3).alias("cost"))


@query("G4_arc_steps", None)
def _(spark, sf):
    _, _, steps = street_routes(spark, sf)
    return steps


WINDOWS = STREETS[:STREETS.index(" mv AS MATERIALIZED")] + f""" gt AS (SELECT arc FROM ra WHERE way % 5 = 0), wn AS MATERIALIZED (SELECT arc, (arc % 7)*60 + k*300e0 AS b, (arc % 7)*60 + k*300 + 150e0 AS e FROM gt, range(0, 3) t(k)),
 mv AS MATERIALIZED (SELECT a.arc AS in_arc, b.arc, b.w, b.way % 5 = 0 AS gated FROM ra a JOIN ra b ON b.src = a.dst AND b.edge <> a.edge),
 sd AS MATERIALIZED (SELECT seed.trip, seed.arc, pos_, seed.w, pen, ra.way % 5 = 0 AS gated, seed.trip % 600 AS dep FROM seed JOIN ra ON ra.arc = seed.arc),
 s0 AS (SELECT trip, sd.arc, dep, min(CASE WHEN gated THEN greatest(b, dep + pen) - dep ELSE pen END + (1 - pos_)*w) AS c FROM sd LEFT JOIN wn ON gated AND wn.arc = sd.arc AND e - (1 - pos_)*w >= greatest(b, dep + pen) WHERE NOT gated OR b IS NOT NULL GROUP BY ALL),
 lab(trip, arc, dep, cost) USING KEY (trip, arc) AS (SELECT trip, arc, dep, round(c, 6) FROM s0
   UNION (SELECT trip, arc, dep, min(c) FROM (SELECT l.trip, mv.arc, l.dep, round(CASE WHEN gated THEN greatest(b, l.cost + l.dep) - l.dep ELSE l.cost END + w, 6) AS c, r.cost AS was FROM lab l JOIN mv ON mv.in_arc = l.arc
     LEFT JOIN wn ON gated AND wn.arc = mv.arc AND e - w >= greatest(b, l.cost + l.dep) LEFT JOIN recurring.lab r ON r.trip = l.trip AND r.arc = mv.arc WHERE NOT gated OR b IS NOT NULL) x WHERE c <= {ROUTE_LIMIT}e0 AND (was IS NULL OR c < was) GROUP BY trip, arc, dep)),
 goal AS (SELECT trip, ta AS arc, 0.5e0 AS pos_, w, way % 5 = 0 AS gated FROM tr JOIN ra ON arc = ta UNION ALL SELECT trip, twin, 0.5e0, tw, way % 5 = 0 FROM tr JOIN ra ON arc = ta WHERE twin IS NOT NULL),
 en AS (SELECT g.trip, g.arc, g.gated, l.dep, l.cost AS c, g.pos_*g.w AS p FROM goal g JOIN mv ON mv.arc = g.arc JOIN lab l ON l.trip = g.trip AND l.arc = mv.in_arc
   UNION ALL SELECT g.trip, g.arc, g.gated, s.dep, s.pen, (g.pos_ - s.pos_)*s.w FROM goal g JOIN sd s ON s.trip = g.trip AND s.arc = g.arc WHERE s.pos_ <= g.pos_),
 ends AS (SELECT trip, round(CASE WHEN gated THEN greatest(b, dep + c) - dep ELSE c END + p, 6) AS c FROM en LEFT JOIN wn ON gated AND wn.arc = en.arc AND e - p >= greatest(b, dep + c) WHERE NOT gated OR b IS NOT NULL) """


@query("G13_tide_windows", WINDOWS + f"""SELECT tr.trip, min(c) IS NOT NULL AS found, round(min(c), 3) AS cost FROM tr LEFT JOIN ends ON ends.trip = tr.trip AND c <= {ROUTE_LIMIT}e0 GROUP BY tr.trip""")
def _(spark, sf):
    a = grid_arcs(spark, sf)
    # every fifth street is beach, open for 150 s three times
    begin = (F.col("arc") % 7) * 60 + F.col("k") * 300.0
    wins = a.filter("way % 5 = 0").select("arc", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("arc", begin.alias("begin"), (begin + 150.0).alias("end"))
    trips = street_trips(spark, sf, a).withColumn("depart", (F.col("trip") % 600).cast("double"))
    found, _ = ar.arc_routes(trips, a, F.round(F.round("length_m", 3) * 0.2, 3), None, False, ROUTE_LIMIT, windows=wins)
    return found.select("trip", "found", F.round("cost", 3).alias("cost"))


@query("G13_tide_gate", None)
def _(spark, sf):
    from .tracks import tides
    a = grid_arcs(spark, sf).withColumn("beach", F.col("way") % 5 == 0)
    trips = street_trips(spark, sf, a).withColumn("station", F.col("trip")).withColumn("depart", 694224000.0 + F.col("trip") * 7919 % 300000 * 1000)
    cost = F.round(F.round("length_m", 3) * 0.2, 3)
    return ar.tide_gate(trips, a, cost, cost, tides(spark, sf), 0.9, 1.6, 600.0, True, None, ROUTE_LIMIT)["plans"].select("trip", "found", F.round("cost", 3).alias("cost"), "dropped")


@query("G12_metres_apart", ARCS + """, nw AS (SELECT arc % 300 AS trip, arc, length_m AS m, arc % 6 <> 1 AS apart FROM arcs WHERE arc % 4 = 1), c AS (SELECT *, sum(m) OVER w AS upto, coalesce(apart <> lag(apart) OVER w, true) AS f, max(arc) OVER (PARTITION BY trip) AS last FROM nw WINDOW w AS (PARTITION BY trip ORDER BY arc)),
 r AS (SELECT *, sum(f::INT) OVER (PARTITION BY trip ORDER BY arc) AS run FROM c), g AS (SELECT trip, run, min(arc) AS n, min(upto - m) AS at_m, sum(m) AS metres, max(arc) = max(last) AS fin FROM r WHERE apart GROUP BY trip, run)
 SELECT trip, CAST(row_number() OVER (PARTITION BY trip ORDER BY run) AS INT) AS parting, n, round(at_m, 2) AS at_m, CASE WHEN NOT fin THEN round(metres, 2) END AS metres FROM g""")
def _(spark, sf):
    a = arcs(spark, sf)
    plan = a.select((F.col("arc") % 300).alias("trip"), F.col("arc").alias("n"), "arc")
    d = ar.partings(plan.filter("arc % 4 = 1"), plan.filter("arc % 6 = 1"), a, size=50000)
    return d.select("trip", "parting", "n", F.round("at_m", 2).alias("at_m"), F.round("metres", 2).alias("metres"))


@query("G12_replan_difference", ARCS + "SELECT arc % 300 AS trip, arc FROM arcs WHERE arc % 4 = 1 EXCEPT SELECT arc % 300 AS trip, arc FROM arcs WHERE arc % 6 = 1")
def _(spark, sf):
    a = arcs(spark, sf).select((F.col("arc") % 300).alias("trip"), "arc")
    return rt.replan_difference(a.filter("arc % 4 = 1"), a.filter("arc % 6 = 1"))


@query("J32_junction_exits", ARCS + """, st AS (SELECT arc % 300 AS trip, arc, dst FROM arcs WHERE arc % 4 = 1) SELECT st.trip, st.arc, count(o.arc) AS exits FROM st LEFT JOIN (SELECT arc, src FROM arcs) o ON o.src = st.dst AND o.arc <> st.arc GROUP BY 1, 2""")
def _(spark, sf):
    a = arcs(spark, sf)
    return rt.junction_exits(a.filter("arc % 4 = 1").select((F.col("arc") % 300).alias("trip"), "arc"), a)


@query("J35_legend_rows", ARCS + """SELECT arc, CASE WHEN klass IN ('primary', 'residential') THEN CASE WHEN toll AND speed_kph <= 60 THEN 4 WHEN speed_kph <= 60 THEN 2 WHEN toll THEN 3 ELSE 1 END WHEN klass = 'ferry' THEN 5 END AS row FROM arcs""")
def _(spark, sf):
    lg = spark.createDataFrame([(1, ["primary", "residential"], None, None), (2, ["primary", "residential"], "rough", None), (3, ["primary", "residential"], None, True),
                                (4, ["primary", "residential"], "rough", True), (5, ["ferry"], None, None)], "row int, klasses array<string>, surface string, toll boolean")
    return rt.legend_rows(arcs(spark, sf), lg)


@query("W10_tier_runs", ARCS + """, s AS (SELECT arc % 200 AS track, arc AS seq, CASE WHEN speed_kph > 60 THEN 'fast' ELSE 'slow' END AS tier, length_m FROM arcs), c AS (SELECT *, CASE WHEN lag(tier) OVER (PARTITION BY track ORDER BY seq) IS DISTINCT FROM tier THEN 1 ELSE 0 END AS f FROM s),
 r AS (SELECT *, sum(f) OVER (PARTITION BY track ORDER BY seq) AS run FROM c) SELECT track, CAST(run AS BIGINT) AS run, tier, round(sum(length_m), 2) AS length_m FROM r GROUP BY ALL""")
def _(spark, sf):
    s = arcs(spark, sf).select((F.col("arc") % 200).alias("track"), F.col("arc").alias("seq"), F.when(F.col("speed_kph") > 60, "fast").otherwise("slow").alias("tier"), "length_m")
    return tr.runs(s, ["track"], ["tier"], {"length_m": F.round(F.sum("length_m"), 2)}, 50000).select("track", "run", "tier", "length_m")


@query("W23_short_stops", ARCS + "SELECT arc, CASE WHEN length_m < 400 THEN false ELSE arc % 5 = 0 END AS signal FROM arcs")
def _(spark, sf):
    return arcs(spark, sf).select("arc", F.when(F.col("length_m") < 400, False).otherwise(F.col("signal")).alias("signal"))
