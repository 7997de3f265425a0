"""Track, tide, wind and sun queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, geodesy
from ..operators import environment as env, tracks as tr
from .derived import derived, table, with_ctes
from .registry import query
from .spatial import sql_plane

FX = with_ctes("fixes")


def vincenty_sql(src: str, keep: str, rounds: int = 8) -> str:
    """Unrolled ellipsoidal inverse over a relation with p_lat, p_lon, lat, lon; adds rng and brg."""
    f = "(1/298.257223563e0)"
    f = "((6378137e0 - 6356752.3142e0)/6378137e0)"
    q = f"""SELECT {keep}, atan((1 - {f})*tan(radians(p_lat))) AS u1, atan((1 - {f})*tan(radians(lat))) AS u2, radians(lon - p_lon) AS dl, radians(lon - p_lon) AS lam FROM {src}"""
    core = "sqrt(pow(cos(u2)*sin(lam), 2) + pow(cos(u1)*sin(u2) - sin(u1)*cos(u2)*cos(lam), 2))"
    for _ in range(rounds):
        a = f"SELECT *, {core} AS sx, sin(u1)*sin(u2) + cos(u1)*cos(u2)*cos(lam) AS cx FROM ({q})"
        b = f"SELECT *, atan2(sx, cx) AS sig, CASE WHEN sx > 0 THEN cos(u1)*cos(u2)*sin(lam)/sx ELSE 0 END AS sa FROM ({a})"
        c = f"SELECT *, CASE WHEN 1 - sa*sa > 0 THEN cx - 2*sin(u1)*sin(u2)/(1 - sa*sa) ELSE 0 END AS mid, {f}/16*(1 - sa*sa)*(4 + {f}*(4 - 3*(1 - sa*sa))) AS cc FROM ({b})"
        last = c
        q = f"SELECT {keep}, u1, u2, dl, dl + (1 - cc)*{f}*sa*(sig + cc*sx*(mid + cc*cx*(-1 + 2*mid*mid))) AS lam FROM ({c})"
    k = f"SELECT *, (1 - sa*sa)*(6378137e0*6378137e0 - 6356752.3142e0*6356752.3142e0)/(6356752.3142e0*6356752.3142e0) AS kk FROM ({last})"
    ab = f"SELECT *, 1 + kk/16384*(4096 + kk*(-768 + kk*(320 - 175*kk))) AS aa, kk/1024*(256 + kk*(-128 + kk*(74 - 47*kk))) AS bb FROM ({k})"
    az = "degrees(atan2(cos(u2)*sin(lam), cos(u1)*sin(u2) - sin(u1)*cos(u2)*cos(lam)))"
    return f"""SELECT {keep}, CASE WHEN sx = 0 THEN 0 ELSE 6356752.3142e0*aa*(sig - bb*sx*(mid + bb/4*(cx*(-1 + 2*mid*mid) - bb/6*mid*(-3 + 4*sx*sx)*(-3 + 4*mid*mid)))) END AS rng,
 CASE WHEN sx = 0 THEN 0 WHEN {az} < 0 THEN {az} + 360 ELSE {az} END AS brg FROM ({ab})"""


PREV = FX + """, pv AS (SELECT *, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(t) OVER w AS p_t FROM fixes WINDOW w AS (PARTITION BY track ORDER BY seq)),
 vin AS (""" + vincenty_sql("pv", "track, seq, t, p_t, lat, lon, p_lat, p_lon, speed, kind") + ") "


@query("W1_speed", PREV + """SELECT track, seq, round(CASE WHEN speed IS NOT NULL THEN speed WHEN t - p_t > 0 THEN rng/(t - p_t) END, 6) AS speed_mps FROM vin""")
def _(spark, sf):
    return tr.derive_motion(derived(spark, sf, "fixes")).select("track", "seq", F.round("speed_mps", 6).alias("speed_mps"))


@query("W2_heading", PREV + """SELECT track, seq, round(coalesce(lead(brg) OVER (PARTITION BY track ORDER BY seq), brg), 4) AS heading_deg FROM vin""")
def _(spark, sf):
    return tr.derive_motion(derived(spark, sf, "fixes")).select("track", "seq", F.round("heading_deg", 4).alias("heading_deg"))


@query("F2_vincenty", FX + ", pv AS (SELECT *, 32.6e0 + (seq % 70) - 35 AS p_lat, -79e0 + (seq % 50) AS p_lon FROM fixes), vin AS (" + vincenty_sql("pv", "seq") + ") SELECT seq, round(rng, 3) AS range_m, round(brg, 5) AS bearing_deg FROM vin")
def _(spark, sf):
    f = derived(spark, sf, "fixes")
    r = geodesy.range_bearing(32.6 + (F.col("seq") % 70) - 35, F.lit(-79.0) + (F.col("seq") % 50), F.col("lat"), F.col("lon"))
    return f.withColumn("r", r).select("seq", F.round("r.range_m", 3).alias("range_m"), F.round("r.bearing_deg", 5).alias("bearing_deg"))


UT = with_ctes("untimed")


@query("W3_drop_non_monotonic", UT + """, r AS (SELECT *, count(*) FILTER (WHERE t IS NULL) OVER (PARTITION BY track ORDER BY seq) AS run FROM untimed),
 m AS (SELECT *, max(t) OVER (PARTITION BY track, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r)
 SELECT track, seq, CAST(t AS DOUBLE) AS t FROM m WHERE t IS NULL OR top IS NULL OR t > top""")
def _(spark, sf):
    return tr.drop_non_monotonic(derived(spark, sf, "untimed"), 500).select("track", "seq", F.col("t").cast("double").alias("t"))


@query("W4_split_gaps", FX + """, g AS (SELECT *, CASE WHEN lag(t) OVER (PARTITION BY track ORDER BY seq) IS NULL OR t - lag(t) OVER (PARTITION BY track ORDER BY seq) > 21600 THEN 1 ELSE 0 END AS s FROM fixes)
 SELECT track, seq, CAST(sum(s) OVER (PARTITION BY track ORDER BY seq) AS BIGINT) AS segment FROM g""")
def _(spark, sf):
    return tr.split_at_gaps(derived(spark, sf, "fixes"), 21600.0, 500).select("track", "seq", "segment")


@query("W5_replayable", UT + """, u AS (SELECT track, seq, CASE WHEN track % 7 = 0 THEN NULL ELSE t END AS t FROM untimed), a AS (SELECT *, bool_or(t IS NOT NULL) OVER (PARTITION BY track) AS timed,
 max(t) OVER (PARTITION BY track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, row_number() OVER (PARTITION BY track ORDER BY seq) - 1 AS n FROM u)
 SELECT track, seq, CASE WHEN timed THEN CAST(t AS DOUBLE) ELSE CAST(n AS DOUBLE) END AS t FROM a WHERE NOT timed OR (t IS NOT NULL AND (top IS NULL OR t > top))""")
def _(spark, sf):
    u = derived(spark, sf, "untimed").withColumn("t", F.when(F.col("track") % 7 == 0, None).otherwise(F.col("t").cast("double"))).withColumn("lat", F.lit(1.0)).withColumn("lon", F.lit(1.0))
    return tr.replayable(u, 500).select("track", "seq", "t")


@query("A14_path_lengths", PREV + """SELECT track, seq, round(coalesce(rng, 0), 2) AS range_m, round(sum(coalesce(rng, 0)) OVER (PARTITION BY track ORDER BY seq), 1) AS cumulative_m FROM vin""")
def _(spark, sf):
    return tr.path_lengths(derived(spark, sf, "fixes"), 1000).select("track", "seq", F.round("range_m", 2).alias("range_m"), F.round("cumulative_m", 1).alias("cumulative_m"))


@query("A15_path_area", FX + """, o AS (SELECT track, seq, lat, lon, first_value(lat) OVER w AS p_lat, first_value(lon) OVER w AS p_lon FROM fixes WINDOW w AS (PARTITION BY track ORDER BY seq)), vin AS (""" + vincenty_sql("o", "track, seq")
       + """), xy AS (SELECT track, seq, rng*sin(radians(brg)) AS x, rng*cos(radians(brg)) AS y FROM vin), c AS (SELECT track, lag(x) OVER w AS px, lag(y) OVER w AS py, x, y FROM xy WINDOW w AS (PARTITION BY track ORDER BY seq))
 SELECT track, round(abs(coalesce(sum(px*y - x*py), 0)/2)) AS area_m2 FROM c GROUP BY track""")
def _(spark, sf):
    return tr.path_area(derived(spark, sf, "fixes"), 1000).select("track", F.round("area_m2", 0).alias("area_m2"))


@query("A20_longest_track", FX + "SELECT track, count(*) AS points FROM fixes GROUP BY track ORDER BY points DESC, min(seq) LIMIT 1")
def _(spark, sf):
    return tr.longest_track(derived(spark, sf, "fixes"))


@query("A23_center_of_mass", FX + """, m AS (SELECT track, avg(cos(radians(lat))*cos(radians(lon))) AS x, avg(cos(radians(lat))*sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z FROM fixes GROUP BY track)
 SELECT track, round(degrees(atan2(z, sqrt(x*x + y*y))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon FROM m""")
def _(spark, sf):
    v = geo.unit_xyz(F.col("lat"), F.col("lon"))
    m = derived(spark, sf, "fixes").groupBy("track").agg(*[F.avg(v[c]).alias(c) for c in "xyz"])
    p = geo.xyz_to_geo(F.col("x"), F.col("y"), F.col("z"))
    return m.select("track", F.round(p.lat, 6).alias("lat"), F.round(p.lon, 6).alias("lon"))


@query("W9_runs", FX + """, c AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS s FROM fixes WINDOW w AS (PARTITION BY track ORDER BY seq)), r AS (SELECT *, sum(s) OVER (PARTITION BY track ORDER BY seq) AS run FROM c)
 SELECT track, CAST(run AS BIGINT) AS run, kind, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM r GROUP BY track, run, kind""")
def _(spark, sf):
    return tr.runs(derived(spark, sf, "fixes"), ["track"], ["kind"], {"n": F.count("*")}, 1000)


PROBE = "probe AS (SELECT o_orderkey AS pid, o_orderkey % 150 AS track, 1704000000e0 + (o_orderkey*7919 % 2764800) AS t FROM orders)"


def probes(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("pid"), (k % 150).alias("track"), (1704000000.0 + (k * 7919) % 2764800).alias("t"))


@query("J17_track_state", FX + f""", {PROBE}, ab AS (SELECT p.*, a.t AS ta, a.lat AS alat, a.lon AS alon, a.speed AS aspd, b.t AS tb, b.lat AS blat, b.lon AS blon, b.speed AS bspd
 FROM probe p ASOF LEFT JOIN fixes a ON p.track = a.track AND p.t >= a.t ASOF LEFT JOIN fixes b ON p.track = b.track AND p.t < b.t)
 SELECT pid, CASE WHEN ta IS NULL THEN 'before' WHEN tb IS NULL AND t > ta THEN 'after' ELSE 'during' END AS phase,
 round(CASE WHEN ta IS NULL THEN blat WHEN tb IS NULL THEN alat ELSE alat + (t - ta)/(tb - ta)*(blat - alat) END, 6) AS lat, round(CASE WHEN ta IS NULL THEN blon WHEN tb IS NULL THEN alon ELSE alon + (t - ta)/(tb - ta)*(blon - alon) END, 6) AS lon,
 round(CASE WHEN ta IS NULL THEN bspd WHEN tb IS NULL OR aspd IS NULL OR bspd IS NULL THEN aspd ELSE aspd + (t - ta)/(tb - ta)*(bspd - aspd) END, 5) AS speed FROM ab""")
def _(spark, sf):
    return tr.state_at(probes(spark, sf), derived(spark, sf, "fixes")).select("pid", "phase", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("speed", 5).alias("speed"))


@query("T19_past_future_split", FX + f""", {PROBE} SELECT pid, count(f.t) FILTER (WHERE f.t <= p.t) AS past, count(f.t) FILTER (WHERE f.t > p.t) AS future FROM probe p LEFT JOIN fixes f ON f.track = p.track GROUP BY pid""")
def _(spark, sf):
    from ..operators.ordered import Ordered, time_chunk
    f = derived(spark, sf, "fixes").select("track", "t", F.lit(0).alias("_side"))
    p = probes(spark, sf).select("track", "t", F.lit(1).alias("_side"), "pid")
    o = Ordered(p.unionByName(f, allowMissingColumns=True), ["track"], ["t", "_side"], time_chunk(F.col("t"), 86400.0))
    isfix = F.when(F.col("_side") == 0, 1).otherwise(0).cast("long")
    o = o.running(sums={"past": isfix}).running(sums={"future": isfix}, reverse=True)
    return o.result().filter("_side = 1").select("pid", "past", "future")


@query("W6_W7_trip", None)
def _(spark, sf):
    return tr.trip(derived(spark, sf, "fixes"), size=5000).select("track", "seq", F.round("odometer_m", 3).alias("odometer_m"), F.round("speed_mps", 5).alias("speed_mps"), F.round("average_mps", 5).alias("average_mps"))


@query("W8_thin_trail", None)
def _(spark, sf):
    return tr.thin_trail(derived(spark, sf, "fixes"), max_age_s=864000.0, size=5000)


@query("W18_derived_heading", FX + """, c AS (SELECT track, seq, lat, lon, lag(lat) OVER w AS pa, lag(lon) OVER w AS po FROM fixes WINDOW w AS (PARTITION BY track ORDER BY seq)),
 h AS (SELECT track, seq, CASE WHEN seq % 7 = 3 THEN (seq % 360)*1e0 WHEN pa IS NOT NULL AND (pa <> lat OR po <> lon) THEN degrees(atan2(sin(radians(lon - po))*cos(radians(lat)), cos(radians(pa))*sin(radians(lat)) - sin(radians(pa))*cos(radians(lat))*cos(radians(lon - po)))) END AS b FROM c)
 SELECT track, seq, round(coalesce(last_value(CASE WHEN b < 0 THEN b + 360 ELSE b END IGNORE NULLS) OVER (PARTITION BY track ORDER BY seq), 0), 4) AS heading_deg FROM h""")
def _(spark, sf):
    return tr.derived_heading(derived(spark, sf, "fixes").withColumn("told", F.when(F.col("seq") % 7 == 3, (F.col("seq") % 360).cast("double"))), size=1000, reported="told").select("track", "seq", F.round("heading_deg", 4).alias("heading_deg"))


@query("W19_densify", PREV + """SELECT track, seq, CAST(k AS INT) AS part FROM vin, range(1, 2000) r(k) WHERE k <= greatest(1, ceil(coalesce(rng, 0)/250))""")
def _(spark, sf):
    return tr.densify(derived(spark, sf, "fixes"), 250.0, 1000).select("track", "seq", "part")


@query("W21_remaining", FX + f""", rt AS (SELECT CAST(i AS INT) AS n, 32.5e0 + i*0.004e0 AS lat, -80.1e0 + (i % 7)*0.002e0 AS lon FROM range(0, 120) x(i)), sg AS (SELECT a.n AS leg, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon,
 2*6371008.8e0*asin(sqrt(pow(sin(radians(b.lat - a.lat)/2), 2) + cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon - a.lon)/2), 2))) AS len FROM rt a JOIN rt b ON b.n = a.n + 1),
 rs AS (SELECT *, sum(len) OVER (ORDER BY leg DESC) AS rest FROM sg), v AS (SELECT track, seq, leg, rest, (alon - lon)*{geo.M_PER_DEG!r}e0*cos(radians(lat)) AS ax, (alat - lat)*{geo.M_PER_DEG!r}e0 AS ay, (blon - lon)*{geo.M_PER_DEG!r}e0*cos(radians(lat)) AS bx, (blat - lat)*{geo.M_PER_DEG!r}e0 AS by_ FROM fixes, rs),
 t AS (SELECT *, least(1e0, greatest(0e0, -(ax*(bx - ax) + ay*(by_ - ay))/(pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM v),
 d AS (SELECT track, seq, leg, rest - t*sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS rem, sqrt(pow(ax + t*(bx - ax), 2) + pow(ay + t*(by_ - ay), 2)) AS d FROM t)
 SELECT track, seq, leg, round(rem, 2) AS remaining_m FROM d QUALIFY row_number() OVER (PARTITION BY track, seq ORDER BY round(d, 6), leg) = 1""")
def _(spark, sf):
    i = F.col("id")
    rt = spark.range(120).select(i.cast("int").alias("n"), (32.5 + i * 0.004).alias("lat"), (-80.1 + (i % 7) * 0.002).alias("lon"))
    return tr.remaining_on_route(derived(spark, sf, "fixes").select("track", "seq", "lat", "lon"), rt).select("track", "seq", "leg", F.round("remaining_m", 2).alias("remaining_m"))


# --- tide, wind, sun ----------------------------------------------------------------------------------

EX = with_ctes("extremes") + """, ex AS (SELECT station, t, ok, row_number() OVER (PARTITION BY station ORDER BY t, ok) % 2 = 0 AS high FROM extremes),
 tide AS (SELECT station, t, ok, high, CASE WHEN high THEN 2 ELSE 0 END + (ok % 100)/2e2 AS height FROM ex),
 hc AS (SELECT station, t AS t0, lead(t) OVER w AS t1, height AS ha, lead(height) OVER w AS hb, lead(high) OVER w AS rising FROM tide WINDOW w AS (PARTITION BY station ORDER BY t, ok)) """


def tides(spark, sf):
    from ..operators.ordered import Ordered, time_chunk
    e = derived(spark, sf, "extremes")
    o = Ordered(e, ["station"], ["t", "ok"], time_chunk(F.col("t"), env.YEAR)).running(sums={"n": F.lit(1).cast("long")}).result()
    high = F.col("n") % 2 == 0
    return o.select("station", "t", "ok", high.alias("high"), (F.when(high, 2).otherwise(0) + (F.col("ok") % 100) / 2e2).alias("height"))


@query("W11_half_cycles", EX + "SELECT station, t0, t1, ha, hb FROM hc WHERE t1 IS NOT NULL")
def _(spark, sf):
    return env.half_cycles(tides(spark, sf)).select("station", "t0", "t1", "ha", "hb")


@query("S9_tide_validation", with_ctes("extremes") + """, e AS (SELECT station, t, ok, ok % 3 = 0 AS high, (ok % 50)/1e1 AS height FROM extremes), p AS (SELECT *, lag(t) OVER w AS pt, lag(high) OVER w AS ph, lag(height) OVER w AS phh FROM e WINDOW w AS (PARTITION BY station ORDER BY t, ok))
 SELECT station, ok, CASE WHEN t <= pt THEN 'time not rising' WHEN high = ph THEN 'same kind twice' ELSE 'high not above low' END AS error FROM p WHERE pt IS NOT NULL AND (t <= pt OR high = ph OR (high AND height <= phh) OR (NOT high AND height >= phh))""")
def _(spark, sf):
    e = derived(spark, sf, "extremes").withColumn("high", F.col("ok") % 3 == 0).withColumn("height", (F.col("ok") % 50) / 1e1)
    return env.check_extremes(e)


TP = "tp AS (SELECT c_custkey*10 + k AS pid, c_custkey AS station, 694224000e0 + (c_custkey*7919 + k*30011) % 300000 * 1000 AS t FROM customer, range(0, 5) r(k))"


def tide_probes(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return c.select((F.col("c_custkey") * 10 + F.col("k")).alias("pid"), F.col("c_custkey").alias("station"), (694224000.0 + (F.col("c_custkey") * 7919 + F.col("k") * 30011) % 300000 * 1000).alias("t"))


@query("J18_tide_height", EX + f""", {TP}, j AS (SELECT pid, t, t0, t1, ha, hb, rising, (t - t0)/(t1 - t0) AS u FROM tp LEFT JOIN hc ON hc.station = tp.station AND t1 IS NOT NULL AND t0 <= t AND t < t1)
 SELECT pid, round(ha*(1 + cos(pi()*u))/2 + hb*(1 - (1 + cos(pi()*u))/2), 6) AS height, rising FROM j""")
def _(spark, sf):
    return env.tide_at(tide_probes(spark, sf), tides(spark, sf)).select("pid", F.round("height", 6).alias("height"), "rising")


WIN = EX + """, kk AS (SELECT station, t0, t1, ha > hb AS falling, CASE WHEN ha > hb THEN (1 - hb)/(ha - hb) ELSE (hb - 1)/(hb - ha) END AS k FROM hc WHERE t1 IS NOT NULL),
 sp AS (SELECT station, round(t0 + CASE WHEN falling AND k < 1 THEN acos(2*k - 1)/pi() ELSE 0 END*(t1 - t0), 6) AS b, round(t0 + CASE WHEN NOT falling AND k > 0 THEN acos(2*k - 1)/pi() ELSE 1 END*(t1 - t0), 6) AS e FROM kk WHERE (falling AND k > 0) OR (NOT falling AND k < 1)),
 mk AS (SELECT *, max(e) OVER (PARTITION BY station ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM sp), isl AS (SELECT *, sum(CASE WHEN upto IS NULL OR b > upto THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY b, e) AS i FROM mk),
 wnd AS (SELECT station, min(b) AS b, max(e) AS e FROM isl GROUP BY station, i HAVING max(e) > min(b)) """


@query("W12_windows_below", WIN + 'SELECT station, round(b, 1) AS "begin", round(e, 1) AS "end" FROM wnd')
def _(spark, sf):
    return env.windows_below(tides(spark, sf), 1.0).select("station", F.round("begin", 1).alias("begin"), F.round("end", 1).alias("end"))


@query("O8_next_window", WIN + f""", {TP}, c AS (SELECT pid, min(greatest(b, t)) AS s FROM tp JOIN wnd USING (station) WHERE e - greatest(b, t) >= 1e6 AND greatest(b, t) <= t + 3e7 GROUP BY pid)
 SELECT tp.pid, round(s, 1) AS "begin" FROM tp LEFT JOIN c USING (pid)""")
def _(spark, sf):
    w = env.windows_below(tides(spark, sf), 1.0)
    return env.next_window(tide_probes(spark, sf), w, 1e6, 3e7).select("pid", F.round("begin", 1).alias("begin"))


@query("G13_beach_verdicts", EX + f""", {TP}, st AS (SELECT pid AS id, station, t AS a, t + 900 + pid % 7 * 600 + 600 AS b FROM tp), jh AS (SELECT id, max(CASE WHEN a >= t0 AND (a < t1) THEN ha*(1 + cos(pi()*(a - t0)/(t1 - t0)))/2 + hb*(1 - (1 + cos(pi()*(a - t0)/(t1 - t0)))/2) END) AS ea,
 max(CASE WHEN b >= t0 AND b < t1 THEN ha*(1 + cos(pi()*(b - t0)/(t1 - t0)))/2 + hb*(1 - (1 + cos(pi()*(b - t0)/(t1 - t0)))/2) END) AS eb FROM st LEFT JOIN hc ON hc.station = st.station AND t1 IS NOT NULL GROUP BY id),
 tp2 AS (SELECT st.id, max(height) AS top FROM st JOIN tide ON tide.station = st.station AND high AND tide.t BETWEEN a AND b GROUP BY st.id)
 SELECT id, CASE WHEN ea IS NULL OR eb IS NULL THEN 'unknown' WHEN greatest(ea, eb, coalesce(top, ea)) > 1.6e0 THEN 'poor' WHEN greatest(ea, eb, coalesce(top, ea)) > 0.9e0 THEN 'marginal' ELSE 'good' END AS verdict FROM jh LEFT JOIN tp2 USING (id)""")
def _(spark, sf):
    st = tide_probes(spark, sf).select(F.col("pid").alias("id"), "station", F.col("t").alias("enter"), (F.col("t") + 900 + F.col("pid") % 7 * 600).alias("exit"))
    return env.beach_verdicts(st, tides(spark, sf), 0.9, 1.6, 600.0).select("id", "verdict")


@query("J19_forecast_value", f"""WITH {TP}, iv AS (SELECT o_custkey AS station, epoch_us(o_orderdate)/1e6 AS b, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), i2 AS (SELECT station, b, least(lead(b) OVER (PARTITION BY station ORDER BY b), b + 1e7) AS e, v FROM iv)
 SELECT pid, v AS value FROM tp LEFT JOIN i2 ON i2.station = tp.station AND b <= t AND t < e""")
def _(spark, sf):
    from ..operators.ordered import Ordered, time_chunk
    iv = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("station"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("begin")).agg(F.max("o_totalprice").alias("value"))
    s = Ordered(iv, ["station"], ["begin"], time_chunk(F.col("begin"), env.YEAR)).following(b=F.col("begin")).result().withColumn("end", F.least(F.col("next_b"), F.col("begin") + 1e7))
    s = s.withColumn("end", F.when(F.col("next_b").isNull(), F.col("begin") + 1e7).otherwise(F.col("end")))
    return env.forecast_at(tide_probes(spark, sf), s.select("station", "begin", "end", "value"), ["station"]).select("pid", "value")


@query("F23_wind_components", FX + """SELECT seq, round(speed*cos(radians((seq*7 % 360) + 180 - (track*3 % 360))), 6) AS tailwind, round(speed*cos(radians((seq*7 % 360) - (track*5 % 360))), 6) AS onshore,
 CASE WHEN abs(((seq % 360) + 90e0) % 360 - (track % 360) + 540 - 360*floor((((seq % 360) + 90e0) % 360 - (track % 360) + 540)/360) - 180) <= abs(((seq % 360) + 270e0) % 360 - (track % 360) + 540 - 360*floor((((seq % 360) + 270e0) % 360 - (track % 360) + 540)/360) - 180)
 THEN ((seq % 360) + 90e0) % 360 ELSE ((seq % 360) + 270e0) % 360 END AS seaward FROM fixes""")
def _(spark, sf):
    c = F.col
    return derived(spark, sf, "fixes").select("seq", F.round(env.tailwind(c("speed"), c("seq") * 7 % 360, c("track") * 3 % 360), 6).alias("tailwind"),
                                              F.round(env.onshore(c("speed"), c("seq") * 7 % 360, c("track") * 5 % 360), 6).alias("onshore"),
                                              env.seaward((c("seq") % 360).cast("double"), (c("track") % 360).cast("double")).alias("seaward"))


@query("F24_sun_events", None)
def _(spark, sf):
    p = derived(spark, sf, "points").select("id", "lat", "lon", (1704067200.0 + (F.col("id") % 365) * 86400).alias("t0"), (1704067200.0 + (F.col("id") % 365 + 3) * 86400).alias("t1"))
    return env.sun_events(p).select("id", F.round("t", 3).alias("t"), "rise")


@query("F24_sun_position", None)
def _(spark, sf):
    p = derived(spark, sf, "points").select("id", "lat", "lon", (1704067200.0 + (F.col("id") % 365) * 86400 + F.col("id") * 61 % 86400).alias("t"))
    return env.sun_position(p).select("id", F.round("elevation_deg", 5).alias("elevation_deg"), F.round("azimuth_deg", 5).alias("azimuth_deg"))
