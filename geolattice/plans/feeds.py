"""NMEA and AIS queries: sentences are built from events, then read back by the feed jobs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ais, geo, nmea
from ..operators import feeds as fd
from ..streaming import jobs
from .derived import derived, table, with_ctes
from .registry import query

EV = """WITH ev AS (SELECT event_id AS k, user_id AS feed, epoch_us(ts)/1000000 AS t0, CAST(floor(epoch_us(ts)/1000) AS BIGINT)/1e3 AS t, event_type AS kind, value FROM events) """


def events(spark, sf):
    e = table(spark, sf, "events").repartition("event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("k"), F.col("user_id").alias("feed"), (F.floor(us / 1000) / 1e3).alias("t"), F.col("event_type").alias("kind"), "value")


def nmea_lines(spark, sf):
    """RMC, GGA and VTG per event; every 31st GGA has its checksum broken, every 7th has few satellites."""
    k, e = F.col("k"), events(spark, sf)
    lat, lon = 32.5 + (k % 9700) / 60000.0, -80.0 - (k % 8900) / 60000.0
    rmc = nmea.build_rmc(F.col("t"), lat, lon, (k % 50) / 2.0, (k % 3600) / 10.0)
    gga = nmea.build_gga(F.col("t"), lat, lon, F.when(k % 7 == 0, 3).otherwise(8), F.lit(1.2), (k % 500) / 10.0)
    vtg = nmea.build_vtg((k % 3600) / 10.0, (k % 50) / 2.0)
    e = geo.pinned(e, rmc=rmc, gga=gga, vtg=vtg)
    gga = F.when(k % 31 == 0, F.concat(F.substring("gga", 1, 20), F.lit("9"), F.substring("gga", 22, 100))).otherwise(F.col("gga"))
    return e.select("feed", "t", F.posexplode(F.array(F.col("rmc"), gga, F.col("vtg"))).alias("i", "line"), "k").select("feed", "t", (F.col("k") * 3 + F.col("i")).alias("seq"), "line", "k")


@query("F16_F17_nmea_parse", EV + """, x AS (SELECT k, i FROM ev, range(0, 3) r(i) WHERE NOT (i = 1 AND k % 31 = 0))
 SELECT k*3 + i AS seq, CASE i WHEN 0 THEN 'RMC' WHEN 1 THEN 'GGA' ELSE 'VTG' END AS type, CASE WHEN i < 2 THEN round(32.5e0 + (k % 9700)/6e4, 6) END AS lat, CASE WHEN i < 2 THEN round(-80e0 - (k % 8900)/6e4, 6) END AS lon,
 CASE WHEN i = 1 AND k % 7 <> 0 THEN (k % 500)/1e1 END AS alt_m, CASE WHEN i <> 1 THEN (k % 3600)/1e1 END AS heading_deg FROM x""")
def _(spark, sf):
    r = nmea.with_reading(nmea_lines(spark, sf)).filter("r is not null")
    return r.select("seq", "r.type", F.round("r.lat", 6).alias("lat"), F.round("r.lon", 6).alias("lon"), "r.alt_m", "r.heading_deg")


@query("F18_nmea_build", None)
def _(spark, sf):
    return nmea_lines(spark, sf).select("seq", "line")


@query("F19_utc_time", """SELECT event_id AS k, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS back FROM events""")
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").select(F.col("event_id").alias("k"), F.year(ts).alias("y"), F.month(ts).alias("m"), F.day(ts).alias("d"), iso.alias("iso"), F.unix_timestamp(F.to_timestamp(iso)).alias("back"))


@query("T4_assemble_fixes", EV + """, g AS (SELECT *, lag(t) OVER (PARTITION BY feed ORDER BY t, k) AS p FROM ev), h AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND abs((t - 86400*floor(t/86400)) - (p - 86400*floor(p/86400))) >= 0.05e0 THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY t, k) AS grp FROM g),
 l AS (SELECT feed, grp, max(k) AS k, min(t) AS t FROM h GROUP BY feed, grp), n AS (SELECT *, lead(t) OVER (PARTITION BY feed ORDER BY grp) AS nt FROM l)
 SELECT feed, CAST(grp AS BIGINT) AS grp, round(floor(coalesce(nt, t)/86400)*86400 + (t - 86400*floor(t/86400)), 3) AS fix_t, round(32.5e0 + (k % 9700)/6e4, 6) AS lat FROM n""")
def _(spark, sf):
    f = fd.assemble_fixes(nmea_lines(spark, sf))
    return f.select("feed", "grp", F.round("fix_t", 3).alias("fix_t"), F.round("lat", 6).alias("lat"))


@query("S7_nmea_log_file", "SELECT event_id*3 AS seq FROM events UNION ALL SELECT event_id*3 + 2 FROM events")
def _(spark, sf):
    from ..sources import logs
    from ..session import scratch
    path = scratch(spark, "nmea")
    nmea_lines(spark, sf).filter("seq % 3 <> 1").select(F.concat_ws("\t", "feed", "t", "seq", "line").alias("value")).write.text(path)
    r = nmea.with_reading(logs.read_log(spark, path)).filter("r is not null")
    return r.select("seq")


def ais_lines(spark, sf):
    """One type 1 or type 18 report per event and a two-part type 5 for every ninth; some lines are orphans or broken."""
    e, k = events(spark, sf), F.col("k")
    b, tb = ais.bit_text, ais.text_bits
    mmsi = 367000000 + F.col("feed")
    lon, lat = ((k * 7919) % 216000001 - 108000000), ((k * 104729) % 108000001 - 54000000)
    cog, hdg = F.when(k % 17 == 0, 3600).otherwise(k % 3600), F.when(k % 19 == 0, 511).otherwise(k % 360)
    sog = F.when(k % 13 == 0, 1023).otherwise(k % 1000)
    zero = F.lit(0)
    p1 = F.concat(b(F.lit(1), 6), b(zero, 2), b(mmsi, 30), b(k % 16, 4), b(k % 256 - 128, 8), b(sog, 10), b(zero, 1), b(lon, 28), b(lat, 27), b(cog, 12), b(hdg, 9), b(k % 64, 6), b(zero, 2), b(zero, 3), b(zero, 1), b(zero, 19))
    p18 = F.concat(b(F.lit(18), 6), b(zero, 2), b(mmsi, 30), b(zero, 8), b(sog, 10), b(zero, 1), b(lon, 28), b(lat, 27), b(cog, 12), b(hdg, 9), b(k % 64, 6), b(zero, 29))
    p5 = F.concat(b(F.lit(5), 6), b(zero, 2), b(mmsi, 30), b(zero, 2), b(k, 30), tb(F.concat(F.lit("CS"), (k % 1000).cast("string")), 7), tb(F.concat(F.lit("SHIP "), k.cast("string")), 20), b(k % 100, 8),
                  b(k % 300, 9), b(k % 200, 9), b(k % 40, 6), b(k % 30, 6), b(zero, 4), b(zero, 20), b(k % 200, 8), tb(F.lit("PORT A"), 20), b(zero, 4))
    e = geo.pinned(e, bits=F.when(k % 2 == 0, p1).otherwise(p18), bits5=F.when(k % 9 == 0, p5).otherwise(""))
    e = geo.pinned(e, pay=ais.armour(F.col("bits")), pay5=F.when(k % 9 == 0, ais.armour(F.col("bits5"))))
    e = geo.pinned(e, single=ais.vdm(F.col("pay")), first=F.when(k % 9 == 0, ais.vdm(F.substring("pay5", 1, 36), 2, 1, "3", "B")), second=F.when(k % 9 == 0, ais.vdm(F.substring("pay5", 37, 100), 2, 2, "3", "B")))
    first, second = F.col("first"), F.col("second")
    single = F.when(k % 37 == 0, F.concat(F.substring("single", F.lit(1), F.length("single") - 2), F.lit("ZZ"))).otherwise(F.col("single"))
    parts = F.when(k % 9 == 0, F.when(k % 5 == 0, F.array(single, second)).otherwise(F.array(single, first, first, second))).otherwise(F.array(single))
    return e.select("feed", "t", "k", F.posexplode(parts).alias("i", "line")).select("feed", "t", (F.col("k") * 4 + F.col("i")).alias("seq"), "line", "k")


AISX = EV + """, m AS (SELECT *, (k*7919) % 216000001 - 108000000 AS lon, (k*104729) % 108000001 - 54000000 AS lat FROM ev) """


@query("F20_T3_ais_decode", AISX + """SELECT k, CASE WHEN k % 2 = 0 THEN 1 ELSE 18 END AS type, 367000000 + feed AS mmsi, round(lat/6e5, 6) AS lat, round(lon/6e5, 6) AS lon,
 round(CASE WHEN k % 13 <> 0 AND k % 1000 <> 1023 THEN (k % 1000)/1e1*1852/36e2 END, 6) AS sog_mps, CASE WHEN k % 17 <> 0 THEN (k % 3600)/1e1 END AS cog_deg, CAST(CASE WHEN k % 19 <> 0 THEN k % 360 END AS INT) AS heading_deg,
 CAST(CASE WHEN k % 2 = 0 AND k % 16 <> 15 THEN k % 16 END AS INT) AS nav_status FROM m WHERE k % 37 <> 0""")
def _(spark, sf):
    m = fd.messages(fd.assemble(fd.sentences(ais_lines(spark, sf)))).filter("type <> 5")
    return m.select(F.floor(F.col("seq") / 4).alias("k"), "type", "mmsi", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("sog_mps", 6).alias("sog_mps"), "cog_deg", "heading_deg", "nav_status")


@query("T2_assemble_fragments", AISX + """, o AS (SELECT 'bad line' AS outcome, count(*) AS n FROM m WHERE k % 37 = 0 UNION ALL SELECT 'message', (SELECT count(*) FROM m WHERE k % 37 <> 0) + (SELECT count(*) FROM m WHERE k % 9 = 0 AND k % 5 <> 0)
 UNION ALL SELECT 'orphan', count(*) FROM m WHERE k % 45 = 0 UNION ALL SELECT 'dropped', count(*) FROM m WHERE k % 9 = 0 AND k % 5 <> 0) SELECT outcome, CAST(n AS BIGINT) AS n FROM o WHERE n > 0""")
def _(spark, sf):
    return fd.assemble(fd.sentences(ais_lines(spark, sf))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("F20_ais_static", AISX + """SELECT k, 'SHIP ' || CAST(k AS VARCHAR) AS name, 'CS' || CAST(k % 1000 AS VARCHAR) AS call_sign, 'PORT A' AS destination, CASE WHEN k <> 0 THEN k END AS imo, CAST(nullif(k % 100, 0) AS INT) AS ship_type, CASE WHEN k % 200 <> 0 THEN (k % 200)/1e1 END AS draught_m,
 CAST(CASE WHEN k % 300 + k % 200 + k % 40 + k % 30 > 0 THEN k % 300 END AS INT) AS bow FROM m WHERE k % 9 = 0 AND k % 5 <> 0""")
def _(spark, sf):
    m = fd.messages(fd.assemble(fd.sentences(ais_lines(spark, sf)))).filter("type = 5")
    return m.select(F.floor(F.col("seq") / 4).alias("k"), "name", "call_sign", "destination", "imo", "ship_type", "draught_m", F.col("dims.bow").alias("bow"))


@query("T1_classify_lines", AISX + "SELECT 'ais' AS class, (SELECT count(*) FROM m) + (SELECT sum(CASE WHEN k % 9 <> 0 THEN 0 WHEN k % 5 = 0 THEN 1 ELSE 3 END)::BIGINT FROM m) AS n UNION ALL SELECT 'gps', 3*count(*) FROM m")
def _(spark, sf):
    u = ais_lines(spark, sf).select("line").union(nmea_lines(spark, sf).select("line"))
    return u.groupBy(ais.line_class(F.col("line")).alias("class")).agg(F.count("*").alias("n"))


@query("A24_counters", AISX + """, x AS (SELECT feed, 'bad line' AS outcome FROM m WHERE k % 37 = 0 UNION ALL SELECT feed, 'message' FROM m WHERE k % 37 <> 0 UNION ALL SELECT feed, 'message' FROM m WHERE k % 9 = 0 AND k % 5 <> 0 UNION ALL SELECT feed, 'orphan' FROM m WHERE k % 45 = 0 UNION ALL SELECT feed, 'dropped' FROM m WHERE k % 9 = 0 AND k % 5 <> 0)
 SELECT feed, outcome, count(*) AS n FROM x GROUP BY ROLLUP (feed, outcome)""")
def _(spark, sf):
    return fd.counters(fd.assemble(fd.sentences(ais_lines(spark, sf))))


@query("T5_vessel_table", AISX + """, s AS (SELECT 367000000 + feed AS mmsi, t, k, 'SHIP ' || CAST(k AS VARCHAR) AS name FROM m WHERE k % 9 = 0 AND k % 5 <> 0), p AS (SELECT 367000000 + feed AS mmsi, t, k, lat, lon FROM m WHERE k % 37 <> 0), u AS (SELECT mmsi, t FROM s UNION ALL SELECT mmsi, t FROM p),
 a AS (SELECT mmsi, count(*) AS messages, round(min(t), 3) AS first_heard, round(max(t), 3) AS last_heard FROM u GROUP BY mmsi), b AS (SELECT mmsi, arg_max(round(lat/6e5, 6), (t, k)) AS lat, arg_max(round(lon/6e5, 6), (t, k)) AS lon FROM p GROUP BY mmsi), c AS (SELECT mmsi, arg_max(name, (t, k)) AS name FROM s GROUP BY mmsi)
 SELECT a.*, 'vessel' AS kind, lat, lon, name FROM a LEFT JOIN b USING (mmsi) LEFT JOIN c USING (mmsi)""")
def _(spark, sf):
    v = fd.vessel_table(fd.messages(fd.assemble(fd.sentences(ais_lines(spark, sf)))))
    return v.select("mmsi", "messages", F.round("first_heard", 3).alias("first_heard"), F.round("last_heard", 3).alias("last_heard"), "kind", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "name")


@query("O6_evict_oldest", EV + "SELECT 367000000 + feed AS mmsi FROM ev GROUP BY feed ORDER BY feed = 7 DESC, max(t) DESC, feed LIMIT 50")
def _(spark, sf):
    v = events(spark, sf).groupBy((367000000 + F.col("feed")).alias("mmsi")).agg(F.max("t").alias("last_heard")).withColumn("own_ship", F.col("mmsi") == 367000007)
    return fd.evict_oldest(v, 50).select("mmsi")


@query("A25_credits", EV + "SELECT kind AS credit, min(t) AS first_t FROM ev GROUP BY kind")
def _(spark, sf):
    return fd.credits(events(spark, sf).select(F.col("kind").alias("credit"), "t", F.col("k").alias("seq")))


@query("T7_staleness", EV + ", mx AS (SELECT max(t) AS now FROM ev) SELECT feed, now - max(t) > 360 AS stale FROM ev, mx GROUP BY feed, now")
def _(spark, sf):
    e = events(spark, sf)
    now = e.agg(F.max("t").alias("now"))
    return e.groupBy("feed").agg(F.max("t").alias("t")).crossJoin(F.broadcast(now)).select("feed", (F.col("now") - F.col("t") > fd.STALE_S).alias("stale"))


@query("F21_vessel_kinds", "SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN 'sart' WHEN 1 THEN 'mob' WHEN 2 THEN 'epirb' WHEN 3 THEN 'sar aircraft' WHEN 4 THEN 'aid to navigation' WHEN 5 THEN 'base station' ELSE 'vessel' END AS kind FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    base = F.element_at(F.array(*[F.lit(x) for x in (970000000, 972000000, 974000000, 111000000, 990000000, 1000000, 367000000)]), (k % 7 + 1).cast("int"))
    return table(spark, sf, "customer").select(k.alias("k"), ais.kind_from_mmsi(base + k).alias("kind"))


CPA = EV + """, w AS (SELECT k, feed AS mmsi, t, 32.7e0 + (k % 100)*0.001e0 AS lat, -79.9e0 + (k % 77)*0.001e0 AS lon, (k % 20)/2e0 AS sog, (k*7 % 360) AS cog FROM ev),
 v AS (SELECT *, sog*sin(radians(cog)) - 5*sin(radians(90)) AS wx, sog*cos(radians(cog)) - 5*cos(radians(90)) AS wy, radians(lon + 79.85e0)*cos(radians((lat + 32.75e0)/2))*6371008.8e0 AS px, radians(lat - 32.75e0)*6371008.8e0 AS py FROM w),
 c AS (SELECT *, sqrt(px*px + py*py) AS rng, CASE WHEN wx*wx + wy*wy < 1e-12 THEN 0 ELSE -(px*wx + py*wy)/(wx*wx + wy*wy) END AS tcpa FROM v), cp AS (SELECT *, CASE WHEN wx*wx + wy*wy < 1e-12 THEN rng ELSE sqrt(pow(px + wx*tcpa, 2) + pow(py + wy*tcpa, 2)) END AS cpa FROM c) """


def cpa_rows(spark, sf):
    k = F.col("k")
    d = events(spark, sf).select(k.alias("seq"), F.col("feed").alias("mmsi"), "t", (32.7 + (k % 100) * 0.001).alias("lat"), (-79.9 + (k % 77) * 0.001).alias("lon"), ((k % 20) / 2.0).alias("sog_mps"),
                                 (k * 7 % 360).cast("double").alias("cog_deg"), F.lit("vessel").alias("kind"), F.col("t").alias("now"),
                                 F.lit(32.75).alias("own_lat"), F.lit(-79.85).alias("own_lon"), F.lit(5.0).alias("own_speed"), F.lit(90.0).alias("own_heading"))
    return ais.with_cpa(d)


@query("F22_J24_cpa", CPA + "SELECT k AS seq, mmsi, round(rng, 2) AS range_m, round(cpa, 2) AS cpa_m, round(tcpa, 2) AS tcpa_s FROM cp")
def _(spark, sf):
    return cpa_rows(spark, sf).select("seq", "mmsi", *[F.round(c, 2).alias(c) for c in ("range_m", "cpa_m", "tcpa_s")])


@query("T8_cpa_alarms", CPA + """, st AS (SELECT *, CASE WHEN tcpa >= 0 AND cpa <= 926 AND tcpa <= 600 THEN 1 WHEN tcpa < 0 OR cpa > 1.2e0*926 OR tcpa > 1.2e0*600 THEN 0 END AS z FROM cp), f AS (SELECT *, coalesce(last_value(z IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY t, k), 0) AS a FROM st),
 e AS (SELECT *, coalesce(lag(a) OVER (PARTITION BY mmsi ORDER BY t, k), 0) AS b FROM f) SELECT k AS seq, mmsi, CASE WHEN a = 1 THEN 'raised' ELSE 'cleared' END AS event FROM e WHERE a <> b""")
def _(spark, sf):
    return fd.alarms(cpa_rows(spark, sf).withColumn("stale", F.lit(False))).select("seq", "mmsi", "event")


@query("T9_feed_silences", EV + ", p AS (SELECT feed, t, lag(t) OVER (PARTITION BY feed ORDER BY t, k) AS p FROM ev) SELECT feed, p AS from_t, t AS to_t FROM p WHERE t - p > 36000")
def _(spark, sf):
    return fd.feed_silences(events(spark, sf).withColumn("seq", F.col("k")), 36000.0)


@query("T10_attach_heading", EV + """, h AS (SELECT feed, t, k % 360 AS hd FROM ev WHERE k % 3 = 0), x AS (SELECT e.feed, e.k, e.t, h.t AS ht, hd FROM ev e ASOF LEFT JOIN (SELECT feed, t, max(hd) AS hd FROM h GROUP BY feed, t) h ON h.feed = e.feed AND e.t >= h.t WHERE e.k % 3 = 1)
 SELECT k, CASE WHEN t - ht <= 7200 AND (k % 5)/4e0 < 0.5e0 THEN CAST(hd AS DOUBLE) ELSE 1e0 END AS heading_deg FROM x""")
def _(spark, sf):
    e, k = events(spark, sf), F.col("k")
    f = e.filter(k % 3 == 1).select("feed", "t", "k", ((k % 5) / 4.0).alias("speed_mps"), F.lit(1.0).alias("heading_deg"))
    h = e.filter(k % 3 == 0).groupBy("feed", "t").agg(F.max(k % 360).cast("double").alias("heading"))
    return fd.attach_heading(f, h, within_s=7200.0).select("k", "heading_deg")


@query("T16_sessions", with_ctes("fixes") + """, g AS (SELECT track, t, CASE WHEN t - lag(t) OVER (PARTITION BY track ORDER BY t) < 21600 THEN 0 ELSE 1 END AS s FROM fixes), r AS (SELECT *, sum(s) OVER (PARTITION BY track ORDER BY t) AS i FROM g) SELECT track, round(min(t), 3) AS start_t, count(*) AS points FROM r GROUP BY track, i""")
def _(spark, sf):
    f = derived(spark, sf, "fixes").withColumn("ts", F.timestamp_seconds("t"))
    return jobs.sessions(f, "6 hours").select("track", F.round(F.unix_micros("start") / 1e6, 3).alias("start_t"), "points")


@query("T17_interval_counts", EV + "SELECT CAST(floor(t/3600)*3600 AS BIGINT) AS start_s, kind AS outcome, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, sf):
    e = events(spark, sf).select(F.timestamp_seconds("t").alias("ts"), F.col("kind").alias("outcome"))
    return jobs.interval_counts(e, "1 hour").select(F.unix_timestamp("start").alias("start_s"), "outcome", "n")


# --- the same jobs on a stream ----------------------------------------------------------------------

def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    ts = F.col("ts").cast("timestamp")
    t = F.unix_micros(ts) / 1e6
    k = F.col("event_id")
    return s.select(k.alias("seq"), F.col("user_id").alias("track"), ts.alias("ts"), t.alias("t"), F.round(32.5 + (F.col("user_id") % 50) * 0.01 + (k % 97) * 0.0001, 6).alias("lat"),
                    F.round(-80.1 + (k % 89) * 0.0001, 6).alias("lon"), F.when(F.col("event_type") != "error", F.round(F.col("value") / 20, 6)).alias("speed"), F.col("event_type").alias("kind"))


@query("T5_T6_vessel_stream", with_ctes("fixes") + """, g AS (SELECT track, t, CASE WHEN t - lag(t) OVER w >= 1800 THEN 1 ELSE 0 END AS gone, row_number() OVER w AS rn FROM fixes WINDOW w AS (PARTITION BY track ORDER BY t)) SELECT 367000000 + track AS mmsi, CAST(count(*) FILTER (WHERE rn = 1 OR gone = 1) AS BIGINT) AS added, count(*) FILTER (WHERE rn > 1 AND gone = 0) AS updated FROM g GROUP BY track""")
def _(spark, sf):
    m = event_stream(spark, sf).select((367000000 + F.col("track")).alias("mmsi"), "ts", "lat", "lon", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("SHIP "), F.col("seq").cast("string"))).alias("name"))
    out = jobs.run_available(jobs.vessel_changes(m), "vessels")
    return out.groupBy("mmsi").agg(F.count_if(F.col("event") == "added").alias("added"), F.count_if(F.col("event") == "updated").alias("updated"))


@query("T2_fragment_stream", None)
def _(spark, sf):
    k = F.col("seq")
    s = event_stream(spark, sf).withColumn("number", F.explode(F.when(k % 5 == 0, F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))))
    s = s.select(F.col("track").alias("feed"), F.lit("AI").alias("talker"), F.lit(False).alias("own"), (k % 10).cast("string").alias("seq_id"), F.lit("A").alias("channel"), F.lit(2).alias("count"),
                 "number", F.concat(F.lit("P"), k.cast("string"), F.lit("."), F.col("number").cast("string")).alias("payload"), F.lit(0).alias("fill"), "ts")
    return jobs.run_available(jobs.fragments(s), "fragments").groupBy("outcome").agg(F.count("*").alias("n"))


@query("T11_trip_stream", None)
def _(spark, sf):
    out = jobs.run_available(jobs.live_trips(event_stream(spark, sf).drop("kind")), "trips")
    return out.select("track", "seq", F.round("odometer_m", 3).alias("odometer_m"), F.round("speed_mps", 5).alias("speed_mps"), F.round("average_mps", 5).alias("average_mps"))


@query("T15_recorder_stream", with_ctes("fixes") + ", g AS (SELECT track, seq, t, CASE WHEN t - lag(t) OVER (PARTITION BY track ORDER BY seq) <= 21600 THEN 0 ELSE 1 END AS s FROM fixes) SELECT track, seq, CAST(sum(s) OVER (PARTITION BY track ORDER BY seq) AS BIGINT) AS segment FROM g")
def _(spark, sf):
    return jobs.run_available(jobs.recorder(event_stream(spark, sf), 21600.0), "recorder").select("track", "seq", "segment")


@query("T9_liveness_stream", None)
def _(spark, sf):
    s = event_stream(spark, sf).select(F.col("track").alias("feed"), "ts")
    return jobs.run_available(jobs.liveness(s, "6 hours"), "liveness")


@query("T17_counter_stream", EV + "SELECT CAST(floor(t/3600)*3600 AS BIGINT) AS start_s, kind AS outcome, count(*) AS n FROM ev GROUP BY ALL")
def _(spark, sf):
    s = event_stream(spark, sf).select("ts", F.col("kind").alias("outcome"))
    out = jobs.run_available(jobs.interval_counts(s, "1 hour"), "counts", "update")
    # an interval is reported again whenever a batch adds to it; the last report counts
    return out.groupBy("start", "outcome").agg(F.max_by("n", "batch").alias("n")).select(F.unix_timestamp("start").alias("start_s"), "outcome", "n")
