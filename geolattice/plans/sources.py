"""Source and sink queries: files are written from the driver tables, then read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..session import scratch
from ..sources import vector as src
from .derived import derived, table, with_ctes
from .registry import query


def text_files(df, label):
    path = scratch(df.sparkSession, label)
    df.write.text(path)
    return path


def geojson(spark, sf):
    p = derived(spark, sf, "features")
    props = F.struct("name", "size", "price", "lit", F.when(F.col("id") % 2 == 0, F.lit("2024-01-05")).otherwise("2023-11-30").alias("seen"), F.concat(F.lit("https://x.org/"), F.col("id").cast("string")).alias("page"),
                     F.concat(F.lit("+1 555 "), F.col("id").cast("string")).alias("phone"))
    f = F.struct(F.lit("Feature").alias("type"), (F.col("id") + 1).alias("id"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), props.alias("properties"))
    # one collection per forty features, indented, in a file of its own
    g = p.groupBy(F.floor(F.col("id") / 40).alias("g")).agg(F.array_sort(F.collect_list(f)).alias("features"))
    path = scratch(spark, "geojson")
    g.select("g", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"), {"pretty": "true"}).alias("value")).write.partitionBy("g").text(path)
    return f"{path}/*/"


@query("S2_geojson_source", with_ctes("features") + "SELECT id + 1 AS id, round(lat, 6) AS lat, round(lon, 6) AS lon, name FROM features")
def _(spark, sf):
    d = src.assign_ids(src.read_geojson(spark, geojson(spark, sf)))
    return d.select("id", F.round(F.try_variant_get("geometry", "$.coordinates[1]", "double"), 6).alias("lat"), F.round(F.try_variant_get("geometry", "$.coordinates[0]", "double"), 6).alias("lon"),
                    F.try_variant_get("properties", "$.name", "string").alias("name"))


@query("S3_infer_fields", "SELECT * FROM (VALUES ('name', 'text', NULL), ('size', 'integer', NULL), ('price', 'real', NULL), ('lit', 'boolean', NULL), ('seen', 'date', NULL), ('page', 'text', 'url'), ('phone', 'text', 'phone')) t(key, type, role)")
def _(spark, sf):
    return src.infer_fields(src.read_geojson(spark, geojson(spark, sf)))


@query("S4_geojson_sink", None)
def _(spark, sf):
    # a box across +-180 is written as the two boxes on either side
    b = derived(spark, sf, "boxes").select("cov_id", "series_id", F.explode(geo.box_parts(*[F.col(c) for c in ("c_s", "c_w", "c_n", "c_e")])).alias("b"))

    def p(a, o):
        return F.struct(F.col(f"b.{a}").alias("lat"), F.col(f"b.{o}").alias("lon"))
    ring = F.array(p("s", "w"), p("n", "w"), p("n", "e"), p("s", "e"), p("s", "w"))
    return src.geojson_lines(b.select(F.col("cov_id").alias("id"), "series_id", F.array(ring).alias("rings")), ["series_id"])


@query("S5_S6_gpx_round_trip", with_ctes("fixes") + "SELECT CAST(track AS VARCHAR) AS track, round(floor(t*1000)/1000, 3) AS t, lat, lon, CAST(alt AS DOUBLE) AS alt FROM fixes")
def _(spark, sf):
    path = scratch(spark, "gpx")
    src.write_gpx(derived(spark, sf, "fixes").withColumn("segment", F.lit(0)), path)
    return src.read_gpx(spark, path).select("track", F.round("t", 3).alias("t"), "lat", "lon", "alt")


@query("S8_osm_xml", "SELECT p_partkey AS id, p_type AS kind, [p_partkey, p_partkey + 1] AS refs FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    w = table(spark, sf, "part").select(k.alias("_id"), F.array(F.struct(k.alias("_ref")), F.struct((k + 1).alias("_ref"))).alias("nd"), F.array(F.struct(F.lit("kind").alias("_k"), F.col("p_type").alias("_v"))).alias("tag"))
    path = scratch(spark, "osm")
    w.write.format("xml").option("rowTag", "way").option("rootTag", "osm").save(path)
    return src.read_osm(spark, path, "way").select("id", F.element_at("tags", "kind").alias("kind"), "refs")


@query("S10_wind_intervals", "SELECT o_orderkey AS series, CAST(epoch_us(o_orderdate) // 1000000 AS DOUBLE) AS \"begin\", CAST(epoch_us(o_orderdate) // 1000000 + (1 + o_orderkey % 9)*3600 AS DOUBLE) AS \"end\", round(o_totalprice/3.6e0, 6) AS value FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    d = o.select(F.col("o_orderkey").alias("series"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("/PT"), (1 + F.col("o_orderkey") % 9).cast("string"), F.lit("H")).alias("valid"), F.col("o_totalprice").alias("value"))
    return src.read_wind(d).withColumn("value", F.round("value", 6))


@query("S14_point_document", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, CAST(c_acctbal AS DOUBLE) AS elevation_ft FROM customer")
def _(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.col("c_name").alias("Name"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("Elevation_ft"))
    return src.point_document(p).select("id", "name", "category", "elevation_ft")


@query("S16_web_pages", "SELECT CASE WHEN p_partkey = 0 THEN -1 ELSE p_partkey END AS id, p_size*1e0 AS lon, p_name AS name FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    f = F.struct(k.cast("string").alias("id"), F.struct(F.array(F.col("p_size").cast("double"), F.lit(1.0)).alias("coordinates")).alias("geometry"), F.create_map(F.lit("name"), F.col("p_name")).alias("properties"))
    pages = table(spark, sf, "part").select(F.to_json(F.struct(F.array(f).alias("features"))).alias("payload"))
    d = src.page_features(pages)
    # the text "0" is no positive number, so its id is a hash
    return d.select(F.when(F.col("id") > 1000000000, -1).otherwise(F.col("id")).alias("id"), "lon", F.element_at("properties", "name").alias("name"))


@query("S17_product_catalog_xml", with_ctes("catalog") + "SELECT cell AS name, cancelled, edition, CAST(upd AS INT) AS upd FROM catalog")
def _(spark, sf):
    c = derived(spark, sf, "catalog")
    path = scratch(spark, "cells")
    d = c.select(F.col("cell").alias("name"), F.when(F.col("cancelled"), "Cancelled").otherwise("Active").alias("status"), F.col("edition").alias("edtn"), F.col("upd").alias("updn"))
    d.write.format("xml").option("rowTag", "cell").option("rootTag", "catalog").save(path)
    return src.read_cells(spark, path)


@query("S18_json_frames", "SELECT event_id AS seq, CASE WHEN event_id % 10 = 0 THEN 'welcome' WHEN event_id % 10 = 1 THEN 'error' WHEN event_id % 10 = 2 THEN 'bad' ELSE 'event' END AS kind, event_id % 10 >= 6 AS has_raw FROM events")
def _(spark, sf):
    k = F.col("event_id")
    v = F.when(k % 10 == 0, '{"type":"welcome"}').when(k % 10 == 1, '{"type":"error","message":"x"}').when(k % 10 == 2, "not json").when(k % 10 < 6, '{"type":"event","mmsi":367000001,"lat":1.5,"lon":2.5}').otherwise('{"type":"event","raw":["!AIVDM,1,1,,A,x,0*00"]}')
    d = src.stream_frames(table(spark, sf, "events").select(k.alias("seq"), v.alias("value")))
    return d.select("seq", "kind", F.col("raw").isNotNull().alias("has_raw"))


DTED = with_ctes("posts") + """, p AS (SELECT -100 + col // 12 AS w, 30 + row // 12 AS s, row % 12 AS r, col % 12 AS c, elev FROM posts), g AS (SELECT w, s, max(r) AS mr, max(c) AS mc FROM p GROUP BY w, s), a AS (SELECT w, s, r, c, mr, mc FROM g, range(0, 12) x(r), range(0, 12) y(c) WHERE r <= mr AND c <= mc)
 SELECT 'w' || lpad((-w)::VARCHAR, 3, '0') || '/n' || s AS cell, 1 AS level, CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, round(s + r/greatest(mr, 1)::DOUBLE, 6) AS lat, round(w + c/greatest(mc, 1)::DOUBLE, 6) AS lon, max(elev) AS elev FROM a LEFT JOIN p USING (w, s, r, c) GROUP BY ALL"""


@query("S11_X4_dted_cells", DTED)
def _(spark, sf):
    from ..sources import landed
    landed.register(spark)
    path = scratch(spark, "dted")
    p = derived(spark, sf, "posts").selectExpr("cast(-100 + col div 12 as int) AS w", "cast(30 + row div 12 as int) AS s", "row % 12 AS row", "col % 12 AS col", "elev")
    landed.write_dted(p.groupBy("w", "s", "row", "col").agg(F.max("elev").alias("elev")), path)
    d = spark.read.format("landed").option("kind", "dted").load(path)
    return d.withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query("O9_best_level", """WITH c AS (SELECT l_suppkey AS cell, l_linenumber % 3 AS level, l_orderkey AS post, l_quantity AS elev FROM lineitem WHERE l_suppkey % 4 <> 1 OR l_linenumber % 3 < 2) SELECT cell, level, post, CAST(elev AS DOUBLE) AS elev FROM c QUALIFY level = max(level) OVER (PARTITION BY cell)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_suppkey % 4 <> 1 or l_linenumber % 3 < 2")
    return src.best_level(li.select(F.col("l_suppkey").alias("cell"), (F.col("l_linenumber") % 3).alias("level"), F.col("l_orderkey").alias("post"), F.col("l_quantity").cast("double").alias("elev")))


@query("S15_versioned_table", "SELECT c_custkey AS id, c_name AS name, c_acctbal::DOUBLE AS value FROM customer WHERE c_nationkey % 3 <> 0")
def _(spark, sf):
    # a file per nation; every third nation's is of another version and is refused
    path = scratch(spark, "tables")
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("double").cast("string")).alias("value"))
    first = c.select("c_nationkey").distinct().select("c_nationkey", F.lit(-1).alias("c_custkey"), F.concat(F.lit("#version="), F.when(F.col("c_nationkey") % 3 == 0, "1").otherwise("2")).alias("value"))
    rows = first.unionByName(c.withColumn("c_custkey", F.col("c_custkey").cast("int"))).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    return src.read_table(spark, f"{path}/*", "id long, name string, value double", "2").select("id", "name", "value")
