"""Feature sources and sinks: GeoJSON, GPX, OSM XML, web pages, chart lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Date, date-time, email and link shapes; field names read as telephone numbers.
DATE = r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL = r"^https?://\S+$"
PHONE_NAMES = ["phone", "tel", "telephone", "phone_number"]


# Geometry types.
GEOMETRIES = ["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection"]


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(file, v, kind): parsed documents, one per file (on as many lines as it likes) or one per line."""
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    v = raw.select("file", F.try_parse_json("value").alias("v"))
    return v.withColumn("kind", F.try_variant_get("v", "$.type", "string"))


def bad_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file, error): documents that are no JSON (not_json) or neither features nor a geometry (no_features)."""
    ok = F.col("kind").isin("FeatureCollection", "Feature", *GEOMETRIES)
    d = _documents(spark, path, lines).select("file", F.when(F.col("v").isNull(), "not_json").when(~F.coalesce(ok, F.lit(False)), "no_features").alias("error"))
    return d.filter(F.col("error").isNotNull())


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features (file, pos, fid, geometry, properties) of documents: collections, single features or bare geometries.

    A file is one document; with ``lines`` every line is one. Geometry and properties stay VARIANT, so numbers, texts and
    booleans remain apart. What is none of these gives no rows here; ``bad_geojson`` lists it.
    """
    raw = _documents(spark, path, lines).filter(F.col("kind").isin("FeatureCollection", "Feature", *GEOMETRIES))
    v, kind = F.col("v"), F.col("kind")
    items = F.when(kind == "FeatureCollection", F.try_variant_get(v, "$.features", "array<variant>")).when(kind == "Feature", F.array(v)).otherwise(
        F.array(F.parse_json(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.to_json(v), F.lit("}")))))
    e = raw.select("file", F.posexplode(items).alias("pos", "f"))
    return e.select("file", "pos", F.try_variant_get("f", "$.id", "bigint").alias("fid"), F.try_variant_get("f", "$.geometry", "variant").alias("geometry"), F.try_variant_get("f", "$.properties", "variant").alias("properties"))


def assign_ids(df: DataFrame) -> DataFrame:
    """Integer ids kept when all are distinct and positive; else features are numbered from 1 in (file, pos) order."""
    from ..operators.ordered import Ordered
    per = df.groupBy("fid").agg(F.count("*").alias("c"))
    ok = per.agg((F.max("c") == 1).alias("one"), (F.count("fid") == F.count("*")).alias("known"), (F.min("fid") > 0).alias("pos"))
    ok = ok.select((F.col("one") & F.col("known") & F.coalesce("pos", F.lit(False))).alias("_keep"))
    d = df.withColumn("_g", F.lit(0))
    # files are numbered by name; there are far fewer files than features
    files = d.select("file").distinct()
    files = files.withColumn("_fn", F.row_number().over(Window.orderBy("file")).cast("long"))
    o = Ordered(d.join(files, "file"), ["_g"], ["_fn", "pos"], F.col("_fn") * 1000000 + F.floor(F.col("pos") / 10000)).running(sums={"_n": F.lit(1).cast("long")}).result()
    return o.crossJoin(F.broadcast(ok)).withColumn("id", F.when(F.col("_keep"), F.col("fid")).otherwise(F.col("_n"))).drop("_g", "_fn", "_n", "_keep", "fid")


def infer_fields(df: DataFrame) -> DataFrame:
    """Type and role of every property: one kind only decides, integer with real is real, mixtures are text."""
    kv = df.select(F.expr("CAST(properties AS MAP<STRING, VARIANT>)").alias("m")).select(F.explode("m").alias("key", "value"))
    s = kv.select("key", F.schema_of_variant("value").alias("t"), F.try_variant_get("value", "$", "string").alias("x")).filter("t <> 'VOID'")
    is_text = F.col("t") == "STRING"
    flags = {"boolean": F.col("t") == "BOOLEAN", "integer": F.col("t") == "BIGINT", "real": (F.col("t") == "DOUBLE") | F.col("t").startswith("DECIMAL"),
             "date": is_text & F.col("x").rlike(DATE), "datetime": is_text & F.col("x").rlike(DATETIME),
             "text": is_text & ~F.col("x").rlike(DATE) & ~F.col("x").rlike(DATETIME), "other": F.col("t").startswith("ARRAY") | F.col("t").startswith("OBJECT") | F.col("t").startswith("STRUCT")}
    a = s.groupBy("key").agg(*[F.max(c).alias(f"_{n}") for n, c in flags.items()], F.min(is_text & F.col("x").rlike(URL)).alias("_url"), F.min(is_text & F.col("x").rlike(EMAIL)).alias("_email"))
    c = F.col
    strings, numbers = c("_text") | c("_date") | c("_datetime"), c("_integer") | c("_real")
    kinds = sum((x.cast("int") for x in (c("_boolean"), numbers, strings, c("_other"))), F.lit(0))
    t = (F.when((kinds != 1) | c("_other"), "text").when(c("_boolean"), "boolean").when(c("_real"), "real").when(c("_integer"), "integer")
         .when(~c("_text") & c("_date") & ~c("_datetime"), "date").when(~c("_text") & c("_datetime") & ~c("_date"), "datetime").otherwise("text"))
    role = F.when((t == "text") & strings & (kinds == 1), F.when(c("_url"), "url").when(c("_email"), "email").when(F.lower("key").isin(*PHONE_NAMES), "phone"))
    return a.select("key", t.alias("type"), role.alias("role"))


def ring_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring of struct(lat, lon): positive is counter-clockwise."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.get(ring, i - 1).lon * F.get(ring, i).lat - F.get(ring, i).lon * F.get(ring, i - 1).lat)
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def orient(rings: Column) -> Column:
    """First ring counter-clockwise, the others clockwise."""
    return F.transform(rings, lambda r, i: F.when((ring_area(r) > 0) == (i == 0), r).otherwise(F.reverse(r)))


def geojson_lines(df: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per line from (id, rings array<array<struct<lat,lon>>>)."""
    coords = F.transform(orient(F.col("rings")), lambda r: F.transform(r, lambda p: F.array(p.lon, p.lat)))
    g = F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "id", g.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


GPX_POINT = "struct<_lat: double, _lon: double, ele: double, time: string>"


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Track points (file, track, segment, seq, lat, lon, alt, t); a missing time stays null."""
    d = spark.read.format("xml").option("rowTag", "trk").schema(f"name string, trkseg array<struct<trkpt: array<{GPX_POINT}>>>").load(path)
    s = d.select(F.col("name").alias("track"), F.posexplode("trkseg").alias("segment", "s"))
    p = s.select("track", "segment", F.posexplode("s.trkpt").alias("seq", "p"))
    return p.select("track", "segment", "seq", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("alt"), (F.unix_micros(F.to_timestamp("p.time")) / 1e6).alias("t"))


def write_gpx(fixes: DataFrame, path: str, limit_points: int = 1000000) -> None:
    """Tracks with segment borders, seven-decimal coordinates, no element for an absent field.

    One <trk> element per (track, segment) stretch of at most ``limit_points`` points, so no row grows
    without bound; a longer segment continues in a further element of the same name.
    """
    iso = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    pt = F.struct(F.round("lat", 7).alias("_lat"), F.round("lon", 7).alias("_lon"), F.col("alt").alias("ele"), iso.alias("time"))
    g = fixes.groupBy("track", "segment", F.floor(F.col("seq") / limit_points).alias("_part")).agg(F.array_sort(F.collect_list(F.struct("seq", pt.alias("p")))).alias("_s"))
    d = g.select(F.col("track").cast("string").alias("name"), F.array(F.struct(F.transform("_s", lambda x: x.p).alias("trkpt"))).alias("trkseg"))
    d.write.format("xml").option("rowTag", "trk").option("rootTag", 'gpx version="1.1"').mode("overwrite").save(path)


def read_osm(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """OSM XML elements of one kind (node, way or relation) with tags as a map."""
    body = {"node": "_lat double, _lon double", "way": "nd array<struct<_ref: bigint>>", "relation": "member array<struct<_type: string, _ref: bigint, _role: string>>"}[kind]
    d = spark.read.format("xml").option("rowTag", kind).schema(f"_id bigint, tag array<struct<_k: string, _v: string>>, {body}").load(path)
    tags = F.map_from_entries(F.coalesce(F.col("tag"), F.array().cast("array<struct<_k: string, _v: string>>"))).alias("tags")
    rest = {"node": [F.col("_lat").alias("lat"), F.col("_lon").alias("lon")], "way": [F.transform("nd", lambda n: n._ref).alias("refs")],
            "relation": [F.transform("member", lambda m: F.struct(m._type.alias("type"), m._ref.alias("ref"), m._role.alias("role"))).alias("members")]}[kind]
    return d.select(F.col("_id").alias("id"), *rest, tags)


def page_id(text: Column) -> Column:
    """A positive integer of at most 18 digits is the id; any other text becomes a 63-bit hash, 0 as 1."""
    n = F.when(text.rlike(r"^\d{1,18}$"), text.try_cast("long"))
    h = F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    return F.when(n > 0, n).otherwise(F.when(h == 0, 1).otherwise(h))


def page_features(pages: DataFrame) -> DataFrame:
    """Features of landed page payloads (a ``payload`` text column): id, lon, lat, properties."""
    d = pages.withColumn("d", F.from_json("payload", "features array<struct<id: string, geometry: struct<coordinates: array<double>>, properties: map<string, string>>>"))
    return d.select(F.explode("d.features").alias("f")).select(page_id(F.col("f.id")).alias("id"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.properties").alias("properties"))


def esri_time(ms: Column) -> Column:
    """Epoch milliseconds to ISO text."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Product catalog rows from <cell> elements."""
    s = "name string, status string, edtn int, updn int, coast_guard_districts struct<coast_guard_district: array<string>>"
    return spark.read.format("xml").option("rowTag", "cell").schema(s).load(path).select("name", (F.col("status") == "Cancelled").alias("cancelled"), F.col("edtn").alias("edition"), F.col("updn").alias("upd"))


def read_table(spark: SparkSession, path: str, schema: str, version: str) -> DataFrame:
    """A tab-separated table whose files begin with a version line; files of another version are refused as rows of none."""
    raw = spark.read.option("sep", "\t").schema(schema).csv(path, comment="#")
    first = spark.read.text(path).filter(F.col("value").startswith("#version=")).select(F.col("_metadata.file_path").alias("file"), F.split_part("value", F.lit("="), F.lit(2)).alias("v"))
    good = first.filter(F.col("v") == version).select("file").distinct()
    return raw.withColumn("file", F.col("_metadata.file_path")).join(good, "file", "left_semi").drop("file")


def read_wind(df: DataFrame) -> DataFrame:
    """Forecast values (series, valid, value in km/h): half-open intervals from ``start/PTnH`` texts, in m/s."""
    start = F.unix_timestamp(F.to_timestamp(F.split_part("valid", F.lit("/"), F.lit(1))))
    d = F.coalesce(F.regexp_extract("valid", r"P(\d+)D", 1).try_cast("int"), F.lit(0)) * 24 + F.coalesce(F.regexp_extract("valid", r"T(\d+)H", 1).try_cast("int"), F.lit(0))
    return df.select("series", start.cast("double").alias("begin"), (start + d * 3600).cast("double").alias("end"), (F.col("value") / 3.6).alias("value")).filter(F.col("end") > F.col("begin"))


def stream_frames(frames: DataFrame) -> DataFrame:
    """Frames of an AIS JSON stream: kind welcome, error or event; an event carries raw sentences or a decoded fallback."""
    s = "type string, raw array<string>, mmsi bigint, lat double, lon double, sog double, dim array<int>, ship_type int, message string"
    d = frames.withColumn("d", F.from_json("value", s))
    kind = F.when(F.col("d").isNull() | F.col("d.type").isNull(), "bad").when(F.col("d.type").isin("welcome", "error"), F.col("d.type")).otherwise("event")
    return d.select("seq", kind.alias("kind"), F.when(F.size("d.raw") > 0, F.col("d.raw")).alias("raw"), F.when(~(F.coalesce(F.size("d.raw"), F.lit(0)) > 0), F.struct("d.mmsi", "d.lat", "d.lon", "d.sog")).alias("decoded"))


def read_dted(spark: SparkSession, path: str) -> DataFrame:
    """Elevation posts of DTED files: (cell, level, row, col, elev); sign-magnitude heights, void as null. One file is one cell."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dt?").option("recursiveFileLookup", "true").load(path)

    def posts(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                b = bytes(r.content)
                cols, rows = int(b[47:51]), int(b[51:55])
                size, head = 12 + 2 * rows, 80 + 648 + 2700
                grid = np.frombuffer(b[head:head + cols * size], dtype=np.uint8).reshape(cols, size)[:, 8:8 + 2 * rows].copy().view(">u2").astype(np.int32)
                z = np.where(grid >= 32768, -(grid - 32768), grid).astype(float)
                z[z == -32767] = np.nan
                c, w = np.meshgrid(np.arange(cols), np.arange(rows), indexing="ij")
                yield pd.DataFrame({"cell": "/".join(r.path.split("/")[-2:]).rsplit(".", 1)[0], "level": int(r.path[-1]), "row": w.ravel(), "col": c.ravel(), "elev": z.ravel()})
    return files.select("path", "content").mapInPandas(posts, "cell string, level int, row long, col long, elev double").withColumn("elev", F.when(~F.isnan("elev"), F.col("elev")))


def best_level(posts: DataFrame) -> DataFrame:
    """Only the posts of the best level each cell has."""
    top = posts.groupBy("cell").agg(F.max("level").alias("level"))
    return posts.join(top, ["cell", "level"], "left_semi")


def frames(spark: SparkSession, path: str, pattern: str = r"([^/]+)/([^/]+)\.\w+$") -> DataFrame:
    """One row per product file under a tree: path, size, series and cell taken from its name."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return d.select("path", F.col("length").alias("size_bytes"), F.regexp_extract("path", pattern, 1).alias("series_key"), F.regexp_extract("path", pattern, 2).alias("cell"))


def point_document(df: DataFrame) -> DataFrame:
    """Point documents in their fixed schema: name, category, remarks, elevation_ft, phone, url, symbol."""
    want = ["name", "category", "remarks", "elevation_ft", "phone", "url", "symbol"]
    have = {c.lower(): c for c in df.columns}
    return df.select("id", "lat", "lon", *[F.col(have[w]).cast("double" if w == "elevation_ft" else "string").alias(w) if w in have else F.lit(None).cast("double" if w == "elevation_ft" else "string").alias(w) for w in want])
