"""Feature-table queries: scans, filters, value functions, classification, edits, schema change."""
from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import geo, text, units, values as V
from ..operators import features as ops
from .derived import derived, table, with_ctes
from .registry import query

FEAT = with_ctes("features")
PTS = with_ctes("points")


def feats(spark, sf):
    return derived(spark, sf, "features")


def boxed(spark, sf):
    """Points as features with an envelope; every 19th has no geometry."""
    p = derived(spark, sf, "points")
    ok = F.col("id") % 19 != 0
    half = (F.col("id") % 3) * 0.5
    return p.select("id", "title", "layer", F.when(ok, F.col("lat") - half).alias("min_lat"),
                    F.when(ok, F.col("lon") - half).alias("min_lon"), F.when(ok, F.col("lat") + half).alias("max_lat"),
                    F.when(ok, F.col("lon") + half).alias("max_lon"))


BOXED = PTS + """, boxed AS (SELECT id, title, layer,
 CASE WHEN id % 19 <> 0 THEN lat - (id % 3)*0.5e0 END AS min_lat, CASE WHEN id % 19 <> 0 THEN lon - (id % 3)*0.5e0 END AS min_lon,
 CASE WHEN id % 19 <> 0 THEN lat + (id % 3)*0.5e0 END AS max_lat, CASE WHEN id % 19 <> 0 THEN lon + (id % 3)*0.5e0 END AS max_lon FROM points) """


@query("S1_feature_scan", FEAT + "SELECT * FROM features")
def _(spark, sf):
    return feats(spark, sf)


@query("P1_filter_features", FEAT + """SELECT id, depth_text FROM features
 WHERE depth_text IS NOT NULL AND try_cast(trim(depth_text) AS DOUBLE) < 7""")
def _(spark, sf):
    df = feats(spark, sf)
    return ops.filter_features(df, V.orders(F.col("depth_text"), "<", 7)).select("id", "depth_text")


@query("P2_select_where", FEAT + """SELECT id, name, brand, size, price FROM features
 WHERE size >= 10 AND contains(lower(name), 'red') ORDER BY price DESC, id""")
def _(spark, sf):
    df = ops.select_where(feats(spark, sf), [("size", ">=", "10"), ("NAME", "contains", " Red ")])
    return ops.sort_rows(df, "price", ascending=False).select("id", "name", "brand", "size", "price")


@query("P2_select_where_any", FEAT + """SELECT id FROM features WHERE depth IS NULL OR lit OR price > 1e3 AND price IS NOT NULL
 OR brand = 'Brand#2' OR NOT (kind IS NOT DISTINCT FROM 'ECONOMY')""")
def _(spark, sf):
    return ops.select_where(feats(spark, sf), [("depth", "is empty"), ("lit", "=", "yes"), ("price", ">", "1000"),
                                               ("brand", "=", "Brand#2"), ("kind", "!=", "ECONOMY")], "any").select("id")


SAVED = {"shallow": ("all", [("depth", "<", "5"), ("depth", "is not empty")]),
         "lit or dear": ("any", [("lit", "=", "true"), ("price", ">=", "1500")]),
         "brand two": ("all", [("brand", "=", "Brand#2")])}


@query("P3_saved_queries", FEAT + """SELECT 'shallow' AS query_id, id FROM features WHERE depth < 5
 UNION ALL SELECT 'lit or dear', id FROM features WHERE lit OR price >= 1500
 UNION ALL SELECT 'brand two', id FROM features WHERE brand = 'Brand#2'""")
def _(spark, sf):
    return ops.saved_queries(feats(spark, sf), SAVED)


@query("P4_definition_query", FEAT + "SELECT kind, count(*) AS n FROM features WHERE size > 25 AND kind <> 'PROMO' GROUP BY kind")
def _(spark, sf):
    shown = ops.select_where(feats(spark, sf), [("size", ">", "25")])
    return ops.select_where(shown, [("kind", "!=", "PROMO")]).groupBy("kind").agg(F.count("*").alias("n"))


@query("P5_box_query", BOXED + """SELECT id FROM boxed WHERE min_lat <= 40 AND max_lat >= -20
 AND ((min_lon <= 180 AND max_lon >= 150) OR (min_lon <= -140 AND max_lon >= -180))""")
def _(spark, sf):
    return ops.in_box(boxed(spark, sf), (-20.0, 150.0, 40.0, -140.0)).select("id")


@query("P6_box_query_fields", BOXED + """SELECT id, title FROM boxed WHERE min_lat <= 30 AND max_lat >= 0 AND min_lon <= 90 AND max_lon >= 10""")
def _(spark, sf):
    return ops.in_box(boxed(spark, sf), (0.0, 10.0, 30.0, 90.0)).select("id", "title")


@query("P7_get_by_id", FEAT + "SELECT * FROM features WHERE id = 42")
def _(spark, sf):
    return feats(spark, sf).filter(F.col("id") == 42)


@query("P8_rows_with_text", FEAT + """SELECT id, name, brand FROM features
 WHERE contains(lower(name), 'wid') OR contains(lower(brand), 'wid') OR contains(lower(kind), 'wid')""")
def _(spark, sf):
    return ops.rows_with_text(feats(spark, sf), ["name", "brand", "kind"], "WiD").select("id", "name", "brand")


@query("P20_bounds_algebra", with_ctes("boxes") + """SELECT cov_id,
 (c_s <= 10 AND c_n >= 10) AND CASE WHEN c_w > c_e THEN 179.5e0 >= c_w OR 179.5e0 <= c_e ELSE 179.5e0 >= c_w AND 179.5e0 <= c_e END AS holds_point,
 c_s <= 20 AND c_n >= -20 AND CASE WHEN c_w > c_e THEN c_w <= 60 OR -30 <= c_e ELSE c_w <= 60 AND -30 <= c_e END AS meets,
 -60 <= c_s AND c_n <= 60 AND c_w <= c_e AND -170 <= c_w AND c_e <= 170 AS enclosed,
 round((c_s + c_n)/2, 6) AS mid_lat, round(CASE WHEN c_w > c_e THEN c_e + 360 - c_w ELSE c_e - c_w END, 6) AS width FROM boxes""")
def _(spark, sf):
    b = derived(spark, sf, "boxes")
    box = tuple(F.col(c) for c in ("c_s", "c_w", "c_n", "c_e"))
    return b.select("cov_id", geo.box_contains(10.0, 179.5, *box).alias("holds_point"),
                    geo.box_intersects(box, (-20.0, -30.0, 20.0, 60.0)).alias("meets"),
                    geo.box_encloses((-60.0, -170.0, 60.0, 170.0), box).alias("enclosed"),
                    F.round(geo.box_center(*box).lat, 6).alias("mid_lat"), F.round(geo.lon_span(box[1], box[3]), 6).alias("width"))


@query("P21_value_errors", FEAT + """SELECT id, 'depth' AS field, CASE WHEN depth IS NULL THEN 'missing' WHEN depth < 3 THEN 'below_min'
 ELSE 'above_max' END AS error FROM features WHERE depth IS NULL OR depth < 3 OR depth > 45
 UNION ALL SELECT id, 'kind', 'unlisted_choice' FROM features WHERE kind NOT IN ('ECONOMY', 'PROMO')""")
def _(spark, sf):
    return ops.validate_rows(feats(spark, sf), {"depth": {"required": True, "lo": 3, "hi": 45}, "kind": {"choices": ["ECONOMY", "PROMO"]}})


@query("P22_schema_errors", """WITH f AS (SELECT CASE WHEN p_partkey % 50 = 7 THEN '' ELSE 'F' || CAST(p_partkey % 900 AS VARCHAR) END AS name,
 CASE WHEN p_partkey % 4 = 0 THEN 'date' ELSE 'integer' END AS type, CASE WHEN p_partkey % 5 = 0 THEN 'enumeration' ELSE '' END AS role,
 p_partkey % 3 AS n_choices, p_size AS min, 40 AS max, CASE WHEN p_partkey % 40 = 12 THEN 'F16' WHEN p_partkey % 40 = 13 THEN 'f17' END AS range_end FROM part WHERE p_partkey < 1200),
 c AS (SELECT lower(name) AS low, count(*) AS k FROM f GROUP BY 1), d AS (SELECT DISTINCT lower(name) AS low FROM f WHERE type = 'date'),
 e AS (SELECT f.name, CASE WHEN f.name = '' THEN 'unnamed' WHEN k > 1 THEN 'duplicate_name' WHEN role = 'enumeration' AND n_choices = 0 THEN 'empty_choices'
 WHEN min > max THEN 'crossed_limits' WHEN coalesce(range_end, '') <> '' AND NOT (type = 'date' AND d.low IS NOT NULL) THEN 'range_end_not_date' END AS error
 FROM f JOIN c ON lower(f.name) = c.low LEFT JOIN d ON lower(range_end) = d.low) SELECT DISTINCT name, error FROM e WHERE error IS NOT NULL""".replace(" WHERE p_partkey < 1200", ""))
def _(spark, sf):
    f = table(spark, sf, "part").selectExpr(
        "CASE WHEN p_partkey % 50 = 7 THEN '' ELSE 'F' || CAST(p_partkey % 900 AS STRING) END AS name",
        "CASE WHEN p_partkey % 4 = 0 THEN 'date' ELSE 'integer' END AS type",
        "CASE WHEN p_partkey % 5 = 0 THEN 'enumeration' ELSE '' END AS role", "p_partkey % 3 AS n_choices", "p_size AS min", "40 AS max",
        "CASE WHEN p_partkey % 40 = 12 THEN 'F16' WHEN p_partkey % 40 = 13 THEN 'f17' END AS range_end")
    return ops.validate_schema(f).distinct()


@query("P24_named_features", FEAT + "SELECT id, trim(depth_text) AS name FROM features WHERE length(trim(depth_text)) > 0")
def _(spark, sf):
    return feats(spark, sf).filter(F.length(F.trim("depth_text")) > 0).select("id", F.trim("depth_text").alias("name"))


# --- value functions --------------------------------------------------------------------------

@query("E2_E12_compare", FEAT + """SELECT id, coalesce(try_cast(depth_text AS DOUBLE) = 7, false) AS eq7,
 NOT coalesce(try_cast(depth_text AS DOUBLE) = 7, false) AS ne7, coalesce(try_cast(depth_text AS DOUBLE) >= 20, false) AS ge20,
 coalesce(name < 'm', false) AS before_m, depth IS NOT NULL AS has_depth, coalesce(try_cast(nullif(depth_text, '') AS DOUBLE), CASE WHEN depth_text IS NULL THEN 0e0 END) AS num,
 coalesce(depth_text <> '', false) AS truthy FROM features""")
def _(spark, sf):
    d = F.col("depth_text")
    return feats(spark, sf).select("id", V.equals(d, 7, "number").alias("eq7"), (~V.equals(d, 7, "number")).alias("ne7"),
                                   V.orders(d, ">=", 20).alias("ge20"), V.orders(F.col("name"), "<", "m").alias("before_m"),
                                   V.has(F.col("depth"), T.IntegerType()).alias("has_depth"),
                                   V.to_number((d, T.StringType())).alias("num"), V.to_boolean(d, T.StringType()).alias("truthy"))


@query("E13_E19_logic", FEAT + """SELECT id, (lit AND size > 20) AS both, (lit OR depth > 40 AND depth IS NOT NULL) AS either,
 contains(kind, 'CON') AS has_con, name IN ('red widget', 'small ring') AS listed,
 CASE WHEN kind IN ('ECONOMY', 'PROMO') THEN 'cheap' WHEN kind = 'STANDARD' THEN 'plain' ELSE 'other' END AS grade,
 CASE WHEN depth < 10 THEN 1 WHEN lit THEN 2 ELSE 3 END AS pick, coalesce(depth_text, name, '') AS first_text FROM features""")
def _(spark, sf):
    c = F.col
    return feats(spark, sf).select(
        "id", V.all_of([c("lit"), c("size") > 20]).alias("both"), V.any_of([c("lit"), c("depth") > 40]).alias("either"),
        V.is_in(F.lit("CON"), c("kind")).alias("has_con"), V.is_in(c("name"), ["red widget", "small ring"]).alias("listed"),
        V.match(c("kind"), [(["ECONOMY", "PROMO"], F.lit("cheap")), (["STANDARD"], F.lit("plain"))], F.lit("other")).alias("grade"),
        V.case([(c("depth") < 10, F.lit(1)), (c("lit"), F.lit(2))], F.lit(3)).alias("pick"),
        F.coalesce(c("depth_text"), c("name"), F.lit("")).alias("first_text"))


@query("E5_geometry_type", """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 3 THEN ['Point', 'LineString', 'Polygon'][1 + p_partkey % 5]
 WHEN p_partkey % 5 = 3 THEN 'LineString' WHEN p_partkey % 2 = 0 THEN 'Point' END AS geometry_type FROM part""")
def _(spark, sf):
    k = F.col("p_partkey") % 5
    g = F.when(k == 0, "Point").when(k == 1, "MultiLineString").when(k == 2, "Polygon").when(k == 3, "MultiLineString").otherwise("GeometryCollection")
    parts = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("Point"), F.lit("MultiPoint"))).otherwise(F.array(F.lit("Point"), F.lit("Polygon")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), V.geometry_type(g, parts).alias("geometry_type"))


@query("E20_E24_ramps", FEAT + """SELECT id, CASE WHEN depth >= 30 THEN 'deep' WHEN depth >= 10 THEN 'mid' ELSE 'base' END AS stepped,
 round(CASE WHEN depth <= 10 THEN 1 WHEN depth < 30 THEN 1 + (depth - 10)/20e0*4 WHEN depth < 45 THEN 5 + (depth - 30)/15e0*5 WHEN depth IS NOT NULL THEN 10 END, 6) AS linear,
 round(CASE WHEN depth <= 0 THEN 0 WHEN depth < 20 THEN (pow(1.5e0, depth) - 1)/(pow(1.5e0, 20) - 1)*8 WHEN depth IS NOT NULL THEN 8 END, 6) AS curved,
 coalesce(depth_text, '') || '-' || name AS joined, upper(name) AS up, depth*2e0 + size AS summed, CASE WHEN depth IS NOT NULL THEN -CAST(depth AS DOUBLE) END AS neg,
 CASE WHEN depth IS NOT NULL THEN greatest(CAST(depth AS DOUBLE), 25e0) END AS top, CAST(size % 7 AS DOUBLE) AS rem FROM features""")
def _(spark, sf):
    d, c = F.col("depth"), F.col
    return feats(spark, sf).select(
        "id", V.step(d, "base", [(10, "mid"), (30, "deep")]).alias("stepped"),
        F.round(V.interpolate(d, [(10, 1), (30, 5), (45, 10)]), 6).alias("linear"),
        F.round(V.interpolate(d, [(0, 0), (20, 8)], base=1.5), 6).alias("curved"),
        V.concat_text(c("depth_text"), F.lit("-"), c("name")).alias("joined"), V.upcase(c("name")).alias("up"),
        V.arithmetic("+", V.arithmetic("*", d, F.lit(2)), c("size")).alias("summed"), V.arithmetic("-", d).alias("neg"),
        V.arithmetic("max", d, F.lit(25)).alias("top"), V.arithmetic("%", c("size"), F.lit(7)).alias("rem"))


@query("F10_F11_value_text", FEAT + """SELECT id, CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END AS price_key,
 CASE WHEN lit THEN 'true' ELSE 'false' END AS lit_key, CASE WHEN lit THEN 'yes' ELSE 'no' END AS lit_label,
 coalesce(CAST(depth AS VARCHAR), '') AS depth_key FROM features""")
def _(spark, sf):
    return feats(spark, sf).select(
        "id", V.category_key(F.col("price"), T.DoubleType()).alias("price_key"), V.category_key(F.col("lit"), T.BooleanType()).alias("lit_key"),
        V.label_text(F.col("lit"), T.BooleanType()).alias("lit_label"), V.category_key(F.col("depth"), T.IntegerType()).alias("depth_key"))


@query("F12_action_urls", """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'tel:+' || CAST(1000000 + c_custkey AS VARCHAR)
 WHEN c_custkey % 3 = 1 THEN 'mailto:c' || CAST(c_custkey AS VARCHAR) || '@x.org' ELSE 'https://x.org/' || CAST(c_custkey AS VARCHAR) END AS url FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey")
    n = (k + 1000000).cast("string")
    phone = V.action_url(F.concat(F.lit(" +"), F.substring(n, 1, 3), F.lit(" ("), F.substring(n, 4, 20), F.lit(")")), "phone")
    mail = V.action_url(F.concat(F.lit("c"), k.cast("string"), F.lit("@x.org ")), "email")
    web = V.action_url(F.concat(F.lit("x.org/"), k.cast("string")), "url")
    return table(spark, sf, "customer").select(k.alias("id"), F.when(k % 3 == 0, phone).when(k % 3 == 1, mail).otherwise(web).alias("url"))


_WORDS = "list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\n\\t\\r\\f\\x0B]+'), lambda t: t <> '')"


def queries_met(q, d):
    """Documents (doc_id, c) that may match queries (item_id, q, qt: its words): (doc_id, item_id, q)."""
    # a match has, for each word of the query, a word that starts with it: words and queries meet on the first eight or four letters of a query's word,
    # or all of it if it is shorter, and of a query's words the one found in the fewest documents is taken
    def key(t):
        n = F.length(t)
        return F.substring(t, F.lit(1), F.when(n >= 8, 8).when(n >= 4, 4).otherwise(n))
    words = F.array_distinct(text.tokens(text.ascii_lower(F.col("c"))))
    starts = F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.array(*[F.lit(n) for n in (1, 2, 3, 4, 8)]), lambda n: F.substring(w, F.lit(1), n)))))
    held = d.select("doc_id", F.explode(starts).alias("k"))
    keys = q.select("item_id", F.explode(F.array_distinct(F.transform("qt", key))).alias("k"))
    found = held.join(keys.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.count("*").alias("docs"))
    # a word of no document leaves the query without a match
    rarest = keys.join(found, "k", "left").groupBy("item_id").agg(F.min_by("k", F.struct(F.coalesce("docs", F.lit(0)), "k")).alias("k"))
    return held.join(q.join(rarest, "item_id"), "k").select("doc_id", "item_id", "q")


@query("F8_match_quality", f"""WITH i AS (SELECT item_id, {_WORDS.format('text')} AS t FROM benchmark),
 q AS (SELECT item_id, array_to_string(t, ' ') AS q, t AS qt FROM i WHERE len(t) > 0),
 d2 AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS c, {_WORDS.format('text')} AS ct FROM documents),
 w AS (SELECT DISTINCT doc_id, unnest(ct) AS w FROM d2), k AS (SELECT DISTINCT doc_id, item_id FROM w JOIN q ON starts_with(w, qt[1])),
 m AS (SELECT doc_id, item_id, CASE WHEN c = q THEN 0 WHEN starts_with(c, q) THEN 1
  WHEN len(list_filter(qt, lambda t: len(list_filter(ct, lambda w: starts_with(w, t))) = 0)) = 0 THEN 2 ELSE -1 END AS quality FROM k JOIN d2 USING (doc_id) JOIN q USING (item_id))
 SELECT doc_id, item_id, quality FROM m WHERE quality >= 0""")
def _(spark, sf):
    # typed queries: each whole benchmark text, over the whole texts of all documents
    said = text.tokens(text.ascii_lower(F.col("text")))
    q = table(spark, sf, "benchmark").select("item_id", said.alias("qt")).filter(F.size("qt") > 0).select("item_id", F.array_join("qt", " ").alias("q"), "qt")
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("c"))
    met = queries_met(q, d)
    return (met.join(d, "doc_id").select("doc_id", "item_id", text.match_quality(F.col("q"), F.col("c")).cast("int").alias("quality"))
            .filter(F.col("quality") >= 0))


@query("F9_fold_title", """SELECT doc_id, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\n\\t\\r\\f\\x0B]+', ' ', 'g')) AS folded FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.fold_title(F.col("text")).alias("folded"))


@query("F13_F15_measures", FEAT + """SELECT id, round(price*100/1852e0, 6) AS nm, round(price*100/(0.3048e0*0.3048e0), 3) AS sqft, round(size*7.3e0*17.777777777777777e0, 6) AS mils,
 CASE WHEN price*100/1852e0 < 100 THEN printf('%.2f', price*100/1852e0) WHEN price*100/1852e0 < 1000 THEN printf('%.1f', price*100/1852e0) ELSE printf('%.0f', price*100/1852e0) END || ' NM' AS range_text,
 printf('%05.1f', size*7.13e0) || '°' AS bearing_text,
 printf('%03d', CAST(floor(size*7.13e0) AS INT)) || '° ' || printf('%02d', CAST(floor((size*7.13e0 - floor(size*7.13e0))*60) AS INT)) || ''' ' ||
 printf('%02d', CAST(floor(((size*7.13e0 - floor(size*7.13e0))*60 - floor((size*7.13e0 - floor(size*7.13e0))*60))*60) AS INT)) || '"' AS dms_text,
 round(CASE WHEN size*7.13e0 - (size % 30 - 15) < 0 THEN size*7.13e0 - (size % 30 - 15) + 360 WHEN size*7.13e0 - (size % 30 - 15) > 360 THEN size*7.13e0 - (size % 30 - 15) - 360
 ELSE size*7.13e0 - (size % 30 - 15) END, 6) AS magnetic FROM features""")
def _(spark, sf):
    m, b = F.col("price") * 100, F.col("size") * 7.13
    return feats(spark, sf).select(
        "id", F.round(units.convert_range(m, "NM"), 6).alias("nm"), F.round(units.convert_area(m, "ft"), 3).alias("sqft"),
        F.round(units.degrees_to_mils(F.col("size") * 7.3), 6).alias("mils"), units.format_range(m, "NM").alias("range_text"),
        units.format_bearing(b, "deg").alias("bearing_text"), units.format_bearing(b, "dms").alias("dms_text"),
        F.round(units.true_to_magnetic(b, F.col("size") % 30 - 15), 6).alias("magnetic"))


# --- classification and summaries --------------------------------------------------------------

@query("A1_extent", BOXED + "SELECT count(*) AS features, min(min_lat) AS min_lat, min(min_lon) AS min_lon, max(max_lat) AS max_lat, max(max_lon) AS max_lon FROM boxed")
def _(spark, sf):
    return ops.extent(boxed(spark, sf))


@query("A2_categories", FEAT + """, s AS (SELECT DISTINCT kind AS value FROM features), c AS (SELECT * FROM (VALUES ('PROMO', 'Promotion', 0), ('UNUSED', 'Never', 1), ('ECONOMY', '', 2)) t(value, label, pos)),
 u AS (SELECT value, label, 0 AS grp, pos FROM c UNION ALL SELECT value, '', 1, 0 FROM s WHERE value NOT IN (SELECT value FROM c)),
 r AS (SELECT value, label, CAST(row_number() OVER (ORDER BY grp, pos, value) - 1 AS INT) AS position FROM u) SELECT position, value, label, position % 10 AS palette FROM r""")
def _(spark, sf):
    return ops.categories(feats(spark, sf), "kind", [("PROMO", "Promotion"), ("UNUSED", "Never"), ("ECONOMY", "ECONOMY")])


@query("A3_equal_intervals", FEAT + """, a AS (SELECT min(price) AS lo, max(price) AS hi, least(7, count(DISTINCT price)) AS n FROM features)
 SELECT DISTINCT round(lo + (hi - lo)*i/CAST(n AS DOUBLE), 6) AS lower FROM a, range(0, 7) r(i) WHERE i < n""")
def _(spark, sf):
    return ops.equal_intervals(feats(spark, sf), "price", 7).select(F.round("lower", 6).alias("lower")).distinct()


@query("A4_quantiles", FEAT + """, o AS (SELECT CAST(depth AS DOUBLE) AS x, row_number() OVER (ORDER BY depth) - 1 AS rk, count(*) OVER () AS total FROM features WHERE depth IS NOT NULL),
 n AS (SELECT least(9, count(DISTINCT depth)) AS n FROM features) SELECT DISTINCT x AS lower FROM o, n WHERE rk IN (SELECT (i*total) // n FROM range(0, 9) r(i) WHERE i < n)""")
def _(spark, sf):
    return ops.quantiles(feats(spark, sf), "depth", 9)


@query("A4_quantiles_real", """WITH o AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS rk, count(*) OVER () AS total FROM lineitem)
 SELECT DISTINCT x AS lower FROM o WHERE rk IN (SELECT (i*total) // 25 FROM range(0, 25) r(i))""")
def _(spark, sf):
    return ops.quantiles(table(spark, sf, "lineitem"), "l_extendedprice", 25)


@query("A5_sample_values", FEAT + """SELECT CAST(depth AS VARCHAR) AS value FROM (SELECT DISTINCT depth FROM features WHERE depth IS NOT NULL ORDER BY depth LIMIT 12)""")
def _(spark, sf):
    return ops.sample_values(feats(spark, sf), "depth", 12)


PLAN = [{"name": "name", "source": "name", "from_type": "text", "type": "text"},
        {"name": "cost", "source": "price", "from_type": "real", "type": "integer", "required": True, "default": 0},
        {"name": "depth_m", "source": "depth_text", "from_type": "text", "type": "real"},
        {"name": "lighted", "source": "lit", "from_type": "boolean", "type": "integer"},
        {"name": "remarks", "type": "text", "default": "none"}]


@query("A6_change_impact", FEAT + """, u AS (SELECT 'depth' AS field, 'dropped' AS effect, count(depth) AS rows FROM features UNION ALL SELECT 'brand', 'dropped', count(brand) FROM features
 UNION ALL SELECT 'cost', 'lost', count(*) FILTER (WHERE price <> round(price)) FROM features
 UNION ALL SELECT 'depth_m', 'lost', count(*) FILTER (WHERE depth_text = '') FROM features) SELECT * FROM u WHERE rows > 0""")
def _(spark, sf):
    return ops.change_impact(feats(spark, sf), PLAN, ["depth", "brand"])


@query("M3_change_schema", FEAT + """SELECT id, name, CAST(round(price) AS BIGINT) AS cost, try_cast(nullif(depth_text, '') AS DOUBLE) AS depth_m, CAST(lit AS BIGINT) AS lighted, 'none' AS remarks FROM features""")
def _(spark, sf):
    return ops.change_schema(feats(spark, sf), PLAN)


@query("M4_convert_values", """SELECT o_orderkey AS id, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, 10) AS as_date, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00' AS as_datetime,
 CAST(CASE WHEN o_totalprice >= 0 THEN floor(o_totalprice + 0.5e0) ELSE ceil(o_totalprice - 0.5e0) END AS BIGINT) AS as_integer, o_totalprice <> floor(o_totalprice) AS lost FROM orders""")
def _(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    v, lost = ops.convert(F.col("o_totalprice"), "real", "integer")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), ops.convert(F.concat(day, F.lit("T12:00:00Z")), "datetime", "date")[0].alias("as_date"),
        ops.convert(day, "date", "datetime")[0].alias("as_datetime"), v.alias("as_integer"), lost.alias("lost"))


def _edits(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    op = F.when(k % 10 < 4, "update").when(k % 10 < 6, "delete").when(k % 10 < 7, "insert_id").otherwise("insert")
    return o.select(op.alias("op"), k.alias("edit_seq"), F.when(k % 10 < 6, (k * 7) % 2500).when(k % 10 < 7, k + 1900).alias("id"),
                    F.concat(F.lit("E"), k.cast("string")).alias("name"), (k % 100).cast("int").alias("size"))


EDITS = FEAT + """, ed AS (SELECT CASE WHEN o_orderkey % 10 < 4 THEN 'update' WHEN o_orderkey % 10 < 6 THEN 'delete' WHEN o_orderkey % 10 < 7 THEN 'insert_id' ELSE 'insert' END AS op,
 o_orderkey AS edit_seq, CASE WHEN o_orderkey % 10 < 6 THEN (o_orderkey*7) % 2500 WHEN o_orderkey % 10 < 7 THEN o_orderkey + 1900 END AS id, 'E' || CAST(o_orderkey AS VARCHAR) AS name,
 CAST(o_orderkey % 100 AS INT) AS size FROM orders), good AS (SELECT * FROM ed WHERE (op IN ('update', 'delete') AND id IN (SELECT id FROM features)) OR (op = 'insert_id' AND id NOT IN (SELECT id FROM features))),
 lst AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY id ORDER BY edit_seq DESC) = 1) """


@query("M1_J27_apply_edits", EDITS + """, top AS (SELECT greatest((SELECT max(id) FROM features), coalesce((SELECT max(id) FROM ed WHERE op = 'insert_id'), 0)) AS m)
 SELECT id, name, size FROM features WHERE id NOT IN (SELECT id FROM lst) UNION ALL SELECT id, name, size FROM lst WHERE op <> 'delete'
 UNION ALL SELECT m + row_number() OVER (ORDER BY edit_seq), name, size FROM ed, top WHERE op = 'insert'""")
def _(spark, sf):
    return ops.apply_edits(feats(spark, sf).select("id", "name", "size"), _edits(spark, sf), ["name", "size"])[0]


@query("M1_edit_errors", EDITS + """SELECT edit_seq, id, CASE WHEN op = 'insert_id' THEN 'duplicate id' ELSE 'not found' END AS error FROM ed WHERE op <> 'insert'
 AND edit_seq NOT IN (SELECT edit_seq FROM good)""")
def _(spark, sf):
    return ops.apply_edits(feats(spark, sf).select("id", "name", "size"), _edits(spark, sf), ["name", "size"])[1]


@query("M2_conform", "SELECT p_partkey AS id, p_name AS name, CAST(NULL AS VARCHAR) AS remarks, CAST(p_size AS DOUBLE) AS size FROM part")
def _(spark, sf):
    want = T.StructType().add("id", "long").add("name", "string").add("remarks", "string").add("size", "double")
    return ops.conform(table(spark, sf, "part").selectExpr("p_size AS size", "p_partkey AS id", "p_name AS name"), want)


@query("M5_rename_style_fields", """SELECT p_partkey AS rule, CASE WHEN p_partkey % 3 = 0 THEN 'depth_m' WHEN p_partkey % 3 = 1 THEN 'size' ELSE 'gone' END AS field, p_partkey % 3 = 2 AS broken FROM part""")
def _(spark, sf):
    k = F.col("p_partkey")
    rules = table(spark, sf, "part").select(k.alias("rule"), F.when(k % 3 == 0, "Depth").when(k % 3 == 1, "size").otherwise("gone").alias("field"))
    mapping = spark.createDataFrame([("depth", "depth_m")], "old string, new string")
    return ops.rename_style_fields(rules, mapping, spark.createDataFrame([("depth_m",), ("Size",)], "name string"))


@query("O1_attribute_sort", FEAT + "SELECT id, name FROM features ORDER BY lower(name), id")
def _(spark, sf):
    return ops.sort_rows(feats(spark, sf), "name").select("id", "name")


SEL = FEAT + ", cur AS (SELECT id FROM features WHERE size < 20), fnd AS (SELECT id FROM features WHERE kind = 'ECONOMY') "
SEL_SQL = {"new": "SELECT id FROM fnd", "add": "SELECT id FROM cur UNION SELECT id FROM fnd", "remove": "SELECT id FROM cur EXCEPT SELECT id FROM fnd",
           "within": "SELECT id FROM cur INTERSECT SELECT id FROM fnd"}
for _mode, _sql in SEL_SQL.items():
    @query(f"U1_selection_{_mode}", SEL + _sql)
    def _(spark, sf, mode=_mode):
        f = feats(spark, sf)
        return ops.select_combine(f.filter("size < 20"), f.filter("kind = 'ECONOMY'"), mode)


@query("S19_export_selection", FEAT + "SELECT id, name, price FROM features WHERE id IN (SELECT id FROM features WHERE lit) AND size > 10")
def _(spark, sf):
    f = feats(spark, sf)
    return f.filter("size > 10").join(f.filter("lit").select("id"), "id", "left_semi").select("id", "name", "price")
