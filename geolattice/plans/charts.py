"""Rule, chart-record and product-catalog queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chart_updates as cu, charts as ch
from ..operators.ordered import Ordered
from .derived import derived, table, with_ctes
from .registry import query



def chart_features(spark, sf):
    k = F.col("p_partkey")
    a = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("kind").alias("key"), F.col("p_type").alias("value")), F.struct(F.lit("depth").alias("key"), F.col("p_size").cast("string").alias("value")),
                                                   F.when(k % 3 == 0, F.struct(F.lit("light").alias("key"), F.lit("yes").alias("value"))))))
    return table(spark, sf, "part").select(k.alias("id"), F.when(k % 2 == 0, "marks").otherwise("areas").alias("layer"), F.col("p_brand").alias("style_key"), F.explode(F.array(a)).alias("attributes"),
                                           F.when(k % 5 != 0, (k % 40) * 5000).alias("scamin"))


@query("P11_scale_minimum", "SELECT p_partkey AS id FROM part WHERE p_partkey % 5 = 0 OR (p_partkey % 40)*5000 >= 60000")
def _(spark, sf):
    return ch.scale_minimum(chart_features(spark, sf), 60000).select("id")


@query("P12_rule_predicates", """SELECT p_partkey AS id, p_size < 9 AS shallow, p_partkey % 3 = 0 AND 'yes' <> 'no' AS not_no, p_size NOT IN (1, 2, 3) AND p_partkey % 3 <> 0 AS dark, p_type IN ('ECONOMY', 'PROMO') OR p_size >= 45 AS either FROM part""")
def _(spark, sf):
    a = F.col("attributes")
    return chart_features(spark, sf).select("id", ch.rule_predicate(a, ("<", "depth", 9)).alias("shallow"), ch.rule_predicate(a, ("!=", "light", "no")).alias("not_no"),
                                            ch.rule_predicate(a, ("and", ("not in", "depth", [1, 2, 3]), ("missing", "light"))).alias("dark"),
                                            ch.rule_predicate(a, ("or", ("in", "kind", ["ECONOMY", "PROMO"]), (">=", "depth", "45"))).alias("either"))


RULES = [{"action": "hide", "layer": "areas", "when": ("<", "depth", 20)}, {"action": "show", "when": ("exists", "light"), "priority": 7}, {"action": "hide", "when": ("=", "depth", 50), "min_denom": 500000},
         {"action": "set", "layer": "marks", "labels": False, "symbol_scale": 2.0, "group": 9}, {"action": "set", "style_key": "Brand#2", "priority": 3}]


@query("P13_P15_rule_set", """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN true ELSE NOT (p_partkey % 2 = 1 AND p_size < 20) END AS shown, CASE WHEN p_brand = 'Brand#2' THEN 3 WHEN p_partkey % 3 = 0 THEN 7 END AS priority FROM part""")
def _(spark, sf):
    r = ch.gate_rules(RULES, 100000.0, hidden_groups=(9,))
    return ch.apply_rules(chart_features(spark, sf), r).select("id", "shown", "priority")


@query("P16_families", "SELECT p_partkey AS id, NOT (p_partkey % 2 = 1) AS shown FROM part")
def _(spark, sf):
    r = ch.families([], [{"on": False, "select": [{"layer": "areas"}]}, {"on": True, "select": [{"layer": "marks"}]}])
    return ch.apply_rules(chart_features(spark, sf), r).select("id", "shown")


@query("J11_J12_decode_values", """SELECT p_partkey AS id, CASE WHEN p_size % 7 < 5 THEN 'code ' || CAST(p_size % 7 AS VARCHAR) ELSE CAST(p_size % 7 AS VARCHAR) END || ', ' || CASE WHEN p_size % 4 < 5 THEN 'code ' || CAST(p_size % 4 AS VARCHAR) END AS text FROM part""")
def _(spark, sf):
    p = table(spark, sf, "part")
    v = p.select(F.col("p_partkey").alias("id"), F.lit("Lights").alias("table"), F.lit("COLOUR").alias("attribute"), F.concat_ws(",", (F.col("p_size") % 7).cast("string"), (F.col("p_size") % 4).cast("string")).alias("value"))
    codes = spark.createDataFrame([("LIGHTS", "colour", str(i), f"code {i}") for i in range(5)], "table string, attribute string, code string, text string")
    return ch.decode_values(v, codes).select("id", "text")


@query("J23_assign_symbols", """WITH f AS (SELECT p_partkey AS id, p_partkey % 6 AS code, p_partkey % 2 AS delin, p_type AS kind FROM part), r AS (SELECT * FROM (VALUES (0, 0, 11, 1, NULL), (0, 0, 12, 2, 'PROMO'), (1, 1, 13, 1, 'ECONOMY'), (2, 0, 14, 5, 'STANDARD')) t(code, delin, symbol, priority, kind)),
 h AS (SELECT id, symbol, priority FROM f JOIN r USING (code, delin) WHERE r.kind IS NULL OR r.kind = f.kind) SELECT CAST(id AS BIGINT) AS id, symbol, priority FROM h UNION ALL SELECT id, CASE WHEN (code, delin) IN (SELECT (code, delin) FROM r) THEN 2 ELSE 1 END, 0 FROM f WHERE id NOT IN (SELECT id FROM h)""")
def _(spark, sf):
    k = F.col("id")
    f = chart_features(spark, sf).select("id", (k % 6).cast("int").alias("code"), (k % 2).cast("int").alias("delin"), "attributes")
    rows = spark.createDataFrame([(0, 0, 11, 1, None, None), (0, 0, 12, 2, "kind", "PROMO"), (1, 1, 13, 1, "kind", "ECONOMY"), (2, 0, 14, 5, "kind", "STANDARD")], "code int, delin int, symbol int, priority int, attr string, value string")
    return ch.assign_symbols(f, rows, 1, 2)


@query("J13_feature_lines", """WITH p AS (SELECT o_custkey AS owner, o_orderkey AS seq, o_orderkey % 200 AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 200 + 1 ELSE (o_orderkey*7) % 200 END AS z FROM orders), l AS (SELECT *, lag(z) OVER (PARTITION BY owner ORDER BY seq) AS pz FROM p)
 SELECT owner, CAST(sum(CASE WHEN pz IS NULL OR pz <> a THEN 1 ELSE 0 END) AS BIGINT) AS parts, CAST(sum(CASE WHEN pz = a THEN 1 ELSE 2 END) AS BIGINT) AS points FROM l GROUP BY owner""")
def _(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    z = F.when(k % 3 == 0, k % 200 + 1).otherwise((k * 7) % 200)
    flip = k % 2 == 0
    v = o.select(k.alias("target"), F.when(flip, F.array(z, k % 200)).otherwise(F.array(k % 200, z)).alias("coords"))
    return ch.feature_lines(o.select(F.col("o_custkey").alias("owner"), k.alias("seq"), k.alias("target"), flip.alias("reverse")), v).select("owner", "parts", "points")


@query("J13_feature_vertices", """WITH p AS (SELECT o_custkey AS owner, o_orderkey AS seq, o_orderkey % 200 AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 200 + 1 ELSE (o_orderkey*7) % 200 END AS z FROM orders), l AS (SELECT *, lag(z) OVER (PARTITION BY owner ORDER BY seq) AS pz FROM p),
 g AS (SELECT *, sum(CASE WHEN pz IS NULL OR pz <> a THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY seq) AS part FROM l), v AS (SELECT owner, part, seq, 0 AS i, a AS vertex FROM g WHERE pz IS NULL OR pz <> a UNION ALL SELECT owner, part, seq, 1, z FROM g)
 SELECT owner, CAST(part AS BIGINT) AS part, row_number() OVER (PARTITION BY owner, part ORDER BY seq, i) - 1 AS n, vertex FROM v""")
def _(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    z = F.when(k % 3 == 0, k % 200 + 1).otherwise((k * 7) % 200)
    flip = k % 2 == 0
    v = o.select(k.alias("target"), F.when(flip, F.array(z, k % 200)).otherwise(F.array(k % 200, z)).alias("coords"))
    d = ch.feature_vertices(o.select(F.col("o_custkey").alias("owner"), k.alias("seq"), k.alias("target"), flip.alias("reverse")), v)
    return d.select("owner", "part", F.col("n").cast("long").alias("n"), "vertex")


CAT = with_ctes("catalog", "installed")


@query("J16_compare_catalog", CAT + """SELECT i.cell, CASE WHEN c.cell IS NULL THEN 'unlisted' WHEN c.cancelled THEN 'cancelled' WHEN i.cancelled OR c.edition > i.edition THEN 'new edition' WHEN c.edition = i.edition AND c.upd > i.upd THEN 'new update' ELSE 'current' END AS status FROM installed i LEFT JOIN catalog c USING (cell) WHERE NOT (i.cancelled AND coalesce(c.cancelled, false))""")
def _(spark, sf):
    return ch.compare_catalog(derived(spark, sf, "installed"), derived(spark, sf, "catalog"))


@query("U6_catalog_minus_installed", CAT + "SELECT cell FROM catalog WHERE cell NOT IN (SELECT cell FROM installed)")
def _(spark, sf):
    return derived(spark, sf, "catalog").join(derived(spark, sf, "installed"), "cell", "left_anti").select("cell")


@query("A10_infer_region", CAT + """, i AS (SELECT cell FROM installed WHERE NOT cancelled), a AS (SELECT DISTINCT cell, ord, unnest([region, 'all of ' || left(region, 7)]) AS region FROM catalog WHERE NOT cancelled),
 b AS (SELECT region, count(*) AS n, min(ord) AS o, count(*) FILTER (WHERE cell IN (SELECT cell FROM i)) AS k FROM a GROUP BY region), j AS (SELECT region, o, k/(n + (SELECT count(*) FROM i) - k) AS jac FROM b WHERE k > 0)
 SELECT region, round(jac, 9) AS jaccard, region = (SELECT arg_max(region, jac*1e9 - o) FROM j) AS best FROM j""")
def _(spark, sf):
    c = derived(spark, sf, "catalog").withColumn("region", F.array("region", F.concat(F.lit("all of "), F.substring("region", 1, 7))))
    return ch.infer_region(derived(spark, sf, "installed"), c).select("region", F.round("jaccard", 9).alias("jaccard"), "best")


UPD = """WITH u AS (SELECT o_custkey AS cell, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS number, CASE WHEN o_orderkey % 31 = 0 THEN 2 ELSE 1 END AS edition, o_orderkey % 41 = 0 AS cancels FROM orders),
 d AS (SELECT DISTINCT ON (cell, number) * FROM u ORDER BY cell, number, edition, cancels), n AS (SELECT *, row_number() OVER w AS n, bool_or(edition <> 1) OVER w AS bad FROM d WINDOW w AS (PARTITION BY cell ORDER BY number)),
 g AS (SELECT cell, count(*) AS found, count(*) FILTER (WHERE number = n AND NOT bad) AS applied, coalesce(bool_or(cancels) FILTER (WHERE number = n AND NOT bad), false) AS cancelled, arg_min(CASE WHEN edition <> 1 THEN 'wrong edition' ELSE 'gap' END, number) FILTER (WHERE NOT (number = n AND NOT bad)) AS error FROM n GROUP BY cell) """


def updates(spark, sf):
    from ..operators.ordered import Ordered
    k = F.col("o_orderkey")
    o = Ordered(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], F.floor(k / 5000)).running(sums={"n": F.lit(1).cast("long")}).result()
    u = o.select(F.col("o_custkey").alias("cell"), (F.col("n") + F.when(k % 29 == 0, 1).otherwise(0)).alias("number"), F.when(k % 31 == 0, 2).otherwise(1).alias("edition"), (k % 41 == 0).alias("cancels"))
    return u.groupBy("cell", "number").agg(F.min(F.struct("edition", "cancels")).alias("m")).select("cell", "number", "m.*")


@query("W17_M8_update_state", UPD + "SELECT cell, found, applied, cancelled, error FROM g")
def _(spark, sf):
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"), F.lit(1).alias("base_edition"))
    return ch.update_state(updates(spark, sf), cells)


@query("M9_chart_index", UPD + "SELECT 'US' || CAST(1 + c_custkey % 6 AS VARCHAR) || CAST(c_custkey AS VARCHAR) AS cell, CAST(1 + c_custkey % 6 AS INT) AS band, 1 AS edition, coalesce(found, 0) AS found, coalesce(applied, 0) AS applied, coalesce(cancelled, false) AS cancelled FROM customer LEFT JOIN g ON g.cell = c_custkey")
def _(spark, sf):
    name = F.concat(F.lit("US"), (1 + F.col("c_custkey") % 6).cast("string"), F.col("c_custkey").cast("string"))
    cells = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"), F.lit(1).alias("base_edition"), name.alias("nm"))
    st = ch.update_state(updates(spark, sf), cells.drop("nm")).join(cells.select("cell", "nm"), "cell").drop("cell").withColumnRenamed("nm", "cell")
    return ch.chart_index(cells.select(F.col("nm").alias("cell"), "base_edition"), st)


_EDIT = {"op": "CASE pk % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'modify' END", "at": "pk % 6", "count": "CASE pk % 3 WHEN 1 THEN 1 ELSE 1 + pk % 2 END"}


def chart_cells(spark, sf):
    """(base, edits): records of ten customers a cell, their orders as points; every order updates its record once, with its line items as edits."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 10).cast("long").alias("cell"), (F.col("o_custkey") % 10).cast("long").alias("rec"), k.cast("long").alias("seq"), (1 + k % 5).cast("long").alias("file_no"),
                                          F.col("o_totalprice").cast("double").alias("value"))
    chunk = F.floor(F.col("seq") / 5000)
    pts = Ordered(o, ["cell", "rec"], ["seq"], chunk).running(sums={"n": F.lit(1)}).result().select("cell", "rec", F.lit("points").alias("list"), (F.col("n") - 1).cast("long").alias("idx"), "value")
    rec = o.select("cell", "rec").distinct()
    base = {"records": rec.select("cell", "rec", F.lit(1).alias("version"), F.concat(F.lit("K"), (F.col("rec") % 3).cast("string")).alias("klass")), "lists": pts,
            "attributes": rec.withColumn("code", F.explode(F.array(*[F.lit(c) for c in range(3)]))).select("cell", "rec", "code", F.lit(0).alias("national"), F.concat(F.lit("b"), F.col("code").cast("string")).alias("value"))}
    v = Ordered(o, ["cell", "rec"], ["file_no", "seq"], F.col("file_no")).running(sums={"n": F.lit(1)}).result()
    records = v.select("cell", "file_no", "seq", "rec", F.lit("modify").alias("op"), (1 + F.col("n") + F.when(F.col("seq") % 199 == 0, 1).otherwise(0)).cast("int").alias("version"), F.lit(None).cast("string").alias("klass"))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("seq"), F.col("l_linenumber").cast("long").alias("n")).agg(F.min("l_partkey").alias("pk"), F.min("l_extendedprice").cast("double").alias("price"))
    li = li.join(o.select("cell", "rec", "seq", "file_no"), "seq")
    at = ["cell", "file_no", "seq", "n"]
    att = li.filter("n = 1").select(*at, "rec", (F.col("pk") % 4).cast("int").alias("code"), F.lit(0).alias("national"), F.when(F.col("pk") % 97 != 0, F.concat(F.lit("v"), F.col("pk").cast("string"))).alias("value"))
    ops = li.filter("n > 1").selectExpr(*at, "rec", "'points' AS list", f"{_EDIT['op']} AS op", f"cast({_EDIT['at']} as bigint) AS at", f"cast({_EDIT['count']} as bigint) AS count", "price")
    values = ops.filter("op <> 'delete'").withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).select(*at, "j", (F.col("price") + F.col("j")).alias("value"))
    return base, {"records": records, "attributes": att, "lists": ops.drop("price"), "values": values}


CELLS = f"""WITH RECURSIVE o AS (SELECT o_custkey // 10 AS cell, o_custkey % 10 AS rec, o_orderkey AS seq, 1 + o_orderkey % 5 AS file_no, o_totalprice::DOUBLE AS value FROM orders),
 li AS (SELECT l_orderkey AS seq, l_linenumber AS n, min(l_partkey) AS pk, min(l_extendedprice)::DOUBLE AS price FROM lineitem GROUP BY 1, 2), e AS (SELECT li.*, cell, rec, file_no FROM li JOIN o USING (seq)),
 bad1 AS (SELECT cell, file_no, seq, -1 AS ix, rec, 'version mismatch' AS error FROM (SELECT *, ver <> coalesce(lag(ver) OVER w, 1) + 1 AS bad FROM (SELECT *, 1 + row_number() OVER w + CASE WHEN seq % 199 = 0 THEN 1 ELSE 0 END AS ver FROM o WINDOW w AS (PARTITION BY cell, rec ORDER BY file_no, seq)) WINDOW w AS (PARTITION BY cell, rec ORDER BY file_no, seq)) WHERE bad),
 att AS (SELECT cell, file_no, seq, n, rec, pk % 4 AS code, CASE WHEN pk % 97 <> 0 THEN 'v' || pk END AS value FROM e WHERE n = 1),
 bad2 AS (SELECT cell, file_no, seq, n AS ix, rec, 'deletes an absent attribute' AS error FROM (SELECT *, CASE WHEN row_number() OVER w = 1 THEN code < 3 ELSE lag(value) OVER w IS NOT NULL END AS has FROM att WINDOW w AS (PARTITION BY cell, rec, code ORDER BY file_no, seq, n)) WHERE value IS NULL AND NOT has),
 op AS MATERIALIZED (SELECT cell, file_no, seq, n, rec, {_EDIT['op']} AS op, {_EDIT['at']} AS ix, {_EDIT['count']} AS cnt, price FROM e WHERE n > 1), sz AS (SELECT cell, rec, count(*) AS base FROM o GROUP BY 1, 2),
 bad3 AS (SELECT cell, file_no, seq, n AS ix, rec, 'bad ' || op AS error FROM (SELECT op.*, base + coalesce(sum(CASE op WHEN 'insert' THEN cnt WHEN 'delete' THEN -cnt ELSE 0 END) OVER (PARTITION BY cell, rec ORDER BY file_no, seq, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size FROM op JOIN sz USING (cell, rec))
   WHERE ix + CASE op WHEN 'insert' THEN 0 ELSE cnt END > size),
 fe AS (SELECT cell, min(struct_pack(f := file_no, s := seq, a := ix, r := rec, e := error)) AS x FROM (SELECT * FROM bad1 UNION ALL SELECT * FROM bad2 UNION ALL SELECT * FROM bad3) GROUP BY cell), lim AS (SELECT DISTINCT o.cell, coalesce(x.f, 99) AS stop FROM o LEFT JOIN fe USING (cell)),
 la AS (SELECT cell, rec, code, arg_max(struct_pack(v := value), struct_pack(f := file_no, s := seq, n := n)) AS w FROM att JOIN lim USING (cell) WHERE file_no < stop GROUP BY ALL),
 hv AS (SELECT *, row_number() OVER (PARTITION BY cell, rec ORDER BY file_no, seq, n, ins) AS k FROM (SELECT op.*, h AS ins FROM op JOIN lim USING (cell), (VALUES (false), (true)) t(h) WHERE file_no < stop AND (op = 'modify' OR (op = 'insert') = h))),
 rw AS (SELECT cell, rec, 0 AS k, row_number() OVER (PARTITION BY cell, rec ORDER BY seq) - 1 AS pos, value FROM o UNION ALL SELECT cell, rec, k, ix + j, price + j FROM hv, range(0, 2) t(j) WHERE ins AND j < cnt),
 mv(cell, rec, k, pos, value) AS (SELECT cell, rec, k::BIGINT, pos::BIGINT, value FROM rw UNION ALL SELECT * FROM (SELECT mv.cell, mv.rec, h.k::BIGINT, (CASE WHEN h.ins THEN CASE WHEN pos >= ix THEN pos + cnt ELSE pos END WHEN pos >= ix + cnt THEN pos - cnt WHEN pos < ix THEN pos END)::BIGINT AS p, mv.value
   FROM mv JOIN hv h ON h.cell = mv.cell AND h.rec = mv.rec AND h.k = mv.k + 1) WHERE p IS NOT NULL),
 top AS (SELECT cell, rec, max(k) AS k FROM hv GROUP BY 1, 2) """


def updated_cells(spark, sf):
    return cu.apply_chart_updates(*chart_cells(spark, sf))


@query("M7_apply_updates", CELLS + "SELECT mv.cell, mv.rec, pos AS idx, value FROM mv LEFT JOIN top USING (cell, rec) WHERE mv.k = coalesce(top.k, 0)")
def _(spark, sf):
    return updated_cells(spark, sf)["lists"].select("cell", "rec", "idx", "value")


@query("M7_update_results", CELLS + """, vr AS (SELECT cell, rec, 1 + count(*) FILTER (file_no < stop) AS version, max(file_no) FILTER (file_no < stop) AS last FROM o JOIN lim USING (cell) GROUP BY cell, rec)
 SELECT 'record' AS kind, cell, rec, NULL::BIGINT AS code, 'K' || rec % 3 AS text, version FROM vr
 UNION ALL SELECT 'attribute', cell, rec, code, CASE WHEN w IS NULL THEN 'b' || code ELSE w.v END, NULL FROM (SELECT * FROM (SELECT DISTINCT cell, rec FROM o), range(0, 4) t(code)) LEFT JOIN la USING (cell, rec, code) WHERE CASE WHEN w IS NULL THEN code < 3 ELSE w.v IS NOT NULL END
 UNION ALL SELECT 'cell', cell, x.r, x.f, x.e, (SELECT max(last) FROM vr WHERE vr.cell = lim.cell) FROM lim LEFT JOIN fe USING (cell)""")
def _(spark, sf):
    d = updated_cells(spark, sf)
    none = F.lit(None).cast("long")
    r = d["records"].select(F.lit("record").alias("kind"), "cell", "rec", none.alias("code"), F.col("klass").alias("text"), F.col("version").cast("long").alias("version"))
    a = d["attributes"].select(F.lit("attribute"), "cell", "rec", F.col("code").cast("long"), "value", none)
    c = d["cells"].select(F.lit("cell"), "cell", F.col("rec").cast("long"), F.col("failed_file").cast("long"), "error", F.col("last_file").cast("long"))
    return r.union(a).union(c)


@query("J29_dataset_diff", """SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'added' WHEN p_partkey % 11 = 0 THEN 'removed' WHEN p_partkey % 7 = 0 THEN 'attributes' ELSE 'geometry' END AS change FROM part WHERE NOT (p_partkey % 10 = 0 AND p_partkey % 11 = 0) AND (p_partkey % 10 = 0 OR p_partkey % 11 = 0 OR p_partkey % 7 = 0 OR p_partkey % 13 = 0)""")
def _(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    a = p.filter(k % 10 != 0).select(k.alias("id"), F.col("p_name").alias("attrs"), F.array(F.col("p_size"), F.lit(1)).alias("vertices"))
    b = p.filter(k % 11 != 0).select(k.alias("id"), F.when(k % 7 == 0, "changed").otherwise(F.col("p_name")).alias("attrs"), F.when(k % 13 == 0, F.array(F.col("p_size"), F.lit(99))).otherwise(F.array(F.lit(1), F.col("p_size"))).alias("vertices"))
    return ch.dataset_diff(a, b)


@query("F32_cell_names", with_ctes("catalog") + "SELECT cell, 'US' AS producer, CAST(substr(cell, 3, 1) AS INT) AS band FROM catalog")
def _(spark, sf):
    return derived(spark, sf, "catalog").withColumn("p", ch.cell_name_parts(F.col("cell"))).select("cell", "p.producer", "p.band")


@query("A22_record_counts", "WITH n AS (SELECT o_custkey AS cell, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS f, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS v FROM orders GROUP BY 1) SELECT c_custkey AS cell, 10 - coalesce(f, 0) AS missing_feature, 5 - coalesce(v, 0) AS missing_vector FROM customer LEFT JOIN n ON cell = c_custkey")
def _(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"), F.lit(10).alias("n_feature"), F.lit(5).alias("n_vector"))
    r = table(spark, sf, "orders").select(F.col("o_custkey").alias("cell"), F.when(F.col("o_orderkey") % 2 == 0, "feature").otherwise("vector").alias("kind"))
    return ch.record_counts(d, r)


@query("O7_A26_legend", "SELECT p_brand AS title, max(p_partkey) AS pos FROM part GROUP BY p_brand ORDER BY pos DESC")
def _(spark, sf):
    return ch.legend(table(spark, sf, "part").select(F.col("p_brand").alias("title"), F.col("p_partkey").alias("pos")))
