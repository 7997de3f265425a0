"""Chart records, rule sets and product catalogs."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.values import is_true, number
from .ordered import Ordered


# --- rule predicates and rule sets ---------------------------------------------------------------

def attribute(attrs: Column, key: str) -> Column:
    return F.try_element_at(attrs, F.lit(key))


def rule_predicate(attrs: Column, p: tuple) -> Column:
    """Predicates over a text attribute map: (always,) (never,) (exists, k) (missing, k) (op, k, v) (in|not in, k, [v]) (and|or, p...) (not, p).

    Both sides compare as numbers when both are numbers, else as text; an absent attribute makes every
    comparison false, also != and not in.
    """
    op = p[0]
    if op == "always":
        return F.lit(True)
    if op == "never":
        return F.lit(False)
    if op in ("and", "or"):
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), [rule_predicate(attrs, q) for q in p[1:]])
    if op == "not":
        return ~rule_predicate(attrs, p[1])
    a = attribute(attrs, p[1])
    if op == "exists":
        return a.isNotNull()
    if op == "missing":
        return a.isNull()

    def cmp(v, o):
        x, y = number(a), number(F.lit(str(v)))
        ops = {"=": lambda l, r: l == r, "!=": lambda l, r: l != r, "<": lambda l, r: l < r, "<=": lambda l, r: l <= r, ">": lambda l, r: l > r, ">=": lambda l, r: l >= r}
        return is_true(F.when(x.isNotNull() & y.isNotNull(), ops[o](x, y)).otherwise(ops[o](a, F.lit(str(v)))))
    if op == "in":
        return reduce(lambda l, r: l | r, [cmp(v, "=") for v in p[2]])
    if op == "not in":
        return a.isNotNull() & ~reduce(lambda l, r: l | r, [cmp(v, "=") for v in p[2]])
    return cmp(p[2], op)


def gate_rules(rules: list[dict], denom: float, hidden_groups=(), categories=None) -> list[dict]:
    """Rules alive at a display scale, outside hidden viewing groups and inside the shown categories."""
    return [r for r in rules if (r.get("min_denom") or 0) <= denom <= (r.get("max_denom") or float("inf"))
            and r.get("group") not in hidden_groups and (categories is None or r.get("category") is None or r["category"] in categories)]


def families(rules: list[dict], fams: list[dict]) -> list[dict]:
    """Hide rules for each selector of a family that is off, in front of the user's rules."""
    return [{"action": "hide", "layer": s["layer"], "style_key": s.get("style_key")} for f in fams if not f["on"] for s in f["select"]] + rules


def apply_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rules in order, later wins: shown, priority, labels, symbol_scale. Columns: layer, style_key, attributes.

    The rule list is a style sheet; it folds into one nested conditional per output, no join.
    """
    shown, effects = F.lit(True), {"priority": F.lit(None).cast("int"), "labels": F.lit(None).cast("boolean"), "symbol_scale": F.lit(None).cast("double")}
    for r in rules:
        c = F.lit(True)
        if r.get("layer"):
            c = c & (F.col("layer") == r["layer"])
        if r.get("style_key"):
            c = c & (F.col("style_key") == r["style_key"])
        c = is_true(c & rule_predicate(F.col("attributes"), r.get("when", ("always",))))
        if r["action"] in ("show", "hide"):
            shown = F.when(c, r["action"] == "show").otherwise(shown)
        for k in effects:
            if r.get(k) is not None:
                effects[k] = F.when(c, F.lit(r[k])).otherwise(effects[k])
    return df.select("*", shown.alias("shown"), *[c.alias(k) for k, c in effects.items()])


def scale_minimum(df: DataFrame, denom: float) -> DataFrame:
    """Features whose minimum scale allows the display scale."""
    return df.filter(F.col("scamin").isNull() | (F.col("scamin") >= denom))


def assign_symbols(features: DataFrame, rows: DataFrame, first_fallback: int, second_fallback: int) -> DataFrame:
    """Symbols on (code, delineation) whose condition holds; an unknown code or no true row takes a fallback.

    ``rows``: code, delin, symbol, priority, attr, value (null attr = always). All true rows contribute.
    """
    j = features.join(rows, ["code", "delin"], "left")
    hit = F.col("symbol").isNotNull() & (F.col("attr").isNull() | is_true(F.element_at("attributes", F.col("attr")) == F.col("value")))
    per = j.groupBy("id").agg(F.max(F.col("symbol").isNotNull()).alias("known"), F.max(hit).alias("any"))
    got = j.filter(hit).select("id", "symbol", "priority")
    rest = per.filter(~F.col("any")).select("id", F.when(F.col("known"), second_fallback).otherwise(first_fallback).cast("int").alias("symbol"), F.lit(0).alias("priority"))
    return got.unionByName(rest)


# --- attributes -------------------------------------------------------------------------------------

def decode_values(values: DataFrame, codes: DataFrame) -> DataFrame:
    """Coded attribute values to text: (id, table, attribute, value); comma lists decode item by item, in order; unknown stays raw."""
    items = values.select("id", "table", "attribute", F.posexplode(F.split("value", ",")).alias("pos", "code"))
    c = codes.select(F.lower("table").alias("_t"), F.lower("attribute").alias("_a"), F.col("code"), "text")
    j = items.withColumn("_t", F.lower("table")).withColumn("_a", F.lower("attribute")).join(c, ["_t", "_a", "code"], "left")
    # one value lists at most a few codes
    return j.groupBy("id", "table", "attribute").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", "code").alias("v")))), lambda x: x.v), ", ").alias("text"))


# --- updates, index, catalog --------------------------------------------------------------------------

def update_state(updates: DataFrame, cells: DataFrame) -> DataFrame:
    """Per cell: how many updates apply in unbroken order, and why the next one does not.

    An update applies when its edition is the cell's and its number is one more than the last applied.
    """
    j = updates.join(cells, "cell").withColumn("_ok", F.col("edition") == F.col("base_edition"))
    o = Ordered(j, ["cell"], ["number"], F.floor(F.col("number") / 1000)).running(sums={"_n": F.lit(1).cast("long")}, maxima={"_bad": F.when(~F.col("_ok"), 1).otherwise(0)}).result()
    fine = (F.col("number") == F.col("_n")) & (F.col("_bad") == 0)
    g = o.groupBy("cell").agg(F.count("*").alias("found"), F.count_if(fine).alias("applied"), F.max(F.when(fine, F.col("cancels"))).alias("cancelled"),
                              F.min(F.when(~fine, F.struct("number", F.when(~F.col("_ok"), "wrong edition").otherwise("gap").alias("why")))).alias("b"))
    return g.select("cell", "found", "applied", F.coalesce("cancelled", F.lit(False)).alias("cancelled"), F.col("b.why").alias("error"))


def chart_index(cells: DataFrame, state: DataFrame) -> DataFrame:
    """One row per cell: band, edition, updates found and applied, cancelled, bounds."""
    band = F.substring("cell", 3, 1).try_cast("int")
    return cells.join(state, "cell", "left").select("cell", band.alias("band"), F.col("base_edition").alias("edition"), F.coalesce("found", F.lit(0)).cast("long").alias("found"),
                                                    F.coalesce("applied", F.lit(0)).cast("long").alias("applied"), F.coalesce("cancelled", F.lit(False)).alias("cancelled"))


def feature_lines(pointers: DataFrame, vectors: DataFrame) -> DataFrame:
    """Line geometry from ordered edge pointers: (owner, parts, points). ``pointers``: owner, seq, target, reverse; ``vectors``: target, coords.

    An edge joins the run only when its first vertex is the run's last, else a new part starts.
    """
    j = pointers.join(vectors, "target", "left").withColumn("coords", F.when(F.col("reverse"), F.reverse("coords")).otherwise(F.col("coords")))
    j = j.withColumn("_a", F.col("coords")[0]).withColumn("_z", F.element_at("coords", -1))
    o = Ordered(j, ["owner"], ["seq"], F.floor(F.col("seq") / 1000)).previous(z=F.col("_z"))
    o = o.islands(F.col("is_first") | ~F.col("_a").eqNullSafe(F.col("prev_z")), "part").result()
    n = F.size("coords") - F.when(o.part.isNotNull() & ~F.col("is_first") & F.col("_a").eqNullSafe(F.col("prev_z")), 1).otherwise(0)
    return o.groupBy("owner").agg(F.max("part").alias("parts"), F.sum(F.when(F.col("coords").isNotNull(), n).otherwise(0)).alias("points"), F.min(F.col("coords").isNotNull()).alias("complete"))


def feature_vertices(pointers: DataFrame, vectors: DataFrame) -> DataFrame:
    """Line geometry from ordered edge pointers as rows: (owner, part, n, vertex), n from 0 along each part.

    As ``feature_lines``: an edge joins the run before it where its first vertex is the run's last, which then comes once; edges without a vector leave a gap.
    """
    j = pointers.join(vectors, "target").withColumn("coords", F.when(F.col("reverse"), F.reverse("coords")).otherwise(F.col("coords")))
    j = j.withColumn("_a", F.col("coords")[0]).withColumn("_z", F.element_at("coords", -1))
    chunk = F.floor(F.col("seq") / 1000)
    whole = pointers.select("owner", "seq").join(j.select("owner", "seq", "_a", "_z", "coords"), ["owner", "seq"], "left")
    o = Ordered(whole, ["owner"], ["seq"], chunk).previous(z=F.col("_z"))
    o = o.islands(F.col("is_first") | ~F.col("_a").eqNullSafe(F.col("prev_z")), "part").result()
    joined = ~F.col("is_first") & F.col("_a").eqNullSafe(F.col("prev_z"))
    v = o.filter("coords is not null").select("owner", "seq", "part", joined.alias("_on"), F.posexplode("coords").alias("_pos", "vertex")).filter(~F.col("_on") | (F.col("_pos") > 0))
    v = Ordered(v, ["owner", "part"], ["seq", "_pos"], F.floor(F.col("seq") / 1000)).running(sums={"_n": F.lit(1)}).result()
    return v.select("owner", "part", (F.col("_n") - 1).alias("n"), "vertex")


def compare_catalog(installed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per installed cell: current, new edition, new update, cancelled or not listed.

    A cell held as cancelled that the catalog lists as active was issued anew; one cancelled on both sides is left out.
    """
    c = catalog.select("cell", F.col("edition").alias("_e"), F.col("upd").alias("_u"), F.coalesce("cancelled", F.lit(False)).alias("_gone"))
    held = installed if "cancelled" in installed.columns else installed.withColumn("cancelled", F.lit(False))
    j = held.withColumn("cancelled", F.coalesce("cancelled", F.lit(False))).join(c, "cell", "left").filter(~(F.col("cancelled") & F.coalesce("_gone", F.lit(False))))
    s = (F.when(F.col("_e").isNull(), "unlisted").when(F.col("_gone"), "cancelled").when(F.col("cancelled") | (F.col("_e") > F.col("edition")), "new edition")
         .when((F.col("_e") == F.col("edition")) & (F.col("_u") > F.col("upd")), "new update").otherwise("current"))
    return j.select("cell", s.alias("status"))


def infer_region(installed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Regions that share active cells with what is installed, by Jaccard overlap; ``best`` marks the winner, the first in the catalog on ties.

    A cell may list several regions (an array). Cancelled cells count on neither side.
    """
    if isinstance(catalog.schema["region"].dataType, T.ArrayType):
        catalog = catalog.withColumn("region", F.explode("region"))
    if "cancelled" in installed.columns:
        installed = installed.filter(~F.coalesce("cancelled", F.lit(False)))
    act = catalog.filter(~F.coalesce("cancelled", F.lit(False))).select("cell", "region", "ord").distinct()
    per = act.groupBy("region").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    both = act.join(installed.select("cell"), "cell", "left_semi").groupBy("region").agg(F.count("*").alias("k"))
    tot = installed.agg(F.count("*").alias("m"))
    j = per.join(both, "region").crossJoin(F.broadcast(tot)).select("region", "ord", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("jaccard"))   # one row
    top = j.agg(F.max(F.struct("jaccard", (-F.col("ord")).alias("_o"), "region")).alias("_top"))
    return j.crossJoin(F.broadcast(top)).select("region", "ord", "jaccard", (F.col("region") == F.col("_top.region")).alias("best"))   # one row


def dataset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (id, attrs, vertices) that differ: added, removed, attributes or geometry."""
    j = a.select("id", F.col("attrs").alias("_a"), F.col("vertices").alias("_va")).join(b.select("id", F.col("attrs").alias("_b"), F.col("vertices").alias("_vb")), "id", "full_outer")
    moved = (F.size(F.array_except("_va", "_vb")) > 0) | (F.size(F.array_except("_vb", "_va")) > 0)
    w = F.when(F.col("_va").isNull(), "added").when(F.col("_vb").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "attributes").when(moved, "geometry")
    return j.select("id", w.alias("change")).filter(F.col("change").isNotNull())


def cell_name_parts(name: Column) -> Column:
    """Struct(producer, band, region, id) of an eight-character cell name."""
    ok = name.rlike("^[A-Z0-9]{2}[1-6][A-Z0-9]+$")
    return F.when(ok, F.struct(F.substring(name, 1, 2).alias("producer"), F.substring(name, 3, 1).cast("int").alias("band"), F.substring(name, 4, 2).alias("region"), F.substring(name, 6, 20).alias("id")))


def record_counts(declared: DataFrame, records: DataFrame) -> DataFrame:
    """Declared against parsed record counts per cell and kind."""
    n = records.groupBy("cell").agg(*[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in ("feature", "vector")])
    j = declared.join(n, "cell", "left")
    return j.select("cell", *[(F.col(f"n_{k}") - F.coalesce(f"_{k}", F.lit(0))).alias(f"missing_{k}") for k in ("feature", "vector")])


def legend(rules: DataFrame) -> DataFrame:
    """Legend titles, top-drawn first; shared titles merge at their topmost place."""
    return rules.groupBy("title").agg(F.max("pos").alias("pos")).orderBy(F.col("pos").desc())
