"""Feature tables: filter, select, classify, validate, edit and change schema."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import geo, values
from ..functions.text import ascii_lower, contains_text

# Fixed value: number of colours categories cycle through.
PALETTE_SIZE = 10


class ClauseError(ValueError):
    """A clause that cannot be used: ``code`` (unknown_field, missing_value, bad_number, bad_boolean), its ``index`` from 0 and the ``part`` at fault."""

    def __init__(self, code: str, index: int, part: str):
        super().__init__(f"{code} at clause [{index}]: {part!r}")
        self.code, self.index, self.part = code, index, part


def _field(df: DataFrame, name: str) -> T.StructField | None:
    return next((f for f in df.schema if f.name.lower() == name.lower()), None)


def clause_column(df: DataFrame, clause: tuple, index: int = 0) -> Column:
    """One clause ``(field, op, value)``: op is = != < <= > >= contains, empty or not empty."""
    name, op, value = (*clause, None)[:3]
    f = _field(df, name)
    if f is None:
        raise ClauseError("unknown_field", index, name)
    text = values.field_text(F.col(f.name), f.dataType)
    if op == "is empty":
        return ~values.has(F.col(f.name), f.dataType)
    if op == "is not empty":
        return values.has(F.col(f.name), f.dataType)
    typed = "" if value is None else str(value).strip()
    if not typed:
        raise ClauseError("missing_value", index, f"{name} {op}")
    if op == "contains":
        return values.is_in(F.lit(typed.lower()), values.downcase(text))
    if isinstance(f.dataType, values.NUMERIC):
        try:
            literal, kind = float(typed), "number"
        except ValueError:
            raise ClauseError("bad_number", index, typed) from None
    elif isinstance(f.dataType, T.BooleanType):
        word = {"true": "true", "yes": "true", "1": "true", "false": "false", "no": "false", "0": "false"}.get(typed.lower())
        if word is None:
            raise ClauseError("bad_boolean", index, typed)
        literal, kind = word, "text"
    else:
        literal, kind = typed, "text"
    if op == "=":
        return values.equals(text, literal, kind)
    if op == "!=":
        return ~values.equals(text, literal, kind)
    return values.orders(text, op, literal)


def filter_features(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Keep rows where the predicate is true; null rejects; no predicate keeps all."""
    return df if predicate is None else df.filter(values.is_true(predicate))


def select_where(df: DataFrame, clauses: list[tuple], match: str = "all") -> DataFrame:
    cols = [clause_column(df, c, i) for i, c in enumerate(clauses)]
    return df.filter(values.all_of(cols) if match == "all" else values.any_of(cols)) if cols else df


def saved_queries(df: DataFrame, saved: dict[str, tuple[str, list[tuple]]], id_col: str = "id") -> DataFrame:
    """All saved queries in one scan: one row per (query_id, id) that matches."""
    hits = []
    for qid, (match, clauses) in saved.items():
        cols = [clause_column(df, c, i) for i, c in enumerate(clauses)]
        cond = values.all_of(cols) if match == "all" else values.any_of(cols)
        hits.append(F.when(cond, F.lit(qid)))
    return df.select(F.explode(F.array_compact(F.array(*hits))).alias("query_id"), F.col(id_col))


def in_box(df: DataFrame, box: tuple, bounds=("min_lat", "min_lon", "max_lat", "max_lon")) -> DataFrame:
    """Rows whose envelope touches the (s, w, n, e) box; split at +-180 so each half prunes files."""
    s, w, n, e = box
    lat_lo, lon_lo, lat_hi, lon_hi = [F.col(b) for b in bounds]
    halves = [(w, 180.0), (-180.0, e)] if w > e else [(w, e)]
    lon = reduce(lambda a, b: a | b, [(lon_lo <= hi) & (lon_hi >= lo) for lo, hi in halves])
    return df.filter((lat_lo <= n) & (lat_hi >= s) & lon)


def rows_with_text(df: DataFrame, cells: list[str], typed: str) -> DataFrame:
    return df if not typed else df.filter(contains_text([F.col(c) for c in cells], typed))


def sort_rows(df: DataFrame, column: str, ascending: bool = True, id_col: str = "id") -> DataFrame:
    """Numbers as numbers, text without ASCII case, empties last both ways, ties by id."""
    dt = df.schema[column].dataType
    c = F.col(column) if isinstance(dt, values.NUMERIC) else ascii_lower(F.when(F.col(column) != "", F.col(column)))
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), F.col(id_col))


def extent(df: DataFrame, bounds=("min_lat", "min_lon", "max_lat", "max_lon")) -> DataFrame:
    """Count, and the box of all geometry (nulls when none has any)."""
    return df.agg(F.count("*").alias("features"), *[(F.min if b.startswith("min") else F.max)(b).alias(b) for b in bounds])


def categories(df: DataFrame, field: str, choices: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per category in legend order, with its label and palette place.

    The distinct values are few by nature (a legend); the window runs over them, not over features.
    """
    dt = df.schema[field].dataType
    numeric = isinstance(dt, values.NUMERIC)
    seen = (df.filter(F.col(field).isNotNull()).groupBy(field).agg(F.lit(1).alias("one"))
            .select(values.category_key(F.col(field), dt).alias("value"),
                    (F.col(field).cast("double") if numeric else F.lit(0.0)).alias("num"),
                    F.lit(1).alias("grp"), F.lit(0).alias("pos"), F.lit("").alias("label")))
    if choices:
        spark = df.sparkSession
        listed = spark.createDataFrame([(v, 0.0, 0, i, "" if lb == v else lb) for i, (v, lb) in enumerate(choices)],
                                       "value string, num double, grp int, pos int, label string")
        seen = listed.unionByName(seen).groupBy("value").agg(
            F.min(F.struct("grp", "pos", "num", "label")).alias("m")).select("value", "m.*")
    order = Window.orderBy("grp", "pos", *(["num"] if numeric else []), "value")
    return (seen.withColumn("position", F.row_number().over(order).cast("int") - 1)
            .select("position", "value", "label", (F.col("position") % PALETTE_SIZE).cast("int").alias("palette")))


def equal_intervals(df: DataFrame, field: str, classes: int) -> DataFrame:
    """Lower bounds of equal-width classes; equal bounds collapse."""
    x = F.col(field).cast("double")
    # distinct values first, so the count is a plain partial aggregate
    per = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("x")).agg(F.lit(1).alias("one"))
    a = per.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("d"))
    n = F.greatest(F.lit(1), F.least(F.lit(max(classes, 1)), F.col("d").cast("int")))
    return (a.filter(F.col("d") > 0)
            .select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1),
                    lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i.cast("double") / n))).alias("lower")))


def quantiles(df: DataFrame, field: str, classes: int) -> DataFrame:
    """Exact quantile lower bounds: the sorted value at rank floor(i*N/n); duplicates collapse.

    Values are counted first (repeats cost nothing). Ranks come from running counts over value
    buckets, so no task sorts more than one bucket of distinct values.
    """
    from .ordered import Ordered
    x = F.col(field).cast("double")
    per = df.filter(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("x")).agg(F.count("*").alias("c"))
    a = per.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("c").alias("total"), F.count("*").alias("d"))
    wide = per.crossJoin(F.broadcast(a)).withColumn("g", F.lit(0))   # one aggregate row
    bucket = F.floor(F.coalesce(F.try_divide((F.col("x") - F.col("lo")) * 4096, F.col("hi") - F.col("lo")), F.lit(0.0)))
    run = Ordered(wide, ["g"], ["x"], bucket).running(sums={"upto": F.col("c")}).result()
    n = F.greatest(F.lit(1), F.least(F.lit(max(classes, 1)), F.col("d").cast("int")))
    hit = F.exists(F.sequence(F.lit(0), n - 1),
                   lambda i: (F.floor(i * F.col("total") / n) >= F.col("upto") - F.col("c"))
                   & (F.floor(i * F.col("total") / n) < F.col("upto")))
    return run.filter(hit).select(F.col("x").alias("lower"))


def sample_values(df: DataFrame, field: str, limit: int) -> DataFrame:
    """The first distinct non-empty keys, numbers in numeric order."""
    dt = df.schema[field].dataType
    d = df.groupBy(F.col(field).alias("v")).agg(F.lit(1).alias("one")).select(
        (F.col("v").cast("double") if isinstance(dt, values.NUMERIC) else F.lit(0.0)).alias("num"),
        values.category_key(F.col("v"), dt).alias("value"))
    return d.filter(F.col("value") != "").orderBy("num", "value").limit(limit).select("value")


# --- schema and values ----------------------------------------------------------------------

def value_error(c: Column, dtype: T.DataType, required=False, lo=None, hi=None, choices=None) -> Column:
    """Why a value does not fit its field, or null."""
    out = F.lit(None).cast("string")
    if choices is not None:
        out = F.when(~values.category_key(c, dtype).isin(*choices), "unlisted_choice").otherwise(out)
    if isinstance(dtype, values.NUMERIC):
        if hi is not None:
            out = F.when(c > hi, "above_max").otherwise(out)
        if lo is not None:
            out = F.when(c < lo, "below_min").otherwise(out)
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            out = F.when(F.isnan(c), "nan").otherwise(out)
    return F.when(c.isNull(), F.lit("missing" if required else None)).otherwise(out)


def validate_rows(df: DataFrame, rules: dict[str, dict], id_col: str = "id") -> DataFrame:
    """One row per bad value: (id, field, error)."""
    checks = [F.struct(F.lit(f).alias("field"), value_error(F.col(f), df.schema[f].dataType, **r).alias("error"))
              for f, r in rules.items()]
    return (df.select(F.col(id_col), F.explode(F.array(*checks)).alias("x"))
            .select(id_col, "x.*").filter(F.col("error").isNotNull()))


def validate_schema(fields: DataFrame) -> DataFrame:
    """Problems in a table of field definitions (name, type, role, n_choices, min, max, range_end)."""
    names = fields.select(F.lower("name").alias("_end"), F.col("type").alias("_end_type")).distinct()
    dup = fields.groupBy(F.lower("name").alias("_low")).count().filter(F.col("count") > 1).select("_low", F.lit(True).alias("_dup"))
    date = ["date", "datetime"]
    j = (fields.join(names, F.lower("range_end") == F.col("_end"), "left")
         .join(dup, F.lower("name") == F.col("_low"), "left"))
    bad_end = (F.coalesce(F.col("range_end"), F.lit("")) != "") & ~(
        F.col("type").isin(*date) & F.coalesce(F.col("_end_type").isin(*date), F.lit(False)))
    err = (F.when(F.coalesce(F.col("name"), F.lit("")) == "", "unnamed").when(F.col("_dup"), "duplicate_name")
           .when((F.col("role") == "enumeration") & (F.col("n_choices") == 0), "empty_choices")
           .when(F.col("min") > F.col("max"), "crossed_limits").when(bad_end, "range_end_not_date"))
    return j.select("name", err.alias("error")).filter(F.col("error").isNotNull())


DATE_RE = r"^\d{4}-(0[1-9]|1[0-2])-\d{2}$"


def convert(c: Column, source: str, target: str) -> tuple[Column, Column]:
    """(value, lost): a value moved to another field type; what does not convert becomes null and lost.

    Types: text integer real boolean date datetime.
    """
    text = values.number_text(c) if source == "real" else (
        F.when(c, "Yes").otherwise("No") if source == "boolean" else c.cast("string"))
    t = F.trim(text)
    lossy = F.lit(False)
    if source == target:
        v = c
    elif target == "text":
        v = F.when(t != "", t)
    elif target == "integer":
        if source == "real":
            ok = (F.abs(c) <= 9.2e18) & ~F.isnan(c)
            r = F.when(c < 0, F.ceil(c - 0.5)).otherwise(F.floor(c + 0.5))
            v, lossy = F.when(ok, r.cast("long")), F.coalesce(ok & (r != c), F.lit(False))
        elif source == "boolean":
            v = c.cast("long")
        else:
            v = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("long"))
    elif target == "real":
        v = c.cast("double") if source in ("integer", "boolean") else values.number(F.when(t != "", t))
    elif target == "boolean":
        low = F.lower(t)
        v = F.when(low.isin("yes", "true", "1"), True).when(low.isin("no", "false", "0"), False)
    elif target == "date":
        if source == "datetime":
            v, lossy = F.substring(c, 1, 10), F.length(c) > 10
        else:
            v = F.when(t.rlike(DATE_RE) & t.try_cast("date").isNotNull(), t)
    else:
        if source == "date":
            v = F.concat(c, F.lit("T00:00:00"))
        else:
            iso = F.regexp_replace(t, "^(.{10}) ", "$1T")
            good = iso.rlike(r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:([0-5]\d|60)(\.\d+)?)?(Z|[+-](0\d|1[0-4]):[0-5]\d)?$")
            v = F.when(good & F.substring(iso, 1, 10).try_cast("date").isNotNull(), iso)
    return v, c.isNotNull() & (v.isNull() | lossy)


def change_schema(df: DataFrame, plan: list[dict], id_col: str = "id") -> DataFrame:
    """One select: each entry gives name, type and either source+from_type or only a default."""
    out = [F.col(id_col)]
    for p in plan:
        default = F.lit(p.get("default"))
        v = convert(F.col(p["source"]), p["from_type"], p["type"])[0] if p.get("source") else default
        out.append((F.coalesce(v, default) if p.get("required") else v).alias(p["name"]))
    return df.select(*out)


def change_impact(df: DataFrame, plan: list[dict], dropped: list[str]) -> DataFrame:
    """Before applying: dropped fields that hold data, values lost and required values left empty."""
    aggs = [F.struct(F.lit(d).alias("field"), F.lit("dropped").alias("effect"), F.count_if(F.col(d).isNotNull()).alias("rows")) for d in dropped]
    for p in plan:
        if not p.get("source"):
            continue
        v, lost = convert(F.col(p["source"]), p["from_type"], p["type"])
        aggs.append(F.struct(F.lit(p["name"]).alias("field"), F.lit("lost").alias("effect"), F.count_if(lost).alias("rows")))
        if p.get("required"):
            aggs.append(F.struct(F.lit(p["name"]).alias("field"), F.lit("left empty").alias("effect"),
                                 F.count_if(F.coalesce(v, F.lit(p.get("default"))).isNull()).alias("rows")))
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a")).filter(F.col("rows") > 0)


# --- edits ----------------------------------------------------------------------------------

def apply_edits(base: DataFrame, edits: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new table, errors). ``edits`` has op (insert/insert_id/update/delete), edit_seq, id and the columns.

    The last edit of an id wins; inserts without an id take ids past the maximum in edit order.
    Numbering runs over the inserts only, chunk by chunk.
    """
    from .ordered import Ordered
    known = base.select("id", F.lit(True).alias("_known"))
    keyed = edits.filter(F.col("op") != "insert").join(known, "id", "left")
    bad = F.when((F.col("op") == "insert_id") & F.col("_known"), "duplicate id").when(
        F.col("op").isin("update", "delete") & F.col("_known").isNull(), "not found")
    errors = keyed.withColumn("error", bad).filter(F.col("error").isNotNull()).select("edit_seq", "id", "error")
    good = keyed.filter(bad.isNull())
    last = good.groupBy("id").agg(F.max_by(F.struct("op", *cols), "edit_seq").alias("e"))
    merged = (base.join(last, "id", "full_outer")
              .filter(F.col("e.op").isNull() | (F.col("e.op") != "delete"))
              .select("id", *[F.when(F.col("e.op").isNotNull(), F.col(f"e.{c}")).otherwise(F.col(c)).alias(c) for c in cols]))
    fresh = edits.filter(F.col("op") == "insert").withColumn("_g", F.lit(0))
    top = base.agg(F.max("id").alias("_m")).crossJoin(edits.agg(F.max(F.when(F.col("op") == "insert_id", F.col("id"))).alias("_k")))
    numbered = (Ordered(fresh, ["_g"], ["edit_seq"], F.floor(F.col("edit_seq") / 100000))
                .running(sums={"_n": F.lit(1).cast("long")}).result().crossJoin(F.broadcast(top)))
    added = numbered.select((F.coalesce(F.greatest("_m", "_k"), F.lit(0)) + F.col("_n")).alias("id"), *cols)
    return merged.unionByName(added), errors


def select_combine(current: DataFrame, found: DataFrame, mode: str) -> DataFrame:
    """Selection of ids: new, add, remove or within."""
    cur, fnd = current.select("id"), found.select("id")
    if mode == "new":
        return fnd.distinct()
    if mode == "add":
        return cur.union(fnd).distinct()
    return cur.join(fnd, "id", "left_anti" if mode == "remove" else "left_semi").distinct()


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Pad missing fields with null, in schema order; unknown fields are refused."""
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    if extra:
        raise ValueError(f"fields not in the layer: {extra}")
    have = set(df.columns)
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in schema])


def rename_style_fields(rules: DataFrame, mapping: DataFrame, fields: DataFrame) -> DataFrame:
    """Rules with field references renamed by (old, new); ``broken`` marks references to no field."""
    j = rules.join(mapping, F.lower("field") == F.lower("old"), "left").withColumn("field", F.coalesce("new", "field")).drop("old", "new")
    names = fields.select(F.lower("name").alias("_n")).distinct()
    return j.join(names, F.lower("field") == F.col("_n"), "left").withColumn("broken", F.col("_n").isNull()).drop("_n")
