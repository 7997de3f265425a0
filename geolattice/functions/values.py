"""Text-typed value Columns: comparisons, arithmetic and formatting used by filters and styles.

A feature field reaches a filter as text, so ``as_text`` is applied first; comparisons look for
numbers inside that text. Every function is total: nothing here raises under ANSI mode.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from .geo import lit
from .text import ascii_lower, ascii_upper

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def number(c) -> Column:
    """Finite number in a text or numeric value, else null."""
    v = F.expr("try_cast(NULL AS DOUBLE)") if c is None else lit(c).try_cast("double")
    return F.when((F.abs(v) < float("inf")) & ~F.isnan(v), v)


def number_text(c) -> Column:
    """Shortest text of a double: no trailing zeros, no exponent for whole numbers below 1e21."""
    v = lit(c).cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 9e15)
    short = v.cast("string")
    # 1.5E-5 -> 1.5e-05 as C prints it
    sci = F.regexp_replace(F.regexp_replace(F.lower(short), "\\.0e", "e"), "e(-?)(\\d)$", "e$10$2")
    sci = F.regexp_replace(sci, "e(\\d)", "e+$1")
    small = (F.abs(v) < 1e-3) & (F.abs(v) >= 1e-4)
    return (F.when(F.isnan(v), "NaN").when(v == float("inf"), "Infinity").when(v == float("-inf"), "-Infinity")
            .when(whole, F.regexp_replace(v.cast("decimal(22,0)").cast("string"), "^-0$", "0"))
            .when(small, _plain_small(short, v)).when(short.contains("E"), sci).otherwise(short))


def _plain_small(short: Column, v: Column) -> Column:
    digits = F.regexp_replace(F.regexp_extract(short, "^-?([0-9.]+)E", 1), "\\.|0$", "")
    return F.concat(F.when(v < 0, "-").otherwise(""), F.lit("0.000"), digits)


def category_key(c: Column, dtype: T.DataType) -> Column:
    """Text as is, numbers shortest, booleans true/false, null as empty."""
    if isinstance(dtype, T.BooleanType):
        t = F.when(c, "true").otherwise("false")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        t = number_text(c)
    else:
        t = c.cast("string")
    return F.when(c.isNull(), "").otherwise(t)


def label_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), "").when(c, "yes").otherwise("no")
    return category_key(c, dtype)


def field_text(c: Column, dtype: T.DataType) -> Column:
    """What ``get`` reads: the value as text, null kept, binary never read."""
    if isinstance(dtype, T.BinaryType):
        return F.lit(None).cast("string")
    return F.when(c.isNotNull(), category_key(c, dtype))


def has(c: Column, dtype: T.DataType) -> Column:
    return F.lit(False) if isinstance(dtype, T.BinaryType) else c.isNotNull()


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def equals(a: Column, b, b_type: str) -> Column:
    """Text value ``a`` against a literal of type text, number or boolean. Null equals only null."""
    if b_type == "number":
        return is_true(number(a) == lit(b))
    if b_type == "boolean":
        return is_true(a == F.when(lit(b), "true").otherwise("false"))
    return a.eqNullSafe(lit(b))


def orders(a: Column, op: str, b) -> Column:
    """``<  <=  >  >=``: by number when both are numbers, by text when both are text, else false."""
    x, y = number(a), number(b)
    text_b = F.lit(b) if isinstance(b, str) else (b if isinstance(b, Column) else None)
    table = {"<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}
    by_number = table[op](x, y)
    by_text = table[op](a, text_b) if text_b is not None else F.lit(False)
    return F.coalesce(F.when(x.isNotNull() & y.isNotNull(), by_number).otherwise(by_text), F.lit(False))


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda p, q: p & q, [is_true(c) for c in conds], F.lit(True))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda p, q: p | q, [is_true(c) for c in conds], F.lit(False))


def is_in(needle: Column, hay) -> Column:
    """Substring of a text, or member of a list of literals."""
    if isinstance(hay, (list, tuple)):
        return any_of([equals(needle, h, "number" if isinstance(h, (int, float)) else "text") for h in hay])
    return F.coalesce(lit(hay).contains(F.coalesce(needle, F.lit(""))), F.lit(False))


def to_number(*args: tuple[Column, T.DataType]) -> Column:
    """First convertible argument; null counts as 0, booleans as 0/1."""
    out = F.lit(None).cast("double")
    for c, dt in reversed(args):
        v = c.cast("double") if isinstance(dt, T.BooleanType) else number(c)
        out = F.when(c.isNull(), 0.0).when(v.isNotNull(), v).otherwise(out)
    return out


def to_boolean(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        v = c
    elif isinstance(dtype, NUMERIC):
        v = (c != 0) & ~F.isnan(c.cast("double"))
    else:
        v = c != ""
    return F.coalesce(v, F.lit(False))


def first_of_type(cols: list[tuple[Column, T.DataType]], kind: str) -> Column:
    """The first non-null argument whose column type is text, number or boolean."""
    kinds = {"string": (T.StringType,), "number": NUMERIC, "boolean": (T.BooleanType,)}[kind]
    hits = [c for c, dt in cols if isinstance(dt, kinds)]
    return F.coalesce(*hits) if hits else F.lit(None)


def match(value: Column, arms: list[tuple[list, Column]], fallback: Column) -> Column:
    out = fallback
    for labels, result in reversed(arms):
        out = F.when(value.isNotNull() & is_in(value, list(labels)), result).otherwise(out)
    return out


def case(arms: list[tuple[Column, Column]], fallback: Column) -> Column:
    out = fallback
    for cond, result in reversed(arms):
        out = F.when(is_true(cond), result).otherwise(out)
    return out


def step(value: Column, base, stops: list[tuple[float, object]]) -> Column:
    """The output of the last stop not above the number; the base when there is no number."""
    out, x = lit(base), number(value)
    for stop, result in stops:
        out = F.when(x >= stop, lit(result)).otherwise(out)
    return out


def interpolate(value: Column, stops: list[tuple[float, float]], base: float = 1.0) -> Column:
    """Piecewise linear (base 1) or exponential, clamped at both ends."""
    x = number(value)
    out = F.when(x <= stops[0][0], F.lit(float(stops[0][1])))
    for (lo, a), (hi, b) in zip(stops, stops[1:]):
        if hi == lo:
            f = F.lit(0.0)
        elif base == 1.0:
            f = (x - lo) / (hi - lo)
        else:
            f = (F.pow(F.lit(float(base)), x - lo) - 1) / (base ** (hi - lo) - 1)
        out = out.when(x < hi, a + f * (b - a))
    return out.when(x.isNotNull(), F.lit(float(stops[-1][1])))


def concat_text(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def downcase(c: Column) -> Column:
    return ascii_lower(F.coalesce(c, F.lit("")))


def upcase(c: Column) -> Column:
    return ascii_upper(F.coalesce(c, F.lit("")))


def ieee_div(a: Column, b: Column) -> Column:
    """Division that yields +-Infinity or NaN rather than null or an error."""
    zero = b == 0
    edge = F.when(a == 0, float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when(zero, edge).otherwise(F.try_divide(a, b))


def arithmetic(op: str, *args: Column) -> Column:
    """``+ - * / % min max`` over numbers; any non-number makes the result null."""
    v = [number(a) for a in args]
    if op == "+":
        r = reduce(lambda p, q: p + q, v)
    elif op == "*":
        r = reduce(lambda p, q: p * q, v)
    elif op == "-":
        r = -v[0] if len(v) == 1 else v[0] - v[1]
    elif op == "/":
        r = ieee_div(v[0], v[1])
    elif op == "%":
        r = F.when(v[1] == 0, F.lit(float("nan"))).otherwise(F.try_mod(v[0], v[1]))
    else:
        r = v[0] if len(v) == 1 else (F.least(*v) if op == "min" else F.greatest(*v))
    known = reduce(lambda p, q: p & q, [x.isNotNull() for x in v])
    return F.when(known, r)


def geometry_type(gtype: Column, part_types: Column | None = None) -> Column:
    """Multi types fold to their single form; a collection folds when all parts agree."""
    single = F.regexp_replace(gtype, "^Multi", "")
    if part_types is None:
        return F.when(single.isin("Point", "LineString", "Polygon"), single)
    kinds = F.array_distinct(F.transform(part_types, lambda p: F.regexp_replace(p, "^Multi", "")))
    return (F.when(single.isin("Point", "LineString", "Polygon"), single)
            .when((gtype == "GeometryCollection") & (F.size(kinds) == 1), F.element_at(kinds, 1)))


def action_url(value: Column, role: str) -> Column:
    """Link for a phone, email or url field; empty when there is none."""
    t = F.trim(F.coalesce(value, F.lit("")))
    if role == "phone":
        plus = F.when(t.rlike("^[^0-9]*[+]"), "+").otherwise("")
        digits = F.regexp_replace(t, "[^0-9]", "")
        url = F.when(digits == "", "").otherwise(F.concat(F.lit("tel:"), plus, digits))
    elif role == "email":
        url = F.concat(F.lit("mailto:"), t)
    else:
        url = F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))
    return F.when(t == "", "").otherwise(url)
