"""Ordered work over keys of any size.

A plain ``Window.partitionBy(key)`` sorts a whole key in one task, so one hot key stalls the job.
Here each key is cut into consecutive *chunks* by a value that grows with the order (usually a time
bucket). Windows run inside a chunk; one summary row per chunk then carries the answer across chunk
borders. The big table is shuffled once, on (key, chunk); only summaries meet on the key alone.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import cut_lineage


def time_chunk(t: Column, width_s: float) -> Column:
    return F.floor(t / F.lit(float(width_s)))


class Ordered:
    """A table with keys, a chunk and a total order inside each key.

    ``chunk`` must not decrease along ``order``. ``order`` columns must not be null.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], chunk: Column):
        self.keys, self.order = list(keys), list(order)
        self.df = df.withColumn("_chunk", chunk)

    @property
    def _on(self) -> list[str]:
        return [*self.keys, "_chunk"]

    def _inner(self, reverse: bool = False):
        cols = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self._on).orderBy(*cols)

    def _outer(self, reverse: bool = False):
        w = Window.partitionBy(*self.keys)
        return w.orderBy(F.col("_chunk").desc() if reverse else F.col("_chunk").asc())

    def _with(self, df: DataFrame) -> "Ordered":
        out = Ordered.__new__(Ordered)
        out.keys, out.order, out.df = self.keys, self.order, df
        return out

    def _neighbour(self, values: dict[str, Column], reverse: bool) -> "Ordered":
        packed = self.df.withColumn("_ov", F.struct(*[c.alias(n) for n, c in values.items()]))
        key = F.struct(*[F.col(c) for c in self.order])
        edge = (F.min_by if reverse else F.max_by)(F.col("_ov"), key)
        carry = (packed.groupBy(*self._on).agg(edge.alias("_oe"))
                 .withColumn("_oc", F.lag("_oe").over(self._outer(reverse))).drop("_oe"))
        # a left join: every chunk has its own carry row, and a left join never inverts the big side; merged on the order the
        # window needs anyway, as there may be as many chunks as rows
        out = (packed.withColumn("_on", F.lag("_ov").over(self._inner(reverse)))
               .join(carry.hint("merge"), self._on, "left")
               .withColumn("_on", F.coalesce("_on", "_oc")))
        drop = ["_ov", "_on", "_oc"]
        return self._with(out.select("*", *[F.col(f"_on.{n}").alias(f"{'next' if reverse else 'prev'}_{n}")
                                            for n in values],
                                     *([] if reverse else [F.col("_on").isNull().alias("is_first")]),
                                     *([F.col("_on").isNull().alias("is_last")] if reverse else [])).drop(*drop))

    def previous(self, **values: Column) -> "Ordered":
        """Adds ``prev_<name>`` from the row before, and ``is_first``."""
        return self._neighbour(values, False)

    def following(self, **values: Column) -> "Ordered":
        """Adds ``next_<name>`` from the row after, and ``is_last``."""
        return self._neighbour(values, True)

    def running(self, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None,
                lasts: dict[str, Column] | None = None, inclusive: bool = True, reverse: bool = False) -> "Ordered":
        """Running sums, maxima and last non-null values, over this and earlier rows.

        ``inclusive=False`` leaves the current row out (null before the first row; 0 for sums).
        """
        sums, maxima, lasts = sums or {}, maxima or {}, lasts or {}
        df = self.df
        for n, c in {**sums, **maxima, **lasts}.items():
            df = df.withColumn(f"_in_{n}", c)
        key = F.struct(*[F.col(c) for c in self.order])
        by_last = F.min_by if reverse else F.max_by
        aggs = ([F.sum(f"_in_{n}").alias(f"_a_{n}") for n in sums] + [F.max(f"_in_{n}").alias(f"_a_{n}") for n in maxima]
                + [by_last(F.when(F.col(f"_in_{n}").isNotNull(), F.col(f"_in_{n}")),
                           F.when(F.col(f"_in_{n}").isNotNull(), key)).alias(f"_a_{n}") for n in lasts])
        before = self._outer(reverse).rowsBetween(Window.unboundedPreceding, -1)
        carry = df.groupBy(*self._on).agg(*aggs).select(
            *self._on,
            *[F.sum(f"_a_{n}").over(before).alias(f"_c_{n}") for n in sums],
            *[F.max(f"_a_{n}").over(before).alias(f"_c_{n}") for n in maxima],
            *[F.last(f"_a_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts])
        end = 0 if inclusive else -1
        w = self._inner(reverse).rowsBetween(Window.unboundedPreceding, end)
        for n in sums:
            df = df.withColumn(f"_w_{n}", F.sum(f"_in_{n}").over(w))
        for n in maxima:
            df = df.withColumn(f"_w_{n}", F.max(f"_in_{n}").over(w))
        for n in lasts:
            df = df.withColumn(f"_w_{n}", F.last(f"_in_{n}", ignorenulls=True).over(w))
        df = df.join(carry.hint("merge"), self._on, "left")
        for n in sums:
            zero = F.lit(0).cast(df.schema[f"_w_{n}"].dataType)
            df = df.withColumn(n, F.coalesce(F.col(f"_w_{n}"), zero) + F.coalesce(F.col(f"_c_{n}"), zero))
        for n in maxima:
            df = df.withColumn(n, F.greatest(f"_w_{n}", f"_c_{n}"))
        for n in lasts:
            df = df.withColumn(n, F.coalesce(f"_w_{n}", f"_c_{n}"))
        junk = [f"_{p}_{n}" for p in ("in", "w", "c") for n in {**sums, **maxima, **lasts}]
        return self._with(df.drop(*junk))

    def islands(self, starts: Column, name: str = "island") -> "Ordered":
        """Numbers runs from 1: a new run begins where ``starts`` is true."""
        return self.running(sums={name: F.when(starts, 1).otherwise(0).cast("long")})

    def result(self) -> DataFrame:
        return self.df.drop("_chunk")


def fold(df: DataFrame, keys: list[str], order: list[str], chunk: Column, state_schema: str,
         out_schema: str, step: Callable, initial: Callable) -> DataFrame:
    """An order-dependent fold per key, run chunk by chunk in parallel.

    ``step(state, pdf) -> (state, out_pdf)`` folds one chunk's sorted rows; ``initial()`` makes the
    first state (a tuple). Every chunk starts from a guess (the initial state) and is redone only
    when the state its predecessor ends in differs from the one it was given. At the fixpoint each
    chunk has started from its true state, so the result equals one sequential pass over the key.
    Folds that forget their past quickly settle in two or three rounds; rounds go on until every
    chunk has its true state, so a fold that never forgets takes one per chunk.
    """
    spark = df.sparkSession
    # every round reads the rows again, so what they come from is worked out once
    src = cut_lineage(df.withColumn("_chunk", chunk))
    key_fields = [f for f in src.schema if f.name in keys or f.name == "_chunk"]
    state = T._parse_datatype_string(state_schema)
    names = [f.name for f in state]
    end_schema = T.StructType([*key_fields, *[T.StructField(f"e_{f.name}", f.dataType) for f in state]])
    on = [*keys, "_chunk"]

    def read_state(pdf, prefix):
        if prefix is None or pdf[f"{prefix}{names[0]}"].isna().iloc[0] and bool(pdf["_fresh"].iloc[0]):
            return initial()
        return tuple(None if _missing(pdf[f"{prefix}{n}"].iloc[0]) else pdf[f"{prefix}{n}"].iloc[0] for n in names)

    def run_end(pdf):
        import pandas as pd
        pdf = pdf.sort_values(order)
        end, _ = step(read_state(pdf, "s_"), pdf)
        row = {c: pdf[c].iloc[0] for c in on}
        row.update({f"e_{n}": v for n, v in zip(names, end)})
        return pd.DataFrame([row])[[f.name for f in end_schema]]

    def run_out(pdf):
        pdf = pdf.sort_values(order)
        return step(read_state(pdf, "s_"), pdf)[1]

    null_state = [F.lit(None).cast(f.dataType).alias(f"s_{f.name}") for f in state]
    ends = cut_lineage(src.select("*", *null_state, F.lit(True).alias("_fresh"))
                       .groupBy(*on).applyInPandas(run_end, end_schema))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    given = ends.select(*on, *[F.lit(None).cast(f.dataType).alias(f"s_{f.name}") for f in state],
                        F.lit(True).alias("_fresh"))
    while True:
        want = ends.select(*on, *[F.lag(f"e_{n}").over(w).alias(f"s_{n}") for n in names],
                           (F.row_number().over(w) == 1).alias("_fresh"))
        old = given.select(*on, F.struct(*[f"s_{n}" for n in names], "_fresh").alias("_old"))
        now = want.withColumn("_new", F.struct(*[f"s_{n}" for n in names], "_fresh"))
        changed = cut_lineage(now.join(old.hint("merge"), on).filter(~F.col("_new").eqNullSafe(F.col("_old"))).drop("_new", "_old"))
        given = cut_lineage(want)
        if changed.isEmpty():
            break
        redone = src.join(changed.hint("merge"), on).groupBy(*on).applyInPandas(run_end, end_schema)
        ends = cut_lineage(ends.join(changed.hint("merge"), on, "left_anti").unionByName(redone))
    return src.join(given.hint("merge"), on).groupBy(*on).applyInPandas(run_out, out_schema)


def _missing(v) -> bool:
    return v is None or (isinstance(v, float) and v != v)


def asof(probe: DataFrame, table: DataFrame, keys: list[str], t: str, width_s: float,
         values: list[str], ties_match: bool = True) -> DataFrame:
    """For each probe row, the last table row of the same keys at or before its time.

    Union and ordered last-value instead of a range join: one shuffle, no candidate pairs, and a hot
    key is spread over its time chunks. Adds ``asof_<value>`` columns (null when nothing came before).
    """
    pcols = [c for c in probe.columns if c not in keys and c != t]
    p = probe.select(*keys, t, F.lit(1 if ties_match else -1).alias("_side"),
                     F.struct(*[F.col(c) for c in pcols]).alias("_p"),
                     F.lit(None).cast(table.select(F.struct(t, *values)).schema[0].dataType).alias("_t"))
    q = table.select(*keys, t, F.lit(0).alias("_side"),
                     F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(t, *values).alias("_t"))
    o = Ordered(p.unionByName(q), keys, [t, "_side"], time_chunk(F.col(t), width_s))
    out = o.running(lasts={"_hit": F.col("_t")}).result().filter(F.col("_side") != 0)
    return out.select(*keys, t, "_p.*", F.col(f"_hit.{t}").alias(f"asof_{t}"),
                      *[F.col(f"_hit.{v}").alias(f"asof_{v}") for v in values])
