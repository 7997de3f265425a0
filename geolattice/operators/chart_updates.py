"""Ordered chart updates as rows: record, attribute and list edits, file by file, all or nothing per file.

Nothing is folded over a record. Whether an edit fits follows from the edit before it (a record's version, an attribute's presence) or
from a running sum over the edits before it (the length of a list). The first edit that does not fit ends its cell's updates with the file before. What is left is applied row by
row: a list row's place is worked out from its record's edits alone, so the rows of one record may lie in many tasks.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .ordered import Ordered

#: Edits of one list that its rows meet at a time.
OPS = 512
_KEY = ["cell", "rec", "gen", "list"]


def _ordered(df: DataFrame, keys: list[str], order: list[str]) -> Ordered:
    return Ordered(df, keys, order, F.floor(F.col("file_no") / 10))


def _errors(df: DataFrame, message: Column, at: Column) -> DataFrame:
    return df.withColumn("error", message).filter(F.col("error").isNotNull()).select("cell", "file_no", "seq", at.cast("long").alias("at"), "rec", "error")


def check_updates(base: dict[str, DataFrame], edits: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(first error per cell, record edits with their generation, edits with it). See ``apply_chart_updates`` for the tables."""
    rec = edits["records"].select("cell", "file_no", "seq", "rec", "op", "version", "klass")
    gen = (F.col("op") == "insert").cast("long")
    o = _ordered(rec, ["cell", "rec"], ["file_no", "seq"]).previous(op=F.col("op"), version=F.col("version")).running(sums={"gen": gen}, lasts={"_made": F.when(F.col("op") == "insert", F.col("klass"))})
    held = base["records"].select("cell", "rec", F.col("version").alias("_v"), F.col("klass").alias("_k"), F.lit(True).alias("_held"))
    d = cut_lineage(o.result().join(held, ["cell", "rec"], "left"))
    there = F.when(F.col("is_first"), F.col("_held").isNotNull()).otherwise(F.col("prev_op") != "delete")
    was = F.when(F.col("is_first"), F.col("_v")).otherwise(F.col("prev_version"))
    kind = F.when(F.col("gen") > 0, F.col("_made")).otherwise(F.col("_k"))
    message = F.when(~F.col("op").isin("insert", "delete", "modify"), "unknown instruction").when((F.col("op") == "insert") & there, "inserts an existing record").when(
        (F.col("op") != "insert") & ~there, "no such record").when((F.col("op") != "insert") & ~F.coalesce(F.col("version") == was + 1, F.lit(False)), "version mismatch").when(
        (F.col("op") == "modify") & F.col("klass").isNotNull() & ~F.col("klass").eqNullSafe(kind), "changes the class of a record")
    found = [_errors(d, message, F.lit(-1))]
    gens = d.select("cell", "rec", "file_no", "seq", "gen", F.col("op").alias("_rec_op"))

    def with_gen(df):
        return df.join(gens, ["cell", "rec", "file_no", "seq"], "left")
    att = with_gen(edits["attributes"].select("cell", "file_no", "seq", "n", "rec", "code", "national", "value"))
    found.append(_errors(att, F.when(F.col("gen").isNull() | (F.col("_rec_op") == "delete"), "edit without its record"), F.col("n")))
    att = att.filter("gen is not null").withColumn("drop", F.col("value").isNull())
    a = _ordered(att, ["cell", "rec", "gen", "code", "national"], ["file_no", "seq", "n"]).previous(drop=F.col("drop")).result()
    a = cut_lineage(a.join(base["attributes"].select("cell", "rec", "code", "national", F.lit(0).cast("long").alias("gen"), F.lit(True).alias("_has")), ["cell", "rec", "gen", "code", "national"], "left"))
    has = F.when(F.col("is_first"), F.col("_has").isNotNull()).otherwise(~F.col("prev_drop"))
    found.append(_errors(a, F.when(F.col("drop") & ~has, "deletes an absent attribute"), F.col("n")))
    given = edits["values"].groupBy("cell", "file_no", "seq", "n").agg(F.count("*").alias("_given"))
    ops = with_gen(edits["lists"].select("cell", "file_no", "seq", "n", "rec", "list", "op", "at", "count")).join(given, ["cell", "file_no", "seq", "n"], "left").withColumn("_given", F.coalesce("_given", F.lit(0)))
    found.append(_errors(ops, F.when(F.col("gen").isNull() | (F.col("_rec_op") == "delete"), "edit without its record"), F.col("n")))
    ops = ops.filter("gen is not null")
    sizes = base["lists"].groupBy("cell", "rec", "list").agg(F.count("*").alias("_base")).withColumn("gen", F.lit(0).cast("long"))
    delta = F.when(F.col("op") == "insert", F.col("count")).when(F.col("op") == "delete", -F.col("count")).otherwise(0).cast("long")
    p = _ordered(ops, _KEY, ["file_no", "seq", "n"]).running(sums={"_grown": delta}, inclusive=False).result().join(sizes, _KEY, "left")
    size = F.coalesce("_base", F.lit(0)) + F.col("_grown")
    fits = (F.col("at") >= 0) & (F.col("count") >= 0) & (F.col("at") + F.when(F.col("op") == "insert", 0).otherwise(F.col("count")) <= size)
    message = F.when(~F.col("op").isin("insert", "delete", "modify"), "unknown instruction").when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("bad "), "op")).when(
        (F.col("op") != "delete") & (F.col("_given") != F.col("count")), F.concat(F.lit("bad "), "op"))
    p = cut_lineage(p)
    found.append(_errors(p, message, F.col("n")))
    first = reduce(DataFrame.unionByName, found).groupBy("cell").agg(F.min(F.struct("file_no", "seq", "at", "rec", "error")).alias("e")).select("cell", F.col("e.file_no").alias("failed_file"), "e.rec", "e.error")
    return first, d, {"attributes": a, "lists": p}


def _places(rows: DataFrame, ops: DataFrame) -> DataFrame:
    """Rows (cell, rec, gen, list, born, pos, value) moved by the edits (k, kind, at, count) of their list that came after they did; deleted ones are left out."""
    most = ops.agg(F.max("k")).first()[0]
    if most is None:
        return rows
    for r in range(most // OPS + 1):
        part = ops.filter(F.floor(F.col("k") / OPS) == r).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("k", "insert", "at", "count"))).alias("_ops")).select(
            F.struct(*_KEY).alias("_key"), "_ops")
        # the key in a struct: both sides are dealt out for this join, and a record with very many rows can be split
        j = rows.join(part, F.struct(*_KEY) == F.col("_key"), "left").drop("_key")
        later = F.filter("_ops", lambda o: o["k"] > F.col("born"))

        def move(p, o):
            end = o["at"] + o["count"]
            return F.when(o["insert"], F.when(p >= o["at"], p + o["count"]).otherwise(p)).otherwise(F.when(p >= end, p - o["count"]).when(p < o["at"], p))
        moved = F.when(F.col("_ops").isNull(), F.col("pos")).otherwise(F.aggregate(later, F.col("pos"), move))
        rows = j.withColumn("pos", moved).drop("_ops").filter(F.col("pos").isNotNull())
        if most >= OPS:
            rows = cut_lineage(rows)
    return rows


def apply_chart_updates(base: dict[str, DataFrame], edits: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cells after their updates: `records`, `attributes`, `lists` and `cells` (cell, last_file, failed_file, rec, error).

    ``base``: `records` (cell, rec, version, klass), `attributes` (cell, rec, code, national, value), `lists` (cell, rec, list, idx, value), idx from 0.
    ``edits``, in the order (file_no, seq, n): `records` (cell, file_no, seq, rec, op, version, klass: null for unchanged), `attributes` (.., n, rec, code, national, value: null
    deletes), `lists` (.., n, rec, list, op, at, count) and their `values` (cell, file_no, seq, n, j, value). An op is `insert`, `delete` or `modify`; every attribute and list edit has
    the record edit it came with, and a record that is inserted brings all it holds as edits.

    A file is applied whole or not at all; the first that fails is named with its reason, and its cell stays as the file before left it.
    """
    first, rec, checked = check_updates(base, edits)
    first = cut_lineage(first)

    def live(df):
        return df.join(first.select("cell", "failed_file"), "cell", "left").filter(F.col("failed_file").isNull() | (F.col("file_no") < F.col("failed_file"))).drop("failed_file")
    rec = live(rec)
    last = rec.groupBy("cell", "rec").agg(F.max_by(F.struct("op", "version", "gen", F.when(F.col("gen") > 0, F.col("_made")).otherwise(F.col("_k")).alias("klass")), F.struct("file_no", "seq")).alias("l"))
    state = base["records"].select("cell", "rec", "version", "klass").join(last, ["cell", "rec"], "full_outer")
    state = state.filter(F.col("l").isNull() | (F.col("l.op") != "delete")).select("cell", "rec", F.coalesce("l.version", "version").alias("version"), F.when(F.col("l").isNull(), F.col("klass")).otherwise(F.col("l.klass")).alias("klass"),
                                                                                    F.coalesce("l.gen", F.lit(0)).cast("long").alias("gen"))
    state = cut_lineage(state)
    now = state.select("cell", "rec", "gen")
    zero = F.lit(0).cast("long").alias("gen")
    att = live(checked["attributes"]).groupBy("cell", "rec", "gen", "code", "national").agg(F.max_by(F.struct("value"), F.struct("file_no", "seq", "n")).alias("_new"))
    attributes = base["attributes"].select("cell", "rec", zero, "code", "national", "value").join(att, ["cell", "rec", "gen", "code", "national"], "full_outer")
    attributes = attributes.select("cell", "rec", "gen", "code", "national", F.when(F.col("_new").isNull(), F.col("value")).otherwise(F.col("_new.value")).alias("value"), (F.col("_new").isNotNull() & F.col("_new.value").isNull()).alias("_gone"))
    attributes = attributes.filter("not _gone").drop("_gone").join(now, ["cell", "rec", "gen"], "left_semi").drop("gen")
    # a modification takes its rows out and puts as many in at the same place
    p = live(checked["lists"]).join(now, ["cell", "rec", "gen"], "left_semi")
    halves = F.when(F.col("op") == "modify", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.col("op") == "insert"))
    p = p.select(*_KEY, "file_no", "seq", "n", "at", "count", F.posexplode(halves).alias("half", "insert"))
    p = cut_lineage(_ordered(p, _KEY, ["file_no", "seq", "n", "half"]).running(sums={"k": F.lit(1).cast("long")}).result().select(*_KEY, "file_no", "seq", "n", "k", "insert", F.col("at").cast("long").alias("at"), F.col("count").cast("long").alias("count")))
    new = edits["values"].join(p.filter("insert"), ["cell", "file_no", "seq", "n"]).select(*_KEY, F.col("k").alias("born"), (F.col("at") + F.col("j")).cast("long").alias("pos"), "value")
    old = base["lists"].select("cell", "rec", zero, "list", F.lit(0).cast("long").alias("born"), F.col("idx").cast("long").alias("pos"), "value").join(now, ["cell", "rec", "gen"], "left_semi").select(*_KEY, "born", "pos", "value")
    lists = _places(old.unionByName(new), p).select("cell", "rec", "list", F.col("pos").alias("idx"), "value")
    cells = rec.groupBy("cell").agg(F.max("file_no").alias("last_file")).join(first, "cell", "full_outer").select("cell", "last_file", "failed_file", "rec", "error")
    return {"records": state.select("cell", "rec", "version", "klass"), "attributes": attributes, "lists": lists, "cells": cells}
