"""Run queries and their DuckDB checks side by side: ``python tests/compare.py [-s sf] [name-part ...]``."""
from __future__ import annotations

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    import datetime
    import decimal
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf, name, fn, sql):
    df = fn(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = rows(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(cols)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for n, t in df.dtypes:
        if t in kinds and kinds[t] != types[n]:
            return len(got), f"type of {n}: {t} != {types[n]}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b]
        return len(got), f"rows {len(got)} vs {len(want)}; {len(diff)} differ, first got {diff[0][0] if diff else ''} want {diff[0][1] if diff else ''}"
    return len(got), ""


def main():
    import __spark_entry__ as e
    from geolattice.session import build
    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    sf = f"/root/testdata/sf{sf}"
    spark = build("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"), "spark.driver.memory": "12g", "spark.log.level": "ERROR"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(sf), e.oracle_sql(), []
    for name, fn in e.queries().items():
        if args and not any(name.startswith(a) if a.endswith("_") else a in name for a in args):
            continue
        t = time.time()
        try:
            n, msg = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as ex:
            n, msg = -1, f"{type(ex).__name__}: {str(ex)[:600]}"
        mark = "rows" if msg is None else ("ok" if msg == "" else "BAD")
        if n == 0:
            mark += " EMPTY"
        print(f"{mark:5} {name} {n} {time.time() - t:.1f}s {msg or ''}", flush=True)
        if mark == "BAD" or n <= 0:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main()
