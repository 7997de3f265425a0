"""Geospatial tables derived from the driver tables by integer arithmetic.

Each derivation is a list of SQL expressions over one table, written once: Spark selects them, and the
same text opens the DuckDB check as a CTE. ``//`` is integer division in DuckDB and ``div`` in Spark.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# name -> (table, expressions, filter)
DERIVED: dict[str, tuple[str, list[str], str | None]] = {
    "points": ("customer", [
        "c_custkey AS id", "c_name AS title", "c_mktsegment AS layer", "c_nationkey % 4 AS provider",
        "round((c_custkey*7919 % 140001)/1e3 - 70, 6) AS lat",
        "round((c_custkey*104729 % 360000)/1e3 - 179.999e0, 6) AS lon"], None),
    # points packed into one small region, so radius joins find partners
    "town": ("customer", [
        "c_custkey AS id", "c_name AS title", "c_mktsegment AS layer", "c_nationkey % 4 AS provider",
        "round(32.6e0 + (c_custkey*7919 % 1009)/1e4, 6) AS lat",
        "round(-80.1e0 + (c_custkey*104729 % 1013)/1e4, 6) AS lon"], None),
    "stops": ("orders", [
        "o_orderkey AS sid", "o_custkey AS owner",
        "round(32.6e0 + (o_orderkey*6007 % 1019)/1e4, 6) AS slat",
        "round(-80.1e0 + (o_orderkey*9001 % 1021)/1e4, 6) AS slon"], None),
    "boxes": ("supplier", [
        "s_suppkey AS cov_id", "s_nationkey AS series_id", "s_suppkey % 7 AS source_id",
        "round((s_suppkey*7919 % 140001)/1e3 - 70, 6) - (1 + s_suppkey % 5) AS c_s",
        "round((s_suppkey*7919 % 140001)/1e3 - 70, 6) + (1 + s_suppkey % 5) AS c_n",
        "CASE WHEN (s_suppkey*104729 % 360000)/1e3 - 179.999e0 - (1 + s_suppkey % 5) < -180"
        " THEN (s_suppkey*104729 % 360000)/1e3 - 179.999e0 - (1 + s_suppkey % 5) + 360"
        " ELSE (s_suppkey*104729 % 360000)/1e3 - 179.999e0 - (1 + s_suppkey % 5) END AS c_w",
        "CASE WHEN (s_suppkey*104729 % 360000)/1e3 - 179.999e0 + (1 + s_suppkey % 5) > 180"
        " THEN (s_suppkey*104729 % 360000)/1e3 - 179.999e0 + (1 + s_suppkey % 5) - 360"
        " ELSE (s_suppkey*104729 % 360000)/1e3 - 179.999e0 + (1 + s_suppkey % 5) END AS c_e"], None),
    "areas": ("orders", [
        "o_orderkey AS area_id",
        "(o_orderkey*6007 % 150000)/1e3 - 75 AS q_s", "(o_orderkey*6007 % 150000)/1e3 - 75 + 3 AS q_n",
        "(o_orderkey*7001 % 360000)/1e3 - 180 AS q_w",
        "CASE WHEN (o_orderkey*7001 % 360000)/1e3 - 180 + 4 > 180 THEN (o_orderkey*7001 % 360000)/1e3 - 180 + 4 - 360"
        " ELSE (o_orderkey*7001 % 360000)/1e3 - 180 + 4 END AS q_e"], None),
    "features": ("part", [
        "p_partkey AS id", "p_name AS name", "p_brand AS brand", "p_type AS kind", "p_size AS size",
        "p_retailprice AS price", "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_size END AS depth",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN '' ELSE CAST(p_size AS VARCHAR(20)) END AS depth_text",
        "p_partkey % 3 = 0 AS lit",
        "round((p_partkey*7919 % 140001)/1e3 - 70, 6) AS lat",
        "round((p_partkey*104729 % 360000)/1e3 - 179.999e0, 6) AS lon"], None),
    "fixes": ("events", [
        "user_id AS track", "event_id AS seq", "epoch_us(ts)/1e6 AS t",
        "round(32.5e0 + (user_id % 50)*0.01e0 + (event_id % 97)*0.0001e0, 6) AS lat",
        "round(-80.1e0 + (event_id % 89)*0.0001e0, 6) AS lon",
        "CASE WHEN event_type = 'error' THEN NULL ELSE round(value/20, 6) END AS speed",
        "CASE WHEN event_type = 'view' THEN NULL ELSE round(event_id*7 % 300 / 1e1, 3) END AS alt",
        "event_type AS kind"], None),
    "untimed": ("events", [
        "user_id AS track", "event_id AS seq",
        "CASE WHEN event_id % 23 = 0 THEN NULL ELSE floor(epoch_us(ts)/6e7) * 60 - (event_id % 5) * 1800 END AS t"], None),
    "ways": ("orders", [
        "o_orderkey AS way", "o_custkey AS area", "o_orderkey % 6 AS klass_code",
        "3 + o_orderkey % 5 AS n_refs"], None),
    "arcs": ("lineitem", [
        "l_orderkey*8 + l_linenumber AS edge", "l_linenumber AS ln", "l_suppkey AS u",
        "(l_partkey*31 + l_linenumber) AS v_raw", "round(l_quantity*100, 3) AS length_m",
        "l_linenumber % 6 AS klass", "l_returnflag = 'R' AS private_way", "l_returnflag = 'A' AS toll",
        "20 + l_linenumber*10 AS speed_kph", "l_linestatus AS status",
        "l_partkey % 40 AS climb_dm", "l_orderkey % 30 AS descent_dm"], None),
    "catalog": ("part", [
        "'US' || CAST(1 + p_partkey % 6 AS VARCHAR(4)) || 'C' || CAST(p_partkey AS VARCHAR(20)) AS cell",
        "p_size % 7 AS edition", "p_partkey % 5 AS upd", "p_partkey % 19 = 0 AS cancelled",
        "p_brand AS region", "p_partkey AS ord"], "p_partkey % 10 <> 3"),
    "installed": ("part", [
        "'US' || CAST(1 + p_partkey % 6 AS VARCHAR(4)) || 'C' || CAST(p_partkey AS VARCHAR(20)) AS cell",
        "(p_size + p_partkey % 3) % 7 AS edition", "(p_partkey + p_size) % 5 AS upd", "p_partkey % 23 = 0 OR p_partkey % 38 = 0 AS cancelled"], "p_partkey % 4 <> 1"),
    "extremes": ("orders", [
        "o_custkey AS station", "epoch_us(o_orderdate)/1e6 + o_orderkey % 86400 AS t", "o_orderkey AS ok"], None),
    "tags": ("part", [
        "p_partkey AS way",
        "CASE p_size % 9 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'residential' WHEN 3 THEN 'cycleway'"
        " WHEN 4 THEN 'footway' WHEN 5 THEN 'service' WHEN 6 THEN 'track' WHEN 7 THEN 'trunk' ELSE NULL END AS highway",
        "CASE p_partkey % 7 WHEN 0 THEN '30 mph' WHEN 1 THEN '50' WHEN 2 THEN 'walk' WHEN 3 THEN 'none' WHEN 4 THEN '400' WHEN 5 THEN '55 mph' ELSE NULL END AS maxspeed",
        "CASE p_partkey % 5 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' WHEN 2 THEN 'cobblestone' WHEN 3 THEN 'mud' ELSE NULL END AS surface",
        "CASE p_partkey % 11 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' ELSE NULL END AS oneway",
        "CASE p_partkey % 13 WHEN 0 THEN 'no' WHEN 1 THEN 'private' ELSE NULL END AS access",
        "CASE p_partkey % 6 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'designated' ELSE NULL END AS bicycle",
        "CASE p_partkey % 8 WHEN 0 THEN 'no' ELSE NULL END AS foot",
        "CASE p_partkey % 9 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE NULL END AS motor_vehicle",
        "CASE p_partkey % 29 WHEN 0 THEN 'ferry' ELSE NULL END AS route",
        "CASE p_partkey % 31 WHEN 0 THEN 'yes' ELSE NULL END AS area",
        "CASE p_partkey % 12 WHEN 0 THEN '2' WHEN 1 THEN '4;5' WHEN 2 THEN 'x' ELSE NULL END AS lanes",
        "CASE p_partkey % 10 WHEN 0 THEN '00:30' WHEN 1 THEN '01:10:05' WHEN 2 THEN '45' WHEN 3 THEN 'PT1H' ELSE NULL END AS duration"], None),
    "posts": ("orders", [
        "o_orderkey % 120 AS col", "o_orderkey // 120 AS row",
        "CASE WHEN ((o_orderkey // 120)*13 + o_orderkey % 120) % 97 = 0 THEN NULL ELSE"
        " (((o_orderkey // 120)*(o_orderkey // 120)*3 + (o_orderkey % 120)*7 + (o_orderkey // 120)*(o_orderkey % 120)) % 101)*5e0 END AS elev"], None),
}


def _spark_sql(text: str) -> str:
    return text.replace("//", "div").replace("epoch_us(ts)", "unix_micros(CAST(ts AS TIMESTAMP))").replace(
        "epoch_us(o_orderdate)", "unix_micros(CAST(o_orderdate AS TIMESTAMP))")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    src, exprs, where = DERIVED[name]
    df = table(spark, sf, src)
    if where:
        df = df.filter(_spark_sql(where))
    return df.selectExpr(*[_spark_sql(e) for e in exprs])


def rounded(value: Column, digits: int) -> Column:
    """Rounded as the checks round: the scaled double, half away from zero. ``round`` takes the decimal digits instead, so a value that ends in 5 may go the other way."""
    return F.round(value * F.lit(10.0 ** digits)) / F.lit(10.0 ** digits)


def with_ctes(*names: str, recursive: bool = False) -> str:
    """``WITH a AS (...), b AS (...)`` for DuckDB."""
    parts = []
    for n in names:
        src, exprs, where = DERIVED[n]
        parts.append(f"{n} AS (SELECT {', '.join(exprs)} FROM {src}" + (f" WHERE {where}" if where else "") + ")")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts)
