"""Tile tables: extents, subsets, cache upkeep and adaptive splitting."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import geo, tiles


def from_tms(df: DataFrame) -> DataFrame:
    """TMS rows to top-down rows."""
    return df.withColumn("y", tiles.tms_row(F.col("tile_row"), F.col("z"))).drop("tile_row")


def zoom_extent(t: DataFrame) -> DataFrame:
    return t.groupBy("z").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"),
                              F.max("y").alias("max_y"), F.count("*").alias("tiles"))


def pack_bounds(t: DataFrame) -> DataFrame:
    """Metadata row: box, centre and zooms, measured on the deepest zoom."""
    per = zoom_extent(t)
    a = per.agg(F.min("z").alias("minzoom"), F.max("z").alias("maxzoom"), F.max_by(F.struct("min_x", "max_x", "min_y", "max_y"), "z").alias("m"))
    z = F.col("maxzoom")
    lo, hi = tiles.tile_bounds(F.col("m.min_x"), F.col("m.max_y"), z), tiles.tile_bounds(F.col("m.max_x"), F.col("m.min_y"), z)
    return a.select("minzoom", "maxzoom", lo.s.alias("s"), lo.w.alias("w"), hi.n.alias("n"), hi.e.alias("e"))


def cut(t: DataFrame, box: tuple, z_min: int, z_max: int) -> DataFrame:
    """Tiles touching the box at every kept zoom; one literal range per zoom, so partitions on z prune."""
    s, w, n, e = box
    halves = [(w, 180.0), (-180.0, e)] if w > e else [(w, e)]
    conds = []
    for z in range(z_min, z_max + 1):
        for west, east in halves:
            conds.append((F.col("z") == z) & F.col("x").between(tiles.tile_x(F.lit(west), F.lit(z)), tiles.tile_x(F.lit(east), F.lit(z)))
                         & F.col("y").between(tiles.tile_y(F.lit(n), F.lit(z)), tiles.tile_y(F.lit(s), F.lit(z))))
    return t.filter(reduce(lambda a, b: a | b, conds))


def dropped_features(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Features no tile lists any more after the fresh tiles replaced their old lists."""
    kept = old.join(fresh.select("z", "x", "y").distinct(), ["z", "x", "y"], "left_anti")
    alive = kept.select("fid").union(fresh.select("fid")).distinct()
    return old.select("fid").distinct().join(alive, "fid", "left_anti")


def resolve(state: DataFrame, wanted: DataFrame, now: int, stale_after: int, retry_after: int) -> DataFrame:
    """How each wanted tile is answered: by itself or its nearest complete ancestor, stale, waiting or missing."""
    up = wanted.select("z", "x", "y", F.explode(F.sequence(F.lit(0), F.col("z"))).alias("d"))
    up = up.select("z", "x", "y", "d", (F.col("z") - F.col("d")).alias("az"), F.floor(F.col("x") / F.pow(F.lit(2.0), "d")).cast("int").alias("ax"),
                   F.floor(F.col("y") / F.pow(F.lit(2.0), "d")).cast("int").alias("ay"))
    s = state.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"), "fetched_at", "failed")
    j = up.join(s, ["az", "ax", "ay"])
    per = j.groupBy("z", "x", "y").agg(F.min(F.when(~F.col("failed"), F.struct("d", "fetched_at"))).alias("hit"),
                                       F.max(F.when(F.col("failed") & (F.col("d") == 0), F.col("fetched_at"))).alias("failed_at"))
    out = wanted.join(per, ["z", "x", "y"], "left")
    answer = (F.when(F.col("hit.fetched_at") >= now - stale_after, "answered").when(F.col("hit").isNotNull(), "refresh")
              .when(F.col("failed_at") > now - retry_after, "waiting").otherwise("fetch"))
    return out.select("z", "x", "y", (F.col("z") - F.col("hit.d")).alias("answer_z"), answer.alias("action"))


def store(state: DataFrame, done: DataFrame) -> DataFrame:
    """Cache state after complete tiles arrive: records inside a stored tile give way to it."""
    keys = done.select(F.col("z").alias("_z"), F.col("x").alias("_x"), F.col("y").alias("_y")).distinct()
    up = state.select("*", F.explode(F.sequence(F.lit(0), F.col("z"))).alias("_d")).select(
        "*", (F.col("z") - F.col("_d")).alias("_z"), F.floor(F.col("x") / F.pow(F.lit(2.0), "_d")).cast("int").alias("_x"),
        F.floor(F.col("y") / F.pow(F.lit(2.0), "_d")).cast("int").alias("_y"))
    inside = up.join(keys, ["_z", "_x", "_y"], "left_semi").select("z", "x", "y").distinct()
    return state.join(inside, ["z", "x", "y"], "left_anti").unionByName(done)


def to_refresh(state: DataFrame, now: int, stale_after: int, retry_after: int) -> DataFrame:
    """Tiles to fetch again: stale ones, and failures past their retry time."""
    reason = F.when(F.col("failed") & (F.col("fetched_at") <= now - retry_after), "retry").when(
        ~F.col("failed") & (F.col("fetched_at") < now - stale_after), "stale")
    return state.select("z", "x", "y", reason.alias("reason")).filter(F.col("reason").isNotNull())


def adaptive_tiles(points: DataFrame, limit: int, z_min: int, z_max: int) -> DataFrame:
    """Tiles of at most ``limit`` points: a fuller tile splits until the deepest zoom.

    Counts at every zoom come from one pass at the deepest zoom (pre-aggregated) rolled upwards, so a
    crowded place costs one row per occupied deepest tile.
    """
    deep = points.groupBy(tiles.tile_x(F.col("lon"), F.lit(z_max)).alias("dx"), tiles.tile_y(F.col("lat"), F.lit(z_max)).alias("dy")).agg(F.count("*").alias("c"))
    lv = deep.withColumn("z", F.explode(F.sequence(F.lit(z_min), F.lit(z_max))))

    div = F.pow(F.lit(2.0), F.lit(z_max) - F.col("z"))
    counts = lv.groupBy("z", F.floor(F.col("dx") / div).cast("int").alias("x"), F.floor(F.col("dy") / div).cast("int").alias("y")).agg(F.sum("c").alias("n"))
    parent = counts.select((F.col("z") + 1).alias("z"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("n").alias("pn"))
    j = counts.withColumn("px", tiles.parent(F.col("x"))).withColumn("py", tiles.parent(F.col("y"))).join(parent, ["z", "px", "py"], "left")
    # counts only shrink downwards, so a tile exists exactly when its parent is too full
    made = (F.col("z") == z_min) | (F.col("pn") > limit)
    fits = (F.col("n") <= limit) | (F.col("z") == z_max)
    return j.filter(made & fits).select("z", "x", "y", "n")


def completeness(members: DataFrame, cap: int) -> DataFrame:
    per = members.select("z", "x", "y", "fid").distinct().groupBy("z", "x", "y").agg(F.count("*").alias("f"))
    return per.agg(F.count("*").alias("tiles"), F.sum("f").alias("features"), F.max(F.col("f") >= cap).alias("capped"))
