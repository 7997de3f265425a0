"""Areas from edge topology: rings of faces walked by list ranking over the two sides of every edge.

Tables of sides, rings and coordinates meet in sort-merge joins by hint: their sizes are those of compressed files or are guessed, and both would send them through the driver.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, discard
from .ordered import Ordered


def simple_features(rows: DataFrame, primitives: DataFrame) -> DataFrame:
    """Point and line features: each class row (feature, tile, prim) with the coordinates (pos, lat, lon) of its tile's primitive. Rows without one are left out."""
    return rows.join(primitives.select("tile", "prim", "pos", "lat", "lon").hint("merge"), ["tile", "prim"]).select("feature", "pos", "lat", "lon")


def sides(edges: DataFrame) -> DataFrame:
    """Both sides of every edge with the side that follows it around its face: (tile, at, face, next, spur).

    Edges: tile, edge, start_node, end_node, left_face, right_face, left_edge, right_edge. A side is struct(edge, back): `back` is the left one, driven
    from end to start. The next edge is entered at the node this side ends in; where it could be entered both ways (a loop), the side that has the face counts.
    """
    def one(back: bool):
        a, b = ("left", "start") if back else ("right", "end")
        return edges.select("tile", F.struct("edge", F.lit(back).alias("back")).alias("at"), F.col(f"{a}_face").alias("face"), F.col(f"{b}_node").alias("_node"), F.col(f"{a}_edge").alias("_edge"),
                            (F.col("left_face") == F.col("right_face")).alias("spur"))
    to = edges.select("tile", F.col("edge").alias("_edge"), F.col("start_node").alias("_s"), F.col("end_node").alias("_e"), F.col("left_face").alias("_l"), F.col("right_face").alias("_r"))
    j = one(False).unionByName(one(True)).join(to.hint("merge"), ["tile", "_edge"], "left")
    loop = F.col("_s") == F.col("_e")
    back = F.when(loop & (F.col("_l") != F.col("_r")), F.col("face") == F.col("_l")).otherwise(F.col("_s") != F.col("_node"))
    return j.select("tile", "at", "face", F.when(F.col("_s").isNotNull(), F.struct(F.col("_edge").alias("edge"), back.alias("back"))).alias("next"), "spur")


def ring_walk(edges: DataFrame, rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sides of each ring in order, and the rings that do not close. Rings: tile, face, ring, start_edge.

    A ring starts on the side of its edge that has the face (the right one of an edge with the face on both sides). Each ring is cut before its start; every side
    then learns, by doubling pointers, how far the end is and which end it is: rounds grow with the logarithm of the longest ring. Chains that are
    no ring (they run out, or circle without a start) never learn an end, and are told by the number of sides there are.

    Returns (tile, face, ring, n, edge, back, body) and open rings (tile, face, ring, reason). ``body``: the ring has an area (not only edges with its face on both sides).
    """
    s = cut_lineage(sides(edges))
    e = edges.select("tile", F.col("edge").alias("start_edge"), "left_face", "right_face")
    r = rings.join(e.hint("merge"), ["tile", "start_edge"], "left")
    side = F.when(F.col("right_face") == F.col("face"), False).when(F.col("left_face") == F.col("face"), True)
    r = cut_lineage(r.select("tile", "face", "ring", F.when(side.isNotNull(), F.struct(F.col("start_edge").alias("edge"), side.alias("back"))).alias("start")))
    cut = r.filter("start is not null").select("tile", F.col("start").alias("next"), F.lit(True).alias("_cut")).distinct()
    p = s.join(cut.hint("merge"), ["tile", "next"], "left").select("tile", "at", F.when(F.col("_cut").isNull(), F.col("next")).alias("to"), F.lit(0).cast("long").alias("far"),
                                                     # where the ring is cut, the side ends it
                                                     F.when(F.col("_cut"), F.col("next")).alias("begin"))
    p = cut_lineage(p.withColumn("far", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long")))
    most, done = s.count(), 1
    while done <= most:
        ahead = p.select("tile", F.col("at").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("begin").alias("_begin"))
        q = p.filter("to is not null").join(ahead.hint("merge"), ["tile", "to"], "left").select("tile", "at", F.col("_to").alias("to"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.col("_begin").alias("begin"))
        new = cut_lineage(p.filter("to is null").select("tile", "at", "to", "far", "begin").unionByName(q))
        discard(p)
        p, done = new, 2 * done
        if p.filter("to is not null").isEmpty():
            break
    ended = p.filter("to is null and begin is not null").select("tile", "at", "far", "begin")
    on = r.filter("start is not null").join(ended.hint("merge"), (r.tile == ended.tile) & (F.col("start") == F.col("begin"))).select(r.tile, "face", "ring", "start", "at", "far")
    top = on.groupBy("tile", "face", "ring").agg(F.max("far").alias("_top"), F.count("*").alias("_n"), F.count_distinct("far").alias("_d"),
                                                 F.max(F.when(F.col("at") == F.col("start"), F.col("far"))).alias("_first"))
    whole = top.filter((F.col("_n") == F.col("_top") + 1) & (F.col("_d") == F.col("_n")) & (F.col("_first") == F.col("_top")))
    walked = on.join(whole.hint("merge"), ["tile", "face", "ring"]).join(s.select("tile", "at", "spur").hint("merge"), ["tile", "at"])
    body = walked.groupBy("tile", "face", "ring").agg(F.max(~F.col("spur")).alias("body"))
    out = walked.join(body.hint("merge"), ["tile", "face", "ring"]).select("tile", "face", "ring", (F.col("_top") - F.col("far")).alias("n"), "at.edge", "at.back", "body")
    broken = r.join(whole.select("tile", "face", "ring").hint("merge"), ["tile", "face", "ring"], "left_anti").select(
        "tile", "face", "ring", F.when(F.col("start").isNull(), "start edge does not bound the face").otherwise("ring does not close").alias("reason"))
    return out, broken


def area_points(features: DataFrame, edges: DataFrame, rings: DataFrame, coords: DataFrame) -> DataFrame:
    """Area features (feature, tile, face) as ring points (feature, part, n, lat, lon): part 0 is the outer ring, the others are its holes.

    Rings of a face in the order of ``ring``, the first one outer; rings without an area and rings that do not close are left out. ``coords``: tile, edge, pos, lat, lon along
    the edge. The point two edges share comes once, and the first point again at the end.
    """
    walked, _ = ring_walk(edges, rings)
    walked = cut_lineage(walked.filter("body"))
    kept = walked.select("tile", "face", "ring").distinct()
    part = Ordered(kept, ["tile", "face"], ["ring"], F.floor(F.col("ring") / 10000)).running(sums={"_nth": F.lit(1)}).result().select("tile", "face", "ring", (F.col("_nth") - 1).alias("part"))
    span = coords.groupBy("tile", "edge").agg(F.max("pos").alias("_last"), F.min("pos").alias("_pos0"))
    # an edge brings all its points but the one it begins with; the ring's first edge brings that one too
    p = walked.join(coords.hint("merge"), ["tile", "edge"]).join(span.hint("merge"), ["tile", "edge"])
    step = F.when(F.col("back"), F.col("_last") - F.col("pos")).otherwise(F.col("pos") - F.col("_pos0"))
    p = p.withColumn("step", step).filter("step > 0 or n = 0").select("tile", "face", "ring", "n", "step", "lat", "lon")
    o = Ordered(p, ["tile", "face", "ring"], ["n", "step"], F.floor(F.col("n") / 1000)).running(sums={"_at": F.lit(1)}).result()
    ring = o.join(part.hint("merge"), ["tile", "face", "ring"]).select("tile", "face", "part", (F.col("_at") - 1).alias("n"), "lat", "lon")
    return features.select("feature", "tile", "face").join(ring.hint("merge"), ["tile", "face"]).select("feature", "part", "n", "lat", "lon")
