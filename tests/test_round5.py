"""Findings of the third list."""
from __future__ import annotations

from pyspark.sql import functions as F

FRAGMENT = "feed long, t double, seq long, tag string, f struct<talker:string, own:boolean, count:int, number:int, seq_id:string, channel:string, payload:string, fill:int>"


def test_fragment_after_its_message_is_an_orphan(spark):
    from geolattice.operators import feeds as fd

    def part(t, seq, number, text):
        return (1, t, seq, None, ("AI", False, 2, number, "3", "B", text, 0))
    rows = [part(0.0, 1, 1, "a"), part(1.0, 2, 1, "b"), part(2.0, 3, 1, "c"), part(3.0, 4, 2, "d"), part(4.0, 5, 2, "e"), part(20.0, 6, 1, "f"), part(20.0, 7, 2, "g"), part(20.0, 8, 2, "g"),
            part(90000.0, 9, 1, "h"), part(90001.0, 10, 2, "i")]
    out = fd.assemble(spark.createDataFrame(rows, FRAGMENT))
    got = {(r.outcome, r.seq, r.payload) for r in out.collect()}
    assert got == {("dropped", 1, None), ("dropped", 2, None), ("message", 4, "cd"), ("orphan", 5, None), ("message", 7, "fg"), ("orphan", 8, None), ("message", 10, "hi")}
    assert out.count() == 7


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_and_rings_are_not_broadcast(spark):
    from geolattice.operators import topology as tp
    # one square of four edges round face 2 in each tile
    e = spark.range(8).selectExpr("id div 4 AS tile", "id % 4 + 1 AS edge", "id % 4 + 1 AS start_node", "(id + 1) % 4 + 1 AS end_node", "1L AS left_face", "2L AS right_face", "(id + 3) % 4 + 1 AS left_edge", "(id + 1) % 4 + 1 AS right_edge")
    rings = spark.range(2).selectExpr("id AS tile", "2L AS face", "1L AS ring", "1L AS start_edge")
    coords = e.select("tile", "edge", F.explode(F.array(F.lit(0), F.lit(1))).alias("pos")).selectExpr("tile", "edge", "pos", "edge + pos + 0D AS lat", "0D AS lon")
    a = tp.area_points(spark.range(2).selectExpr("id AS feature", "id AS tile", "2L AS face"), e, rings, coords)
    assert "Broadcast" not in plan(a) and "Broadcast" not in plan(tp.sides(e)) and "Broadcast" not in plan(tp.ring_walk(e, rings)[0])
    assert "Broadcast" not in plan(tp.simple_features(e.selectExpr("edge AS feature", "tile", "edge AS prim"), coords.withColumnRenamed("edge", "prim")))
    assert [(r.feature, r.part, r.n) for r in a.orderBy("feature", "n").collect()] == [(f, 0, n) for f in (0, 1) for n in range(5)]


def test_cells_of_segments_are_not_broadcast(spark):
    from geolattice.operators import spatial as sp
    segs = spark.range(5).selectExpr("id AS seg", "30D AS alat", "10 + id*1e-4D AS alon", "30.01D AS blat", "10 + id*1e-4D AS blon")
    pts = spark.range(3).selectExpr("id AS pid", "30.005D AS lat", "10 + id*1e-4D AS lon")
    d = sp.segments_in_radius(pts, segs, 15.0)
    assert "Broadcast" not in plan(d)
    assert {(r.pid, r.seg) for r in d.collect()} == {(i, j) for i in range(3) for j in range(5) if abs(i - j) <= 1}


def test_turns_near_the_pole_take_the_bearings_of_their_legs(spark):
    import math
    from geolattice.operators import navigation as nav

    def bearing(a, b):
        (p, o), (q, r) = [(math.radians(x), math.radians(y)) for x, y in (a, b)]
        return math.degrees(math.atan2(math.sin(r - o) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(r - o)))
    lat0 = 89.9
    place = lambda x, y: (lat0 + y / 111195.0, 10 + x / (111195.0 * math.cos(math.radians(lat0))))
    pts = [place(*p) for p in ((0, 0), (100, 0), (100, 100), (200, 100), (200, 200))]
    route = spark.createDataFrame([(1, i, *p, f"R{i}") for i, p in enumerate(pts)], "track long, seq long, lat double, lon double, name string")
    got = {r.seq: r.turn_deg for r in nav.maneuvers(route, whole_legs=True).collect() if 0 < r.seq < 4}
    want = {i: (bearing(pts[i], pts[i + 1]) - bearing(pts[i - 1], pts[i]) + 180) % 360 - 180 for i in (1, 2, 3)}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_arcs_are_not_broadcast_to_twins_headings_and_restrictions(spark):
    from geolattice.operators import osm, routing as rt
    way = spark.range(1, 40).select(F.col("id").alias("way"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("id") * 2 + i).alias("refs"), F.create_map(F.lit("highway"), F.lit("primary")).alias("tags"))
    points = F.array(*[F.struct(F.col(a).cast("double").alias("lat"), F.lit(0.0).alias("lon")) for a in ("src", "dst")])
    arcs = spark.range(40).selectExpr("id AS arc", "id div 2 AS edge", "id div 2 AS way", "(id + id div 2) % 5 AS src", "(id + id div 2 + 1) % 5 AS dst").withColumn("shape", points)
    twins = osm.twin_arcs(arcs)
    seeds = spark.range(5).selectExpr("id AS origin", "id AS node", "10D AS heading")
    heads = rt.heading_penalty(seeds, arcs)
    member = lambda typ, ref, role: F.struct(F.lit(typ).alias("type"), ref.alias("ref"), F.lit(role).alias("role"))
    rel = way.select(F.col("way").alias("id"), F.create_map(F.lit("restriction"), F.lit("no_left_turn")).alias("tags"),
                     F.array(member("way", F.col("way"), "from"), member("node", F.col("way") % 5, "via"), member("way", F.col("way") + 1, "to")).alias("members"))
    pairs, counts = osm.turn_restrictions(rel, arcs)
    assert not [p for p in (twins, heads, pairs) if "Broadcast" in plan(p)]
    # the count has only one-row tables beside each other
    assert "BroadcastHashJoin" not in plan(counts)
    assert {r.arc: r.twin for r in twins.collect()} == {i: i ^ 1 for i in range(40)}
    assert heads.count() == 40 and counts.count() == 1
