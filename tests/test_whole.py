"""Loops run to their end, inputs are taken whole, and null positions stay null."""
from __future__ import annotations

import itertools
import random

from pyspark.sql import functions as F

from geolattice.functions import geo
from geolattice.operators import charts, routing, search, spatial, terrain
from geolattice.operators.components import components
from geolattice.operators.ordered import fold
from geolattice.sources import vector


def test_a_fold_that_never_forgets_takes_all_its_rounds(spark):
    df = spark.range(60).select(F.lit(1).alias("k"), F.col("id").alias("seq"))

    def step(state, pdf):
        n = state[0]
        out = []
        for s in pdf.seq:
            n += 1
            out.append((1, int(s), n))
        import pandas as pd
        return (n,), pd.DataFrame(out, columns=["k", "seq", "n"])
    got = fold(df, ["k"], ["seq"], F.floor(F.col("seq") / 4), "n long", "k long, seq long, n long", step, lambda: (0,))
    assert sorted(r.n for r in got.collect()) == list(range(1, 61))


def test_components_of_a_long_chain(spark):
    order = list(range(500))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
    assert {r.label for r in components(edges).collect()} == {0} and components(edges).count() == 500


def test_duplicates_along_a_chain(spark):
    rows = [(i, "k", "T", 10.0, 20.0 + i * 0.0008, 10.0, 20.0 + i * 0.0008, 10.0, 20.0 + i * 0.0008) for i in range(30)]
    df = spark.createDataFrame(rows, "rank int, kind string, title string, lat double, lon double, s double, w double, n double, e double")
    assert sorted(r["rank"] for r in search.drop_duplicates(df, 100.0).collect()) == list(range(0, 30, 2))


def test_the_anchor_is_that_of_the_box_with_most_height_and_width(spark):
    rows = [(1, "a", 10.0, 20.0, 10.001, 20.0, 1.0, 1.0, 0, 0), (2, "a", 10.0, 20.0, 10.0008, 20.0008, 2.0, 2.0, 0, 0)]
    df = spark.createDataFrame(rows, "seq long, title string, s double, w double, n double, e double, anchor_lat double, anchor_lon double, quality int, rank int")
    assert [r.anchor_lat for r in search.merge_pieces(df, 100.0, ["title"]).collect()] == [2.0]


def test_a_view_over_500_posts_judges_every_post(spark):
    posts = spark.range(1201).select(F.lit(0).alias("row"), F.col("id").alias("col"), F.when(F.col("id") == 603, 500.0).otherwise(5.0).alias("elev"))
    ob = spark.createDataFrame([(1, 0, 600, 2.0, 600)], "id long, row long, col long, height_m double, steps int")
    rows = {r["col"]: r for r in terrain.viewshed(ob, posts, 90.0).collect()}
    assert sorted(rows) == list(range(1201))
    assert rows[603].vh_interp == 0 and rows[610].vh_interp > 400 and rows[590].vh_interp < 1      # the peak, which no second post meets, hides what lies behind


def test_long_routes_come_whole(spark):
    arcs = spark.createDataFrame([(i, i, i + 1, 1.0) for i in range(12)], "arc long, src long, dst long, w double")
    od = spark.createDataFrame([(1, 0, 3), (2, 1, 11), (3, 0, 0), (4, 5, 2)], "trip long, origin long, dest long")
    got = routing.routes(od, arcs, F.col("w")).collect()
    by = {t: sorted((r.back, r.arc) for r in got if r.trip == t) for t in (1, 2, 3, 4)}
    assert by[1] == [(0, 2), (1, 1), (2, 0)] and by[2] == [(k, 10 - k) for k in range(10)] and by[3] == [(0, None)] and by[4] == [(None, None)]


def test_null_positions_give_null(spark):
    r = spark.range(1).select(geo.sphere_m(F.lit(1.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(3.0)).alias("d"), geo.clamp_lat(F.lit(None).cast("double")).alias("c")).first()
    assert r.d is None and r.c is None


def test_geojson_documents_are_read_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "type": "FeatureCollection",\n "bbox": [1.0, 2.0, 3.0, 4.0],\n "features": [\n  {"type": "Feature", "id": 5, "properties": {"a": 1},\n   "geometry": {"type": "Point", "coordinates": [1, 2]}},\n  {"type": "Feature", "id": 6, "properties": {}, "geometry": null}\n ]\n}')
    (tmp_path / "b.json").write_text('{"type": "Point", "coordinates": [3, 4]}')
    (tmp_path / "c.json").write_text("[1, 2")
    (tmp_path / "d.json").write_text("1.0")
    assert sorted((r.fid is None, r.fid or 0) for r in vector.read_geojson(spark, str(tmp_path)).collect()) == [(False, 5), (False, 6), (True, 0)]
    assert sorted((r.file[-6:], r.error) for r in vector.bad_geojson(spark, str(tmp_path)).collect()) == [("c.json", "not_json"), ("d.json", "no_features")]


def test_cancelled_cells(spark):
    held = spark.createDataFrame([("a", 1, 0, False), ("b", 1, 0, True), ("c", 1, 0, True), ("d", 1, 0, False)], "cell string, edition int, upd int, cancelled boolean")
    cat = spark.createDataFrame([("a", 1, 1, False, ["x", "y"], 1), ("b", 1, 0, False, ["x"], 2), ("c", 1, 0, True, ["x"], 3), ("e", 1, 0, False, ["z"], 4)], "cell string, edition int, upd int, cancelled boolean, region array<string>, ord int")
    assert {r.cell: r.status for r in charts.compare_catalog(held, cat).collect()} == {"a": "new update", "b": "new edition", "d": "unlisted"}
    assert {r.region: (round(r.jaccard, 6), r.best) for r in charts.infer_region(held, cat).collect()} == {"x": (round(1 / 3, 6), False), "y": (0.5, True)}


def test_boxes_in_one_crowded_cell(spark):
    rng = random.Random(3)
    def boxes(n, tag):
        out = []
        for i in range(n):
            s, w = rng.random(), rng.random()
            out.append((i, s, w, s + 0.1 * rng.random(), w + 0.1 * rng.random()))
        return out, spark.createDataFrame(out, ", ".join(f"{tag}{c}" for c in ("i long", "s double", "w double", "n double", "e double")))
    (ra, a), (rb, b) = boxes(300, "a"), boxes(200, "b")
    got = {(r.ai, r.bi) for r in spatial.box_join(a, b, ("as", "aw", "an", "ae"), ("bs", "bw", "bn", "be"), 10.0).collect()}
    assert got == {(x[0], y[0]) for x, y in itertools.product(ra, rb) if x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4]}


def test_fill_and_contours_take_the_full_grid(spark):
    import numpy as np
    from geolattice import plans
    from geolattice.plans.terrain import posts
    sf = "/root/testdata/sf0.001"
    z = {(r.row, r["col"]): r.elev for r in posts(spark, sf).collect()}
    got = {r.node: r.elev for r in plans.QUERIES["W20_fill_nodes"](spark, sf).collect()}
    assert set(got) == {r * 120 + c for r, c in z}
    # what is filled solves the balance of every free post with its neighbours along rows and columns
    fixed = {p: e for p, e in z.items() if p[1] % 6 == 0 and e is not None}
    free = [p for p in z if p not in fixed]
    at = {p: i for i, p in enumerate(free)}
    a, b = np.zeros((len(free), len(free))), np.zeros(len(free))
    for p, i in at.items():
        r, c = p
        for q, length in (((r, c - 1), 10 + (c - 1) % 5), ((r, c + 1), 10 + c % 5), ((r - 1, c), 10 + (r - 1) % 5), ((r + 1, c), 10 + r % 5)):
            if q in z:
                a[i, i] += 1 / length
                if q in at:
                    a[i, at[q]] -= 1 / length
                else:
                    b[i] += fixed[q] / length
    want = np.linalg.solve(a, b)
    assert max(abs(got[r * 120 + c] - want[i]) for (r, c), i in at.items()) < 0.1
    lines = plans.QUERIES["R4_contour_lines"](spark, sf).groupBy("level").count().collect()
    segments = {r.level: r["segments"] for r in terrain.contour_segments(posts(spark, sf), interval=50.0).groupBy("level").agg(F.count("*").alias("segments")).collect()}
    assert len(segments) > 3 and {r.level: r["count"] for r in lines} == segments


def test_size_estimates_do_not_grow_from_round_to_round(spark):
    from geolattice.session import cut_lineage, discard
    d = cut_lineage(spark.range(20).select("id"))
    for _ in range(30):
        d, was = cut_lineage(d.join(d.select(F.col("id").alias("b")), F.col("id") == F.col("b")).select("id")), d
        discard(was)
    assert int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20
    assert d.count() == 20
