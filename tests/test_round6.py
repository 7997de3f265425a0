"""Findings of the third list, taken up again: searches end at their goals, crowds of boxes, states of turns."""
from __future__ import annotations

from pyspark.sql import functions as F


def test_a_search_ends_when_its_trips_cannot_become_cheaper(spark, monkeypatch):
    from geolattice.operators import arc_routes as ar
    # a street of 60 blocks, driven both ways; the trip goes three blocks
    arcs = spark.range(60).selectExpr("id", "explode(array(0, 1)) AS back").selectExpr(
        "id * 2 + back AS arc", "id AS edge", "id + back AS src", "id + 1 - back AS dst", "10D AS w",
        "array(named_struct('lat', (id + back) * 0.001D, 'lon', 0D), named_struct('lat', (id + 1 - back) * 0.001D, 'lon', 0D)) AS shape")
    trips = spark.createDataFrame([(1, None, 40, 0.5, None, 46, 0.5, None)], "trip long, from_node long, from_arc long, from_at double, to_node long, to_arc long, to_at double, heading double")
    labels = []
    steps = ar._steps
    monkeypatch.setattr(ar, "_steps", lambda t, b, l: labels.append(l) or steps(t, b, l))
    found, way = ar.arc_routes(trips, arcs, F.col("w"))
    assert [tuple(r) for r in found.collect()] == [(1, True, 30.0)]
    assert [r.arc for r in way.orderBy("n").collect()] == [40, 42, 44, 46]
    assert labels[0].count() <= 10


def test_only_arcs_of_a_restriction_have_states_of_their_own(spark):
    from geolattice.operators import routing as rt
    # 30 arcs from node 1 to node 2; one of them may not go on by arc 101
    rows = [(i, 1, 2, float(i)) for i in range(1, 31)] + [(101, 2, 3, 1.0), (102, 2, 4, 1.0)]
    arcs = spark.createDataFrame(rows, "arc long, src long, dst long, w double")
    res = spark.createDataFrame([(2, 1, 101, "no")], "via long, from_arc long, to_arc long, kind string")
    seeds = spark.createDataFrame([(1, 1)], "origin long, node long")
    st = rt.cost_distance(seeds, arcs, F.col("w"), res)
    assert {(r.node, r.in_arc): r.cost for r in st.collect()} == {(1, -1): 0.0, (2, 1): 1.0, (2, -1): 2.0, (3, -1): 3.0, (4, -1): 2.0}


def crowd(spark):
    """400 boxes within 30 m, one more 50 m off and one far away, all of one name."""
    d = spark.range(400).selectExpr("id AS seq", "32 + (id div 20) * 1e-5D AS s", "-80 + (id % 20) * 1e-5D AS w")
    d = d.union(spark.createDataFrame([(400, 32.0006, -80.0), (401, 32.1, -80.0)], "seq long, s double, w double"))
    return d.selectExpr("seq", "'a' AS title", "s", "w", "s + 1e-5D AS n", "w + 1e-5D AS e", "s AS anchor_lat", "w AS anchor_lon", "1 AS quality", "1 AS rank")


def test_a_crowd_of_boxes_is_merged_without_all_its_pairs(spark, monkeypatch):
    from geolattice.operators import search
    links = []
    whole = search.components
    monkeypatch.setattr(search, "components", lambda e: links.append(e.count()) or whole(e))
    got = search.merge_pieces(crowd(spark), 60.0, ["title"])
    assert {(r.seq, r.pieces) for r in got.collect()} == {(0, 401), (401, 1)}
    assert max(links) < 13 * 402


def test_edges_of_components_are_not_broadcast(spark, monkeypatch):
    from geolattice.operators import components as co
    plans = []
    cut = co.cut_lineage
    monkeypatch.setattr(co, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d))
    got = co.components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "u long, v long"))
    assert {(r.node, r.label) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_queries_and_words_meet_on_the_rarest_word(spark, tmp_path):
    from geolattice import plans
    spark.createDataFrame([(i, f"common words of document {i}") for i in range(20)] + [(20, "Common  phrases seldom"), (21, "common words and zebra crossing")],
                          "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "common zeb"), (2, "common phrases sel"), (3, "common nowhere"), (4, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = plans.QUERIES["F8_match_quality"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in d.collect()) == [(20, 2, 2), (21, 1, 2)]
    from geolattice.plans import features
    q = spark.createDataFrame([(1, "common zeb", ["common", "zeb"]), (3, "common nowhere", ["common", "nowhere"])], "item_id long, q string, qt array<string>")
    assert [(r.doc_id, r.item_id) for r in features.queries_met(q, spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("text", "c")).collect()] == [(21, 1)]


def test_the_column_of_longitude_180(spark):
    from geolattice.functions import sql
    sql.register(spark)
    assert tuple(spark.sql("SELECT tile_x(180D, 10), tile_x(180D, 10, false), tile_x(-180D, 10, false)").first()) == (1023, 1024, 0)
