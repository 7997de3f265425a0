"""Tables whose rows come out of exploded lists are not sent through the driver, however small their estimates are."""
import pytest
from pyspark.sql import functions as F

from geolattice.operators import environment as env, osm, terrain as te


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def street(spark):
    ways = spark.range(1, 40).select(F.col("id").alias("way"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("id") * 2 + i).alias("refs"),
                                     F.create_map(F.lit("highway"), F.lit("primary")).alias("tags"))
    nodes = spark.range(2, 84).select(F.col("id").alias("node"), (32 + F.col("id") * 0.001).alias("lat"), F.lit(-80.0).alias("lon"))
    return osm.kept_ways(ways), nodes


def test_road_graph_is_not_broadcast(street):
    ways, nodes = street
    arcs = osm.build_arcs(osm.build_edges(ways, nodes), ways)
    assert "Broadcast" not in plan(arcs)
    assert arcs.count() == 2 * osm.build_edges(ways, nodes).count() > 0


def test_signals_are_not_broadcast(street):
    ways, nodes = street
    arcs = osm.build_arcs(osm.build_edges(ways, nodes), ways)
    assert "Broadcast" not in plan(osm.signal_arcs(arcs, nodes.select("node")))


def test_samples_of_a_profile_are_not_broadcast(spark):
    points = spark.range(4).select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("part"), "id").select(
        F.struct("id", "part").alias("id"), (F.col("part") * 0.001 + 30.0005).alias("lat"), F.lit(-79.9995).alias("lon"), F.col("id").alias("track"), F.col("part").alias("seq"))
    posts = spark.range(100).select((F.col("id") % 10).alias("row"), F.floor(F.col("id") / 10).alias("col"), F.lit(5.0).alias("elev"))
    e = te.bilinear(points, posts, 30.0, -80.0, 0.001)
    s = te.profile_summary(e.select("track", "seq", "elev"), ["track"])
    assert "BroadcastHashJoin [row" not in plan(s) and "BroadcastHashJoin [id" not in plan(s) and "_chunk" not in "".join(x for x in plan(s).split("\n") if "BroadcastHashJoin" in x)
    assert {r["samples"] for r in s.collect()} == {5}


def test_hours_of_a_stretch_are_not_broadcast(spark):
    stretches = spark.range(1, 2).selectExpr("id", "id AS station", "3600D AS enter", "7200D AS exit")
    extremes = spark.range(3).selectExpr("1L AS station", "id * 20000D AS t", "id = 1 AS high", "if(id = 1, 2D, 0.1D) AS height", "id AS ok")
    v = env.beach_verdicts(stretches, extremes, 0.9, 1.6, 600.0)
    assert not [x for x in plan(v).split("\n") if "BroadcastHashJoin" in x and ("_hour" in x or "[id" in x)]
    assert [r["verdict"] for r in v.collect()] == ["good"]
