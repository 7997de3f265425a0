"""Faults found in the eighth round."""
from __future__ import annotations

from pyspark.sql import functions as F


def test_features_of_many_files_are_numbered(spark):
    from geolattice.sources import vector
    d = spark.range(2200).selectExpr("concat('f', lpad(id, 5, '0')) AS file", "0 AS pos", "cast(null as bigint) AS fid", "id")
    got = vector.assign_ids(d.withColumnRenamed("id", "row"))
    assert got.filter("id <> row + 1").count() == 0 and got.count() == 2200


def test_a_fix_takes_the_first_time_of_its_group(spark, tmp_path):
    import duckdb
    from compare import compare
    from geolattice import plans
    # two days apart at nearly the same time of day: one group, once closed by another and once the last
    rows = [(1, 1, "2024-01-01 10:00:00.100"), (2, 1, "2024-01-03 10:00:00.130"), (3, 1, "2024-01-04 11:00:00"), (4, 2, "2024-01-01 10:00:00.200"), (5, 2, "2024-01-02 10:00:00.210")]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame(rows, "event_id long, user_id long, ts string").selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "'view' AS event_type", "1D AS value").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    name = "T4_assemble_fixes"
    assert compare(spark, con, str(tmp_path), name, plans.QUERIES[name], plans.ORACLES[name]) == (3, "")


def test_a_turn_after_a_first_leg_without_length(spark, tmp_path):
    import duckdb
    from compare import compare
    from geolattice import plans
    # these users ride at latitudes 990 and 1170, where the first leg runs along the pole
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame([(1, 48000), (2, 57000), (3, 20)], "event_id long, user_id long").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    name = "W15_junction_turns"
    n, fault = compare(spark, con, str(tmp_path), name, plans.QUERIES[name], plans.ORACLES[name])
    assert n > 20 and fault == ""


def test_rides_along_a_pole_and_over_the_antimeridian(spark, tmp_path):
    import duckdb
    from compare import compare
    from geolattice import plans
    from geolattice.operators import guidance as gd
    # latitudes 89.98, 90, 150 and 1170
    path = f"{tmp_path}/events.parquet"
    spark.range(160).selectExpr("id AS event_id", "element_at(array(2999L, 3000L, 6000L, 57000L), cast(id % 4 + 1 AS int)) AS user_id").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/*.parquet')")
    name = "T13_guidance"
    n, fault = compare(spark, con, str(tmp_path), name, plans.QUERIES[name], plans.ORACLES[name])
    assert n > 20 and fault == ""
    # one leg west of the line, one over it, one east of it
    pts = spark.createDataFrame([(1, 0, 10.0, 179.998), (1, 1, 10.0, 179.9995), (1, 2, 10.0, -179.9995), (1, 3, 10.0, -179.998)], "ride long, i long, lat double, lon double")
    fix = spark.createDataFrame([(1, k, 10.00001, lon) for k, lon in enumerate([179.999, 179.9999, -179.9999, -179.999])], "ride long, seq long, lat double, lon double")
    got = gd.on_route_places(fix, gd.route_segments(pts)).groupBy("seq").agg(F.min(F.struct("cross", "i")).alias("m")).collect()
    assert sorted((r.seq, r.m.i, round(r.m.cross, 1)) for r in got) == [(0, 0, 1.1), (1, 1, 1.1), (2, 1, 1.1), (3, 2, 1.1)]


def test_routes_of_any_cost_are_found(spark, duck):
    from compare import compare
    from geolattice import plans
    name, sf = "G4_G6_arc_ends", "/root/testdata/sf0.001"
    assert compare(spark, duck, sf, name, plans.QUERIES[name], plans.ORACLES[name]) == (130, "")
    assert max(r.cost or 0 for r in plans.QUERIES[name](spark, sf).collect()) > 300


def test_a_search_without_a_limit_ends_when_an_end_is_cut_off(spark, monkeypatch):
    from geolattice.operators import arc_routes as ar
    # a street of 20 blocks, and one that only leads into it
    arcs = spark.range(20).selectExpr("id * 2 AS arc", "id AS edge", "id AS src", "id + 1 AS dst").union(spark.createDataFrame([(500, 500, 900, 5), (501, 501, 901, 900)], "arc long, edge long, src long, dst long"))
    arcs = arcs.selectExpr("*", "10D AS w", "array(named_struct('lat', src * 0.001D, 'lon', 0D), named_struct('lat', dst * 0.001D, 'lon', 0D)) AS shape")
    trips = spark.createDataFrame([(1, None, 0, 0.5, None, 500, 0.5, None), (2, None, 4, 0.5, None, 30, 0.5, None)], "trip long, from_node long, from_arc long, from_at double, to_node long, to_arc long, to_at double, heading double")
    labels, steps = [], ar._steps
    monkeypatch.setattr(ar, "_steps", lambda t, b, l: labels.append(l) or steps(t, b, l))
    found, _ = ar.arc_routes(trips, arcs, F.col("w"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, False, None), (2, True, 130.0)]
    assert labels[0].filter("origin.from_arc = 0").count() <= 10
