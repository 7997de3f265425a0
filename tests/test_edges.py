"""Hand-made edge cases and brute-force checks of operators SQL cannot state."""
import random

import pytest
from pyspark.sql import functions as F

from geolattice.functions import geo, geodesy, tags, text, units, values
from geolattice.operators import features, search, terrain, tracks
from geolattice.operators.components import components


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_antimeridian(spark):
    assert one(spark, geo.normalize_lon(F.lit(-180.0))) == 180.0
    assert one(spark, geo.normalize_lon(F.lit(540.0))) == 180.0
    assert one(spark, geo.box_intersects((0.0, 170.0, 10.0, -170.0), (5.0, -175.0, 6.0, -174.0)))
    assert not one(spark, geo.box_intersects((0.0, 170.0, 10.0, -170.0), (5.0, -160.0, 6.0, -150.0)))
    assert one(spark, geo.box_encloses((-10.0, 170.0, 10.0, -170.0), (0.0, 175.0, 1.0, -175.0)))


def test_value_text(spark):
    assert one(spark, values.number_text(F.lit(7.0))) == "7"
    assert one(spark, values.number_text(F.lit(0.25))) == "0.25"
    assert one(spark, values.number_text(F.lit(float("nan")))) == "NaN"
    assert one(spark, values.ieee_div(F.lit(1.0), F.lit(0.0))) == float("inf")


def test_exact_decimal_text(spark):
    for v in (35.65, 0.125, 2.5, 1234.05, 0.045):
        for p in (0, 1, 2):
            assert one(spark, units.fixed(F.lit(v), p)) == f"{v:.{p}f}"


def test_clause_errors(spark):
    df = spark.createDataFrame([(1, "a", 2)], "id long, name string, size int")
    with pytest.raises(features.ClauseError, match=r"clause \[1\]"):
        features.select_where(df, [("name", "=", "a"), ("size", "<", "x")])
    with pytest.raises(features.ClauseError, match="unknown_field"):
        features.select_where(df, [("nope", "=", "a")])


def test_match_quality(spark):
    for q, c, want in (("", "x", 0), ("Ruddy ", "ruddy", 0), ("rud", "Ruddy Duck", 1), ("du ru", "Ruddy Duck", 2), ("duck goose", "Ruddy Duck", -1)):
        assert one(spark, text.match_quality(F.lit(q), F.lit(c))) == want


def test_tags(spark):
    assert one(spark, tags.maxspeed_kph(F.lit("RU:urban"))) == 0
    assert one(spark, tags.maxspeed_kph(F.lit("55 mph"))) == 89
    assert one(spark, tags.duration_s(F.lit("0:12.5"))) == 750
    assert one(spark, tags.duration_s(F.lit("1:"))) == 0


def test_vincenty_round_trip():
    la, lo = geodesy.direct([32.0], [-80.0], [123456.0], [77.0])
    r, b = geodesy.inverse([32.0], [-80.0], la, lo)
    assert abs(r[0] - 123456.0) < 1e-3 and abs(b[0] - 77.0) < 1e-6
    assert abs(geodesy.inverse_m(32.0, -80.0, la[0], lo[0]) - r[0]) < 1e-6


def fixes(spark, rows):
    return spark.createDataFrame(rows, "track long, seq long, t double, lat double, lon double, speed double")


def test_chunk_size_does_not_change_results(spark):
    rnd = random.Random(3)
    rows = [(k % 2, i, None if rnd.random() < 0.1 else float(rnd.randrange(400)), 32 + rnd.random() / 1e4, -80 + rnd.random() / 1e4, None if i % 3 else 1.0 * i) for k in range(2) for i in range(60)]
    df = fixes(spark, rows)
    for job in (tracks.drop_non_monotonic, tracks.replayable, lambda d, s: tracks.split_at_gaps(d, 50.0, s), lambda d, s: tracks.trip(d, 5.0, 30.0, s)):
        small, whole = [sorted(map(str, job(df, size).collect())) for size in (7, 100000)]
        assert small == whole


def test_monotonic_brute_force(spark):
    ts = [5.0, 3.0, None, 4.0, 4.0, 6.0, None, 1.0]
    kept = [r.seq for r in tracks.drop_non_monotonic(fixes(spark, [(1, i, t, 0.0, 0.0, None) for i, t in enumerate(ts)]), 3).orderBy("seq").collect()]
    want, last = [], None
    for i, t in enumerate(ts):
        if last is not None and t is not None and t <= last:
            continue
        want.append(i)
        last = t
    assert kept == want


def test_components_brute_force(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in nodes}


def test_merge_bridging_piece(spark):
    step = 0.0005
    rows = [(i, "A", 0.0, x, step, x + step, 0.0, x, 1, i) for i, x in enumerate((0.0, 0.002, 0.001))] + [(9, "B", 0.0, 0.0, step, step, 0.0, 0.0, 1, 9)]
    df = spark.createDataFrame(rows, "seq long, title string, s double, w double, n double, e double, anchor_lat double, anchor_lon double, quality int, rank int")
    out = {r.seq: r.pieces for r in search.merge_pieces(df, 60.0, ["title"]).collect()}
    assert out == {0: 3, 9: 1}


def test_duplicate_rows_keep_first_of_chain(spark):
    """b repeats a, c repeats b but not a: c stays, because b was dropped."""
    rows = [(i, "k", "Name", 0.0, x, 0.0, x, 0.0, x) for i, x in enumerate((0.0, 0.0009, 0.0018))]
    df = spark.createDataFrame(rows, "rank long, kind string, title string, lat double, lon double, s double, w double, n double, e double")
    assert sorted(r["rank"] for r in search.drop_duplicates(df, 110.0).collect()) == [0, 2]


def test_contour_line_order(spark):
    posts = spark.createDataFrame([(r, c, 10.0 if 2 <= r <= 4 and 2 <= c <= 4 else 0.0) for r in range(7) for c in range(7)], "row long, col long, elev double")
    rows = terrain.contour_lines(terrain.contour_segments(posts, levels=[5.0])).orderBy("seq").collect()
    assert rows and all(r.closed for r in rows)
    assert [r.seq for r in rows] == list(range(len(rows)))
    assert all(a.to_node == b.from_node for a, b in zip(rows, rows[1:])) and rows[-1].to_node == rows[0].from_node


def test_climb_hysteresis(spark):
    prof = F.array(*[F.lit(float(v)) for v in (0, 1, 2, 4, 3, 9, 8, 7)])
    c = one(spark, terrain.climb_descent(prof, 3.0))
    assert (c.climb, c.descent) == (9.0, 2.0)


def test_viewshed_flat_ground_is_visible(spark):
    posts = spark.createDataFrame([(r, c, 100.0) for r in range(21) for c in range(21)], "row long, col long, elev double")
    obs = spark.createDataFrame([(1, 10, 10, 5.0, 8)], "id long, row long, col long, height_m double, steps int")
    v = terrain.viewshed(obs, posts, 90.0)
    assert v.count() == 17 * 17 and v.agg(F.max("vh_max")).first()[0] < 0.05


def test_map_matching_radius_and_confidence(spark):
    from geolattice.operators import navigation
    m = 1 / 111195.08023353292
    segs = spark.createDataFrame([(1, 1, 2, 0.0, 0.0, 0.0, 0.01), (2, 3, 4, 20 * m, 0.0, 20 * m, 0.01)], "seg long, u long, v long, alat double, alon double, blat double, blon double")
    rows = [(1, 0, 4 * m, 0.002, 5.0, 8.0), (1, 1, 4 * m, 0.003, 5.0, 1.0), (1, 2, 40 * m, 0.004, 5.0, 3.0), (1, 3, -40 * m, 0.004, 5.0, 12.0), (2, 0, -20 * m, 0.005, None, None), (3, 0, 8 * m, 0.002, 5.0, 4.0), (3, 1, 12 * m, 0.002, 0.2, 4.0)]
    fixes = spark.createDataFrame(rows, "track long, seq long, lat double, lon double, speed double, hdop double")
    got = {(r.track, r.seq): r for r in navigation.match_tracks(fixes, segs).collect()}
    first = got[1, 0]      # 40 m: both roads in range, 4 and 16 m away
    assert (first.seg, first.candidates) == (1, 2) and first.confidence == pytest.approx(0.9, abs=1e-6)
    assert got[1, 1].seg == 1 and got[1, 1].candidates == 1 and got[1, 1].confidence == pytest.approx(1 - 4 / 15, abs=1e-6)      # never under 15 m
    assert got[1, 2].seg is None and got[1, 2].candidates == 0
    assert got[1, 3].seg == 1 and got[1, 3].confidence == pytest.approx(1 - 40 / 60, abs=1e-6)
    assert got[2, 0].seg == 1 and got[2, 0].confidence == pytest.approx(1 - 20 / 25, abs=1e-6)
    assert got[3, 0].confidence == pytest.approx((1 - 8 / 20) * (0.5 + 0.5 * 0.4), abs=1e-6)
    assert got[3, 1].seg == 1 and got[3, 1].held and got[3, 1].confidence == pytest.approx(1 - 12 / 20, abs=1e-6)
