"""Guidance in batch and on a stream against one pass per ride."""
from __future__ import annotations

import math
import random

import pytest

from geolattice.operators import guidance as gd
from geolattice.session import scratch
from geolattice.streaming import guidance as live

FIX = "ride long, seq long, t double, lat double, lon double, speed double"
LAT0, LON0 = 40.0, 10.0
KX = 111195.08023353292 * math.cos(math.radians(LAT0))


def at(x, y):
    return LAT0 + y / 111195.08023353292, LON0 + x / KX


def ell():
    """500 m east, then 500 m north."""
    return [at(0, 0), at(500, 0), at(500, 500)], [(0.0, "depart"), (500.0, "left"), (1000.0, "arrive")]


def run(route, corners, fixes):
    r, state, fired, out = live.Route(route, corners), live.START, set(), []
    for seq, t, lat, lon, speed in fixes:
        state, said = live.announce(r, state, fired, (t, lat, lon, speed))
        out += [(seq, *s) for s in said]
    return out


def east(x0, x1, v, t0=0.0):
    n = int((x1 - x0) / v)
    return [(i, t0 + i, *at(x0 + v * i, 0), v) for i in range(n + 1)]


def test_rings_are_times_between_two_distances():
    for v, far, near in ((7.0, 210, 56), (1.4, 100, 20), (30.0, 400, 80)):
        said = [s for s in run(*ell(), east(20, 499, v)) if s[1] == "approach"]
        assert [s[2] for s in said][:2] == ["heads_up", "act_now"]
        assert abs(said[0][5] - far) <= v + 1 and abs(said[1][5] - near) <= v + 1
    said = [s[2] for s in run(*ell(), east(100, 499, 7.0)) if s[1] == "approach"]
    assert said == ["heads_up", "act_now", "at"]
    assert [s[1:3] for s in run(*ell(), [(0, 0.0, *at(470, 0), 7.0)])] == [("approach", "act_now")]   # only the innermost


def test_leaving_lasts_and_rejoining_arms_again():
    fixes = east(250, 350, 10.0) + [(20 + i, 20.0 + i, *at(350, 60), 10.0) for i in range(8)] + [(40, 40.0, *at(340, 20), 10.0), (41, 41.0, *at(340, 5), 10.0)]
    said = run(*ell(), fixes)
    assert [(s[0], s[1], s[2]) for s in said] == [(0, "approach", "heads_up"), (25, "off_route", None), (41, "rejoined", None), (41, "approach", "heads_up")]


def test_arrival_is_said_once():
    up = [(i, float(i), *at(500, 10.0 * i), 10.0) for i in range(50)]
    said = run(*ell(), up)
    assert [s[1] for s in said].count("arrived") == 1 and said[-1][1] == "arrived"
    assert not [s for s in run(*ell(), [(0, 0.0, *at(400, 0), 0.0)]) if s[1] == "passed"]


def rides(seed, n=6, length=400):
    rng = random.Random(seed)
    points, corners, fixes = [], [], []
    for ride in range(n):
        if ride % 3 == 2:     # out and back on the same street
            route = [(0, 0), (600, 0), (0, 0)]
        else:
            route, x, y = [(0, 0)], 0, 0
            for k in range(rng.randint(3, 8)):
                step = rng.choice([40, 60, 200, 300])
                x, y = (x + step, y) if k % 2 == 0 else (x, y + step)
                route.append((x, y))
        long = [0.0]
        for a, b in zip(route, route[1:]):
            long.append(long[-1] + gd_sphere(a, b))
        points += [(ride, i, *at(*p)) for i, p in enumerate(route)]
        corners += [(ride, i, d, "depart" if i == 0 else "arrive" if i == len(long) - 1 else rng.choice(["left", "right"])) for i, d in enumerate(long)]
        along, t, off = 0.0, 1000.0, 0.0
        for seq in range(length):
            t += rng.choice([1.0, 1.0, 2.0])
            along = min(long[-1], max(0.0, along + rng.uniform(-1, 7)))
            if rng.random() < 0.02:
                along = max(0.0, along - 120)
            off = 0.0 if rng.random() < 0.05 else off
            off = rng.choice([0, 30, 90, 700]) if rng.random() < 0.03 else off
            j = max(i for i in range(len(long) - 1) if long[i] <= along + 1e-9)
            (x0, y0), (x1, y1) = route[j], route[j + 1]
            f = (along - long[j]) / (long[j + 1] - long[j])
            x, y = x0 + (x1 - x0) * f, y0 + (y1 - y0) * f
            fixes.append((ride, seq, t, *at(x + rng.uniform(-4, 4), y + off + rng.uniform(-4, 4)), rng.choice([None, rng.uniform(0, 9)])))
    return points, corners, fixes


def gd_sphere(a, b):
    return live._sphere_m(at(*a), at(*b))


def expected(points, corners, fixes):
    want = []
    for ride in sorted({f[0] for f in fixes}):
        route = [p[2:] for p in points if p[0] == ride]
        turns = [c[2:] for c in corners if c[0] == ride]
        want += [(ride, *x) for x in run(route, turns, [f[1:] for f in fixes if f[0] == ride])]
    return want


def rounded(rows):
    return sorted(((*r[:6], round(r[6], 3), r[7]) for r in rows), key=repr)


def same(got, want):
    got, want = rounded(got), rounded(want)
    assert [(*g[:6], g[7]) for g in got] == [(*w[:6], w[7]) for w in want]
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], abs=0.02)


def frames(spark, points, corners, fixes):
    return (spark.createDataFrame(fixes, FIX), spark.createDataFrame(points, "ride long, i long, lat double, lon double"),
            spark.createDataFrame(corners, "ride long, m int, at_m double, kind string"))


def test_batch_against_one_pass(spark):
    points, corners, fixes = rides(1)
    fx, pts, man = frames(spark, points, corners, fixes + [(99, 0, 1.0, 40.0, 10.0, 1.0)])     # a ride without a route
    want = expected(points, corners, fixes)
    assert {w[2] for w in want} == {"approach", "passed", "arrived", "off_route", "rejoined"}
    same([tuple(r) for r in gd.guidance(fx, pts, man, size=40).collect()], want)


def test_stream_equals_batch(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    points, corners, fixes = rides(2, n=3, length=150)
    _, pts, man = frames(spark, points, corners, fixes[:1])
    src, out = scratch(spark, "fixes"), scratch(spark, "said")
    # three files, each a time slice out of order, the last one far ahead so that the watermark passes all
    cuts = sorted({f[2] for f in fixes})
    third = len(cuts) // 3
    slices = [[f for f in fixes if lo <= f[2] < hi] for lo, hi in zip([0, cuts[third], cuts[2 * third]], [cuts[third], cuts[2 * third], 1e9])]
    late = (0, 9999, cuts[0], *at(0, 0), 5.0)     # long behind the watermark: dropped
    for k, rows in enumerate([*slices, [(77, 0, cuts[-1] + 600.0, 40.0, 10.0, 1.0), late], [(77, 1, cuts[-1] + 1300.0, 40.0, 10.0, 1.0)]]):
        random.Random(k).shuffle(rows)
        spark.createDataFrame(rows, FIX).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(FIX).option("maxFilesPerTrigger", 1).parquet(src)
    q = (live.guidance_stream(stream, pts, man, delay_s=10.0, forget_s=300.0).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", scratch(spark, "guidance")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    same([tuple(r) for r in spark.read.parquet(out).collect()], expected(points, corners, fixes))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 60     # what a silent ride kept is gone
