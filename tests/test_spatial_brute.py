"""Spatial helpers against brute force, with every grid level and the salted path forced on."""
import math
import random

from geolattice.functions.geo import M_PER_DEG
from geolattice.operators import search, spatial


def plane(a, b, c, d):
    return math.hypot((d - b) * M_PER_DEG * math.cos(math.radians(a)), (c - a) * M_PER_DEG)


def points(n, seed, spread=0.01):
    r = random.Random(seed)
    # half of the points crowd into one spot
    return [(i, 32.6 + r.random() * (spread if i % 2 else spread / 200), -80.0 + r.random() * (spread if i % 2 else spread / 200)) for i in range(n)]


def test_nearest_all_levels(spark):
    p, q = points(150, 1), points(120, 2)
    got = {r.pid: (r.tid, r.distance_m) for r in spatial.nearest(spark.createDataFrame(p, "pid long, a double, o double"), spark.createDataFrame(q, "tid long, ta double, to double"),
                                                                "pid", "a", "o", "tid", "ta", "to", 300.0, levels=6).collect()}
    for i, a, o in p:
        best = min((round(plane(a, o, c, d), 6), t) for t, c, d in q)
        assert (i in got) == (best[0] <= 300.0)
        if i in got:
            assert got[i][0] == best[1] and abs(got[i][1] - best[0]) < 1e-5


def test_nearest_segment_all_levels(spark):
    p, q = points(80, 3), points(60, 4)
    segs = [(i, q[i][1], q[i][2], q[i + 1][1], q[i + 1][2]) for i in range(59)]

    def dist(a, o, s):
        mx = M_PER_DEG * math.cos(math.radians(a))
        ax, ay, bx, by = (s[2] - o) * mx, (s[1] - a) * M_PER_DEG, (s[4] - o) * mx, (s[3] - a) * M_PER_DEG
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
        return math.hypot(ax + t * dx, ay + t * dy)
    for levels in (0, 4):
        got = {r.pid: (r.seg, r.distance_m) for r in spatial.nearest_segment(spark.createDataFrame(p, "pid long, lat double, lon double"), spark.createDataFrame(
            segs, "seg long, alat double, alon double, blat double, blon double"), 120.0, levels=levels).collect()}
        for i, a, o in p:
            best = min((round(dist(a, o, s), 6), s[0]) for s in segs)
            assert (i in got) == (best[0] <= 120.0)
            if i in got:
                assert got[i][0] == best[1]


def test_merge_pieces_brute_force(spark):
    r = random.Random(9)
    rows = []
    for i in range(120):
        s, w = r.random() * 0.01, r.random() * 0.01
        rows.append((i, f"T{i % 2}", s, w, s + r.random() * 0.0008, w + r.random() * 0.0008, s, w, i % 5, i % 7))

    def gap(a, b):
        dy = max(a[0] - b[2], b[0] - a[2], 0.0)
        dx = max(a[1] - b[3], b[1] - a[3], 0.0)
        return math.hypot(dy, dx) * M_PER_DEG
    want = []
    for t in ("T0", "T1"):
        boxes = [[x[2], x[3], x[4], x[5], x[0], 1] for x in rows if x[1] == t]
        again = True
        while again:
            again = False
            for i in range(len(boxes)):
                for j in range(i + 1, len(boxes)):
                    if gap(boxes[i], boxes[j]) <= 50.0:
                        a, b = boxes[i], boxes.pop(j)
                        boxes[i] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), min(a[4], b[4]), a[5] + b[5]]
                        again = True
                        break
                if again:
                    break
        want += [(b[4], b[5]) for b in boxes]
    df = spark.createDataFrame(rows, "seq long, title string, s double, w double, n double, e double, anchor_lat double, anchor_lon double, quality int, rank int")
    got = [(x.seq, x.pieces) for x in search.merge_pieces(df, 50.0, ["title"]).collect()]
    assert sorted(got) == sorted(want)
