"""Area walk against a walk edge by edge."""
from __future__ import annotations

import random

from geolattice.operators import topology

EDGE = "tile long, edge long, start_node long, end_node long, left_face long, right_face long, left_edge long, right_edge long"


def walk(edges, tile, face, start):
    """Sides of a ring one after the other, or None where it does not close."""
    e = {x[1]: x for x in edges if x[0] == tile}
    if start not in e or face not in (e[start][4], e[start][5]):
        return None
    at = (start, e[start][5] != face)
    first, out = at, []
    while True:
        out.append(at)
        edge, back = at
        node, nxt = (e[edge][2], e[edge][6]) if back else (e[edge][3], e[edge][7])
        if nxt not in e:
            return None
        x = e[nxt]
        at = (nxt, face == x[4] if x[2] == x[3] and x[4] != x[5] else x[2] != node)
        if at == first:
            return out
        if at in out:
            return None


def planar(tile, size, holes, spur, scale=1.0):
    """A grid of size x size faces (1 is the outside), with squares inside some of them and one loose end; (edges, rings, coords)."""
    g, edges, coords, rings = size, [], {}, []
    h = lambda r, c: 1 + r * g + c
    v = lambda r, c: 1 + (g + 1) * g + r * (g + 1) + c
    node = lambda r, c: 1 + r * (g + 1) + c
    face = lambda r, c: 2 + r * g + c if 0 <= r < g and 0 <= c < g else 1
    at = lambda r, c: (float(r), float(c))
    for r in range(g + 1):
        for c in range(g):
            left = v(r, c) if r < g else (h(g, c - 1) if c else v(g - 1, 0))
            right = v(r - 1, c + 1) if r else (h(0, c + 1) if c < g - 1 else v(0, g))
            edges.append([tile, h(r, c), node(r, c), node(r, c + 1), face(r, c), face(r - 1, c), left, right])
            coords[h(r, c)] = [at(r, c), at(r, c + 0.5), at(r, c + 1)]
    for r in range(g):
        for c in range(g + 1):
            left = h(r, c - 1) if c else (v(r - 1, 0) if r else h(0, 0))
            right = h(r + 1, c) if c < g else (v(r + 1, g) if r < g - 1 else h(g, g - 1))
            edges.append([tile, v(r, c), node(r, c), node(r + 1, c), face(r, c - 1), face(r, c), left, right])
            coords[v(r, c)] = [at(r, c), at(r + 1, c)]
    rings += [(tile, face(r, c), 1, h(r, c)) for r in range(g) for c in range(g)] + [(tile, 1, 1, h(0, 0))]
    e, n, f = 1000, 5000, 9000
    for k, (r, c) in enumerate(holes):
        y, x = r + 0.1 + 0.3 * (k % 3), c + 0.1 + 0.3 * (k % 3)
        p = [(y, x), (y, x + 0.2), (y + 0.2, x + 0.2), (y + 0.2, x)]      # counter-clockwise: the square on the left
        for j in range(4):
            edges.append([tile, e + j, n + j, n + (j + 1) % 4, f, face(r, c), e + (j - 1) % 4, e + (j + 1) % 4])
            coords[e + j] = [p[j], p[(j + 1) % 4]]
        rings += [(tile, f, 1, e), (tile, face(r, c), 2 + k, e)]
        e, n, f = e + 10, n + 10, f + 1
    if spur:      # into face (0, 0) from node (0, 0): after h(0, 0) is driven back, in along the spur, out again, then v(0, 0)
        s = 3000
        edges.append([tile, s, node(0, 0), 7000, face(0, 0), face(0, 0), v(0, 0), s])
        coords[s] = [at(0, 0), (0.05, 0.05)]
        next(x for x in edges if x[1] == h(0, 0))[6] = s
    # a loop of one edge inside face (0, 0) and a bare line
    edges.append([tile, 3100, 7100, 7100, 9900, face(0, 0), 3100, 3100])
    coords[3100] = [(0.8, 0.8), (0.8, 0.9), (0.9, 0.9), (0.8, 0.8)]
    rings += [(tile, 9900, 1, 3100), (tile, face(0, 0), 90, 3100)]
    edges.append([tile, 3200, 7200, 7201, face(0, 0), face(0, 0), 3200, 3200])
    coords[3200] = [(0.6, 0.9), (0.7, 0.95)]
    rings.append((tile, face(0, 0), 91, 3200))
    return [tuple(x) for x in edges], rings, coords


def data(spark):
    edges, rings, coords = [], [], []
    for tile, (g, holes, spur) in enumerate([(3, [(1, 1), (1, 1), (0, 2)], True), (5, [(4, 4)], False), (12, [], True)]):
        e, r, c = planar(tile, g, holes, spur)
        edges, rings = edges + e, rings + r
        coords += [(tile, k, i, *p) for k, pts in c.items() for i, p in enumerate(pts)]
    edges.append((7, 1, 1, 2, 5, 6, 1, 99))        # leads nowhere
    edges.append((7, 2, 3, 4, 5, 8, 3, 3))         # runs into a circle without a start
    edges += [(7, 3, 4, 5, 8, 8, 4, 4), (7, 4, 5, 4, 8, 8, 3, 3)]
    rings += [(7, 6, 1, 1), (7, 5, 1, 2), (7, 5, 2, 1), (7, 77, 1, 1), (7, 5, 3, 1234)]
    f = lambda rows, s: spark.createDataFrame(rows, s)
    return edges, rings, coords, f(edges, EDGE), f(rings, "tile long, face long, ring long, start_edge long"), f(coords, "tile long, edge long, pos long, lat double, lon double")


def test_rings_against_a_walk(spark):
    edges, rings, _, e, r, _ = data(spark)
    walked, broken = topology.ring_walk(e, r)
    got = {}
    for x in walked.orderBy("n").collect():
        got.setdefault((x.tile, x.face, x.ring), []).append((x.edge, x.back))
    want = {(t, f, n): walk(edges, t, f, s) for t, f, n, s in rings}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert {(x.tile, x.face, x.ring) for x in broken.collect()} == {k for k, v in want.items() if v is None}
    assert max(map(len, got.values())) == 48 and any(len({a for a, _ in v}) < len(v) for v in got.values())     # one edge on both sides


def test_area_points(spark):
    edges, rings, coords, e, r, c = data(spark)
    body = {(t, x): lf != rf for t, x, _, _, lf, rf, _, _ in edges}
    at = {}
    for t, x, i, *p in coords:
        at.setdefault((t, x), []).append(tuple(p))
    faces = sorted({(t, f) for t, f, *_ in rings})
    features = [(10 * i, t, f) for i, (t, f) in enumerate(faces)] + [(10 * i + 1, t, f) for i, (t, f) in enumerate(faces[:3])]
    got = {}
    for x in topology.area_points(spark.createDataFrame(features, "feature long, tile long, face long"), e, r, c).orderBy("part", "n").collect():
        got.setdefault((x.feature, x.part), []).append((x.lat, x.lon))
    want = {}
    for feature, t, f in features:
        parts = [w for _, _, _, s in sorted(x for x in rings if x[:2] == (t, f)) if (w := walk(edges, t, f, s)) and any(body[t, x] for x, _ in w)]
        for k, w in enumerate(parts):
            line = []
            for x, back in w:
                line += (at[t, x][::-1] if back else at[t, x])[bool(line):]
            want[feature, k] = line
    assert got == want
    assert all(v[0] == v[-1] for v in got.values())
    assert len([k for k in got if k[0] == 10 * faces.index((0, 2 + 1 * 3 + 1))]) == 3       # an outer ring and two holes


def test_simple_features(spark):
    rows = spark.createDataFrame([(1, 5, 2), (2, 5, 9), (3, 6, 2)], "feature long, tile long, prim long")
    prim = spark.createDataFrame([(5, 2, 0, 1.0, 2.0), (5, 2, 1, 3.0, 4.0), (6, 2, 0, 5.0, 6.0)], "tile long, prim long, pos long, lat double, lon double")
    assert sorted(map(tuple, topology.simple_features(rows, prim).collect())) == [(1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0), (3, 0, 5.0, 6.0)]
