"""Viewsheds in bands and sectors against one pass over the whole square."""
from __future__ import annotations

import math
import random

import pytest

from geolattice.functions import geo
from geolattice.operators import terrain

INF = float("inf")


def brute(z, r0, c0, height, steps, spacing):
    """{(row, col): (min, max, interp)} over every post in range; z: {(row, col): elevation}."""
    eye = z[r0, c0] + height
    los, vh = {(0, 0): (-INF,) * 3}, {(r0, c0): (0.0,) * 3}
    for ring in range(1, steps + 1):
        for dr in range(-ring, ring + 1):
            for dc in range(-ring, ring + 1):
                if max(abs(dr), abs(dc)) != ring:
                    continue
                d = math.hypot(dr, dc) * spacing
                rise = z.get((r0 + dr, c0 + dc), 0.0) - d * d / (2 * geo.CURVATURE_R) - eye
                a = (dr * (ring - 1) // ring, dc * (ring - 1) // ring)
                b = (-(-dr * (ring - 1) // ring), -(-dc * (ring - 1) // ring))
                t = max(dr * (ring - 1) % ring, dc * (ring - 1) % ring) / ring
                out, line = [], []
                for m in range(3):
                    p, q = los[a][m], los[b][m]
                    ray = (min(p, q), max(p, q), p if t == 0 else p * (1 - t) + q * t)[m]
                    seen = ray * d < rise
                    out.append(0.0 if seen else ray * d - rise)
                    line.append(rise / d if seen else ray)
                los[dr, dc] = tuple(line)
                if (r0 + dr, c0 + dc) in z:
                    vh[r0 + dr, c0 + dc] = tuple(out)
    return vh


def land(seed, rows=60, cols=70):
    rng = random.Random(seed)
    z = {(r, c): round(100 + 40 * math.sin(r / 7) + 30 * math.cos(c / 5) + rng.uniform(0, 30), 2) for r in range(rows) for c in range(cols)}
    return {k: v for k, v in z.items() if rng.random() > 0.03 and not (20 < k[0] < 30 and 40 < k[1] < 55)}


def frame(spark, z):
    return spark.createDataFrame([(*k, v) for k, v in z.items()] + [(59, 69, None)], "row long, col long, elev double").dropDuplicates(["row", "col"])


@pytest.mark.parametrize("band,width", [(256, 1024), (7, 5), (1, 3)])
def test_bands_and_sectors_change_nothing(spark, band, width):
    z = land(1)
    z.pop((59, 69), None)
    eyes = [(i, *k, 3.0 + i, s) for i, (k, s) in enumerate([(sorted(z)[700], 17), (sorted(z)[1500], 8), (sorted(z)[2500], 23)])]
    ob = spark.createDataFrame([*eyes, (9, 25, 45, 2.0, 9)], "id long, row long, col long, height_m double, steps int")      # the last one stands on no post
    got = {}
    for r in terrain.viewshed(ob, frame(spark, z), 90.0, band=band, width=width).collect():
        assert (r.id, r.row, r["col"]) not in got
        got[r.id, r.row, r["col"]] = (r.vh_min, r.vh_max, r.vh_interp)
    want = {(i, *k): v for i, row, col, h, s in eyes for k, v in brute(z, row, col, h, s, 90.0).items()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-6)


def test_circle_and_sector(spark):
    z = land(2)
    z[30, 30] = 120.0
    row = [(1, 30, 30, 5.0, 12)]
    ob = spark.createDataFrame(row, "id long, row long, col long, height_m double, steps int")
    posts = frame(spark, z)
    whole = {(r.row, r["col"]): r.vh_interp for r in terrain.viewshed(ob, posts, 90.0).collect()}
    ring = {(r.row, r["col"]): r.vh_interp for r in terrain.viewshed(ob, posts, 90.0, circle=True, band=5, width=4).collect()}
    assert ring == pytest.approx({k: v for k, v in whole.items() if math.hypot(k[0] - 30, k[1] - 30) <= 12})

    def wedge(bearing, angle):
        o = spark.createDataFrame([(*row[0], bearing, angle)], "id long, row long, col long, height_m double, steps int, bearing double, angle double")
        return {(r.row, r["col"]) for r in terrain.viewshed(o, posts, 90.0).collect()}

    def inside(k, bearing, angle):
        if k == (30, 30):
            return True
        b = math.degrees(math.atan2(k[1] - 30, k[0] - 30))
        return abs((b - bearing + 180) % 360 - 180) <= angle / 2 + 1e-9
    assert wedge(70.0, 41.0) == {k for k in whole if inside(k, 70.0, 41.0)}
    assert wedge(350.0, 90.5) == {k for k in whole if inside(k, 350.0, 90.5)}
    assert wedge(10.0, 270.0) == wedge(None, 30.0) == set(whole)
