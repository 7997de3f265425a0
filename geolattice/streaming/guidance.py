"""Turn guidance on a stream of fixes: a small state machine per ride, driven by event time."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.guidance import ARRIVE_M, EVENTS, RINGS, choose_place

#: Fixed value: metres per degree and the radius of the sphere all distances here use.
_M_PER_DEG, _RADIUS = 111195.08023353292, 6371008.8


def _sphere_m(a, b):
    (p, q), (r, s) = ((math.radians(x), math.radians(y)) for x, y in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * _RADIUS * math.asin(math.sqrt(min(1.0, h)))


class Route:
    """A route and its maneuvers as a ride keeps them."""

    def __init__(self, points: list[tuple[float, float]], maneuvers: list[tuple[float, str]]) -> None:
        import numpy as np
        self.ends = [0.0]
        for a, b in zip(points, points[1:]):
            self.ends.append(self.ends[-1] + _sphere_m(a, b))
        self.lat, self.lon = np.array(points).T if points else (np.zeros(0), np.zeros(0))
        self.maneuvers = [(round(at, 3), kind) for at, kind in maneuvers]
        self.total = round(self.ends[-1], 3)

    def places(self, lat: float, lon: float) -> list[tuple]:
        """(cross, i, along, s0, s1) of every segment, the nearest first."""
        import numpy as np
        scale = _M_PER_DEG * math.cos(math.radians(lat))
        x, y = (self.lon - lon) * scale, (self.lat - lat) * _M_PER_DEG
        dx, dy = np.diff(x), np.diff(y)
        long = dx * dx + dy * dy
        t = np.clip(np.where(long > 0, -(x[:-1] * dx + y[:-1] * dy) / np.where(long > 0, long, 1), 0), 0, 1)
        cross = np.hypot(x[:-1] + t * dx, y[:-1] + t * dy)
        start, end = np.array(self.ends[:-1]), np.array(self.ends[1:])
        along = start + t * (end - start)
        return sorted(zip(np.round(cross, 6).tolist(), range(len(cross)), np.round(along, 3).tolist(), self.ends[:-1], self.ends[1:]))


def radius(ring: str, speed: float) -> float:
    seconds, low, high = RINGS[ring]
    r = max(low, speed * seconds)
    return r if high is None else min(r, high)


#: (along, on_route, leaving_since, t, lat, lon, next maneuver, a maneuver was ahead, arrived) before the first fix.
START = (None, None, None, None, None, None, 0, False, False)


def announce(route: Route, state: tuple, fired: set, fix: tuple) -> tuple[tuple, list[tuple]]:
    """One fix (t, lat, lon, speed): the next state and its announcements (event, ring, maneuver, kind, distance_m, then); `fired` holds (maneuver, ring) spent."""
    t, lat, lon, speed = fix
    along, on, since, t0, lat0, lon0, before, had_next, arrived = state
    first, out, corners = t0 is None, [], route.maneuvers
    if speed is None:
        speed = _sphere_m((lat0, lon0), (lat, lon)) / (t - t0) if not first and t > t0 else 0.0
    speed = max(0.0, speed)
    (along, on, since), (_, cross, was, _) = choose_place((along, on, since), t, route.places(lat, lon))
    nxt = sum(at <= along for at, _ in corners)
    if was and not on:
        out.append(("off_route", None, None, None, cross, None))
    if on and not was:
        out.append(("rejoined", None, None, None, cross, None))
        fired.difference_update([f for f in fired if f[0] >= nxt])
    if on and was and had_next:
        out += [("passed", None, i, corners[i][1], 0.0, None) for i in range(before, nxt) if corners[i][1] != "arrive"]
    remaining = route.total - along
    if on and not arrived and remaining <= ARRIVE_M:
        arrived = True
        out.append(("arrived", None, len(corners) - 1, corners[-1][1], remaining, None))
    if on and not arrived and nxt < len(corners):
        gap = corners[nxt][0] - along
        entered = [r for r in ("at", "act_now", "heads_up") if gap <= radius(r, speed) and (nxt, r) not in fired]
        fired.update((nxt, r) for r in entered)
        if entered:
            two = nxt + 1 < len(corners) and corners[nxt + 1][0] - corners[nxt][0] <= radius("act_now", speed) and corners[nxt + 1][1] != "arrive"
            out.append(("approach", entered[0], nxt, corners[nxt][1], gap, nxt + 1 if two else None))
    return (along, on, since, t, lat, lon, nxt, on and not arrived and nxt < len(corners), arrived), out


class GuidanceProcessor(StatefulProcessor):
    """Fixes wait until the watermark has passed them, so they are taken in order; a ride that falls silent is forgotten."""

    def __init__(self, forget_s: float) -> None:
        self.forget_ms = int(forget_s * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "i long, lat double, lon double")
        self.corners = handle.getListState("corners", "m long, at_m double, kind string")
        self.waiting = handle.getListState("waiting", "ms long, seq long, t double, lat double, lon double, speed double")
        self.state = handle.getValueState("state", "along double, on_route boolean, since double, t double, lat double, lon double, next_i int, has_next boolean, arrived boolean")
        self.fired = handle.getListState("fired", "maneuver int, ring string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = [r for r in initialState.itertuples(index=False)]
        self.points.appendList([(int(r.i), float(r.lat), float(r.lon)) for r in rows if r.kind is None])
        self.corners.appendList([(int(r.i), float(r.lat), r.kind) for r in rows if r.kind is not None])

    def handleInputRows(self, key, rows, timerValues):
        new = []
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                new.append((int(r.t * 1000), int(r.seq), float(r.t), float(r.lat), float(r.lon), None if r.speed is None or math.isnan(r.speed) else float(r.speed)))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(x[0] for x in new))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        state = tuple(self.state.get()) if self.state.exists() else START
        if not due and not rest:
            if state[3] is None or state[3] * 1000 + self.forget_ms <= now:
                for s in (self.points, self.corners, self.waiting, self.state, self.fired):
                    s.clear()
            return iter([])
        points, corners = (sorted(s.get()) if s.exists() else [] for s in (self.points, self.corners))
        out = []
        if len(points) > 1 and corners:
            route = Route([p[1:] for p in points], [c[1:] for c in corners])
            fired = {tuple(f) for f in self.fired.get()} if self.fired.exists() else set()
            for _, seq, t, lat, lon, speed in due:
                state, said = announce(route, state, fired, (t, lat, lon, speed))
                out += [(key[0], seq, *s) for s in said]
            self.state.update(state)
            self.fired.put(sorted(fired)) if fired else self.fired.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(x[0] for x in rest))
        else:
            self.waiting.clear()
        if due:
            self.handle.registerTimer(due[-1][0] + self.forget_ms)
        if not out:
            return iter([])
        names = [c.split()[0] for c in EVENTS.split(", ")]
        return iter([pd.DataFrame(out, columns=names).astype({"maneuver": "Int32", "then_maneuver": "Int32"})])

    def close(self) -> None:
        pass


def guidance_stream(fixes: DataFrame, points: DataFrame, maneuvers: DataFrame, delay_s: float = 10.0, forget_s: float = 3600.0) -> DataFrame:
    """Announcements of a stream of fixes (ride, seq, t, lat, lon, speed), as ``operators.guidance.guidance`` makes them of a table.

    Routes and maneuvers are the state a ride begins with. Fixes up to ``delay_s`` late are put in order; later ones are dropped. A ride's state goes ``forget_s``
    after its last fix. Needs the RocksDB state store.
    """
    start = points.select("ride", F.col("i").cast("long").alias("i"), "lat", "lon", F.lit(None).cast("string").alias("kind")).unionByName(
        maneuvers.select("ride", F.col("m").cast("long").alias("i"), F.col("at_m").alias("lat"), F.lit(0.0).alias("lon"), "kind"))
    timed = fixes.select("ride", "seq", "t", "lat", "lon", "speed", F.timestamp_micros((F.col("t") * 1e6).cast("long")).alias("_time")).withWatermark("_time", f"{delay_s} seconds")
    return timed.groupBy("ride").transformWithStateInPandas(statefulProcessor=GuidanceProcessor(forget_s), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime",
                                                            initialState=start.groupBy("ride"))
