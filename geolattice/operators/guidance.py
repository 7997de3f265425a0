"""Turn guidance for rides along their routes: one table of announcements from fixes, routes and maneuvers.

What a fix means depends on the past in two ways only: where on the route the last one was, and whether the rider was still on it. That much
is a fold over chunks of the ride; it forgets at once, so it settles in a few rounds. Announcements are then windows: a ring speaks where the rider first comes
inside it, a corner is passed between two fixes, the end is reached once.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..session import cut_lineage
from .ordered import Ordered, asof, fold

# Seconds and metres of the rings, of leaving and rejoining, of arriving, and how far around the last place the next is sought.
RINGS = {"heads_up": (30.0, 100.0, 400.0), "act_now": (8.0, 20.0, 80.0), "at": (1.5, 10.0, None)}
OFF_ROUTE_M, OFF_ROUTE_S, REJOIN_M, ARRIVE_M, WINDOW_M = 25.0, 5.0, 15.0, 15.0, 150.0
#: Announcements of one fix come in this order.
ORDER = ["off_route", "rejoined", "passed", "arrived", "approach"]
EVENTS = "ride long, seq long, event string, ring string, maneuver int, kind string, distance_m double, then_maneuver int"


def ring_m(name: str, speed: Column) -> Column:
    """Radius of a ring: a time at the rider's speed, kept between two distances."""
    seconds, low, high = RINGS[name]
    r = F.greatest(speed * seconds, F.lit(low))
    return r if high is None else F.least(r, F.lit(high))


def route_segments(points: DataFrame) -> DataFrame:
    """Route points (ride, i, lat, lon) as segments (ride, i, alat, alon, blat, blon, s0, s1), with metres from the start."""
    o = Ordered(points, ["ride"], ["i"], F.floor(F.col("i") / 1000)).following(lat=F.col("lat"), lon=F.col("lon"))
    seg = o.result().filter("not is_last").select("ride", "i", F.col("lat").alias("alat"), F.col("lon").alias("alon"), F.col("next_lat").alias("blat"), F.col("next_lon").alias("blon"))
    seg = seg.withColumn("len_m", geo.sphere_m(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")))
    run = Ordered(seg, ["ride"], ["i"], F.floor(F.col("i") / 1000)).running(sums={"s1": F.col("len_m")}).result()
    return run.withColumn("s0", F.col("s1") - F.col("len_m")).drop("len_m")


def on_route_places(fixes: DataFrame, segs: DataFrame) -> DataFrame:
    """Where on its route each fix may be: (ride, seq, i, cross, along, s0, s1).

    Distances count to the micrometre, places to the millimetre, so that equal ones are equal however they were added up. All places within OFF_ROUTE_M; where there is none, the nearest ones of the whole route. Fix and segment meet on (ride, cell); fixes that meet none look again
    with a wider reach, until every fix of a ride with a route has a place.

    A cell is one reach high. It is as wide as a reach at the ride's highest latitude, so that near a pole, where degrees of longitude shrink, neither a fix nor a leg has many cells. A leg lies in one piece,
    beyond 180 where it crosses the antimeridian; a fix is sought a turn on or back where the ride's box reaches there. Longitudes more than a turn apart are none from -180 to 180 and stay as they are.
    """
    scale = lambda lat: F.abs(F.cos(F.radians(F.col(lat))))
    ends = fixes.select("ride", scale("lat").alias("c")).unionByName(segs.select("ride", F.least(scale("alat"), scale("blat")).alias("c"))).groupBy("ride").agg(F.min("c").alias("_c"))
    gap = F.col("blon") - F.col("alon")
    legs = segs.select("ride", F.struct("i", "s0", "s1").alias("seg"), "alat", "alon", "blat", F.when(F.abs(gap) <= 360.0, F.col("alon") + geo.normalize_lon(gap)).otherwise(F.col("blon")).alias("blon"))
    box = legs.groupBy("ride").agg(F.min(F.least("alon", "blon")).alias("_w"), F.max(F.greatest("alon", "blon")).alias("_e"))
    legs = cut_lineage(legs.join(ends.hint("merge"), "ride"))
    left = cut_lineage(fixes.select("ride", "seq", "lat", "lon").join(box.join(ends.hint("merge"), "ride").hint("merge"), "ride"))
    reach, found = OFF_ROUTE_M, []
    while True:
        top = reach / geo.M_PER_DEG
        wide = F.lit(top) / F.col("_c")

        def around(low, high, size, pad):
            return F.explode(F.sequence(F.floor(low / size - pad), F.floor(high / size + pad)))
        far = top / scale("lat") + 1e-9
        turn = F.filter(F.array(F.lit(0.0), F.when(F.col("lon") + 360.0 - far <= F.col("_e"), 360.0), F.when(F.col("lon") - 360.0 + far >= F.col("_w"), -360.0)), lambda x: x.isNotNull())
        probe = (left.withColumn("_turn", F.explode(turn)).withColumn("_x", F.col("lon") + F.col("_turn"))
                 .withColumn("_row", around(F.col("lat") - top, F.col("lat") + top, F.lit(top), 1e-5))
                 .withColumn("_col", around(F.col("_x") - top / scale("lat"), F.col("_x") + top / scale("lat"), wide, 1e-5)).drop("_c"))
        cut = legs.withColumn("_dlon", F.col("blon") - F.col("alon")).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("blat") - F.col("alat")) / top, F.abs("_dlon") / wide))))
        cut = cut.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))

        def at(a, d, k):
            return F.col(a) + d * k / F.col("_n")
        la, lb = [at("alat", F.col("blat") - F.col("alat"), F.col("_k") + k) for k in (0, 1)]
        oa, ob = [at("alon", F.col("_dlon"), F.col("_k") + k) for k in (0, 1)]
        cells = (cut.withColumn("_row", around(F.least(la, lb), F.greatest(la, lb), F.lit(top), 1e-5)).withColumn("_col", around(F.least(oa, ob), F.greatest(oa, ob), wide, 1e-5))
                 .select("ride", "_row", "_col", "seg", "alat", "alon", "blat", "blon", "_c").distinct())
        c = F.col
        way = F.abs(c("alon") - c("_x"))
        j = probe.join(cells.hint("merge"), ["ride", "_row", "_col"]).filter((way <= 180.0) | ((c("_turn") == 0.0) & (way > 360.0)))
        mx = geo.M_PER_DEG * scale("lat")
        # worked out in steps, so that later filters do not copy them
        j = geo.pinned(j, _ax=(c("alon") - c("_x")) * mx, _ay=(c("alat") - c("lat")) * geo.M_PER_DEG, _dx=(c("blon") - c("alon")) * mx, _dy=(c("blat") - c("alat")) * geo.M_PER_DEG)
        j = geo.pinned(j, _share=F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(-(c("_ax") * c("_dx") + c("_ay") * c("_dy")), c("_dx") * c("_dx") + c("_dy") * c("_dy")))))
        j = geo.pinned(j, _px=c("_ax") + c("_share") * c("_dx"), _py=c("_ay") + c("_share") * c("_dy"))
        here = (F.floor((c("lat") + c("_py") / geo.M_PER_DEG) / top) == c("_row")) & (F.floor((c("_x") + c("_px") / mx) / wide) == c("_col"))
        cross = F.sqrt(c("_px") * c("_px") + c("_py") * c("_py"))
        hit = cut_lineage(j.filter(here & (cross <= reach)).select(
            "ride", "seq", c("seg.i").alias("i"), F.round(cross, 6).alias("cross"), F.round(c("seg.s0") + (c("seg.s1") - c("seg.s0")) * c("_share"), 3).alias("along"), c("seg.s0").alias("s0"), c("seg.s1").alias("s1")))
        if reach > OFF_ROUTE_M:   # off the route only the nearest counts; equal ones are told apart by the window
            least = hit.groupBy("ride", "seq").agg(F.min("cross").alias("_least"))
            hit = hit.join(least.hint("merge"), ["ride", "seq"]).filter(F.col("cross") <= F.col("_least") + 1e-6).drop("_least")
        found.append(hit)
        left = cut_lineage(left.join(hit.select("ride", "seq").distinct().hint("merge"), ["ride", "seq"], "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
        reach *= 8.0


def choose_place(state: tuple, t, places: list) -> tuple[tuple, tuple]:
    """One fix: ((along, on_route, leaving_since), (along, cross, was_on, on_route)). ``places``: (cross, i, along, s0, s1), nearest first.

    Near the last place the nearest one counts; only if that is off the route, the nearest anywhere. Leaving has to last, rejoining takes effect at once.
    """
    last, was_on, since = state
    place = None
    if last is not None:
        near = [p for p in places if p[4] >= last - WINDOW_M and p[3] <= last + WINDOW_M]
        if near and (near[0][0] <= OFF_ROUTE_M or near[0][0] <= places[0][0] + 1e-6):
            place = near[0]
    place = place or places[0]
    was = True if was_on is None else bool(was_on)
    on = was
    if was and place[0] > OFF_ROUTE_M:
        since = t if since is None else since
        if t - since >= OFF_ROUTE_S:
            on, since = False, None
    elif was:
        since = None
    elif place[0] <= REJOIN_M:
        on, since = True, None
    return (place[2], on, since), (place[2], place[0], was, on)


def located(fixes: DataFrame, segs: DataFrame, size: int = 500) -> DataFrame:
    """Fixes with along, cross, was_on, on_route; fixes of rides without a route are left out."""
    places = on_route_places(fixes, segs)
    # what lies within a few tens of metres of one fix is few segments
    per = places.groupBy("ride", "seq").agg(F.sort_array(F.collect_list(F.struct("cross", "i", "along", "s0", "s1"))).alias("places"))
    src = cut_lineage(fixes.select("ride", "seq", "t", "lat", "lon", "speed").join(per, ["ride", "seq"]))

    def step(state, pdf):
        import pandas as pd
        state = tuple(None if x is None else x for x in state)
        out = []
        for r in pdf.itertuples(index=False):
            state, (along, cross, was, on) = choose_place(state, r.t, [(p["cross"], p["i"], p["along"], p["s0"], p["s1"]) for p in r.places])
            out.append((r.ride, r.seq, r.t, r.lat, r.lon, r.speed, along, cross, was, on))
        return state, pd.DataFrame(out, columns=["ride", "seq", "t", "lat", "lon", "speed", "along", "cross", "was_on", "on_route"])
    return fold(src, ["ride"], ["seq"], F.floor(F.col("seq") / size), "along double, on_route boolean, since double",
                "ride long, seq long, t double, lat double, lon double, speed double, along double, cross double, was_on boolean, on_route boolean", step, lambda: (None, None, None))


def guidance(fixes: DataFrame, points: DataFrame, maneuvers: DataFrame, size: int = 500) -> DataFrame:
    """Announcements (``EVENTS``) of rides. Fixes: ride, seq, t (seconds), lat, lon, speed (null: from the step). Route points: ride, i, lat, lon. Maneuvers: ride, m (0, 1, ...), at_m, kind; the last is `arrive`.

    Only the innermost of the rings newly entered at a fix speaks, the others are spent. Coming back to the route arms the rings of all corners ahead again. The end is
    announced once and nothing after it. A corner behind the first fix is not announced as passed.
    """
    segs = cut_lineage(route_segments(points))
    total = segs.groupBy("ride").agg(F.round(F.max("s1"), 3).alias("total_m"))
    chunk = F.floor(F.col("m") / 1000)
    m = Ordered(maneuvers.select("ride", F.col("m").cast("int").alias("m"), F.round(F.col("at_m").cast("double"), 3).alias("at_m"), "kind"), ["ride"], ["m"], chunk).following(at=F.col("at_m"), kind=F.col("kind"), m=F.col("m")).result()
    m = m.drop("is_last")
    m = cut_lineage(Ordered(m, ["ride"], ["m"], chunk).following(at2=F.col("next_at"), kind2=F.col("next_kind"), m2=F.col("next_m")).result().drop("is_last", "next_m2"))
    head = m.filter("m = 0").select("ride", F.lit(-1.0).alias("along"), F.lit(-1).alias("m"), F.col("m").alias("next_m"), F.col("at_m").alias("next_at"), F.col("kind").alias("next_kind"),
                                    F.col("next_at").alias("next_at2"), F.col("next_kind").alias("next_kind2"))
    marks = m.select("ride", F.col("at_m").alias("along"), "m", "next_m", "next_at", "next_kind", "next_at2", "next_kind2").unionByName(head)
    # corners at one place: the last of them is behind the rider
    marks = marks.groupBy("ride", "along").agg(F.max_by(F.struct("m", "next_m", "next_at", "next_kind", "next_at2", "next_kind2"), "m").alias("v"))
    count = maneuvers.groupBy("ride").agg(F.count("*").cast("int").alias("n_maneuvers"))
    at = located(fixes.join(count.select("ride"), "ride", "left_semi"), segs, size)
    at = cut_lineage(asof(at, marks, ["ride"], "along", 5000.0, ["v"]).select("ride", "seq", "t", "lat", "lon", "speed", "along", "cross", "was_on", "on_route", "asof_v.*"))
    at = at.join(total, "ride").join(count, "ride").withColumn("next_i", F.coalesce(F.col("m") + 1, F.lit(0))).withColumn("remaining", F.col("total_m") - F.col("along"))
    by = lambda d: Ordered(d, ["ride"], ["seq"], F.floor(F.col("seq") / size))
    o = by(at).previous(t=F.col("t"), lat=F.col("lat"), lon=F.col("lon"), next_i=F.col("next_i"), on=F.col("on_route"))
    step_m = geo.sphere_m(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    derived = F.when(F.col("t") > F.col("prev_t"), step_m / (F.col("t") - F.col("prev_t"))).otherwise(0.0)
    d = o.result().withColumn("v", F.coalesce(F.when(F.col("speed").isNotNull(), F.greatest("speed", F.lit(0.0))), derived, F.lit(0.0)))
    rejoined = F.col("on_route") & ~F.col("was_on")
    ends = (F.col("on_route") & (F.col("remaining") <= ARRIVE_M)).cast("int")
    d = cut_lineage(by(d).running(sums={"ends": ends, "rejoins": rejoined.cast("int")}).result())
    no, none = F.lit(None), F.lit(None).cast("int")

    def event(rows, name, ring=no.cast("string"), maneuver=none, kind=no.cast("string"), distance=F.lit(0.0), then=none):
        return rows.select("ride", "seq", F.lit(name).alias("event"), ring.alias("ring"), maneuver.cast("int").alias("maneuver"), kind.alias("kind"), distance.alias("distance_m"), then.cast("int").alias("then_maneuver"))
    off = event(d.filter("was_on and not on_route"), "off_route", distance=F.col("cross"))
    back = event(d.filter(rejoined), "rejoined", distance=F.col("cross"))
    # the state before: on the route, not arrived, and a corner ahead
    ahead = F.col("prev_on") & (F.col("ends") - ends == 0) & (F.col("prev_next_i") < F.col("n_maneuvers"))
    went = d.filter(~F.col("is_first") & F.col("on_route") & F.col("was_on") & (F.col("next_i") > F.col("prev_next_i")) & ahead)
    went = went.withColumn("m", F.explode(F.sequence("prev_next_i", F.col("next_i") - 1))).select("ride", "seq", "m").join(maneuvers.select("ride", F.col("m").cast("int").alias("m"), "kind"), ["ride", "m"]).filter("kind <> 'arrive'")
    passed = event(went, "passed", maneuver=F.col("m"), kind=F.col("kind"))
    last = maneuvers.groupBy("ride").agg(F.max_by("kind", "m").alias("last_kind"))
    arrived = event(d.filter((ends == 1) & (F.col("ends") == 1)).join(last, "ride"), "arrived", maneuver=F.col("n_maneuvers") - 1, kind=F.col("last_kind"), distance=F.col("remaining"))
    inside = d.filter(F.col("on_route") & (F.col("ends") == 0) & F.col("next_at").isNotNull()).withColumn("gap", F.col("next_at") - F.col("along"))
    then = F.when((F.col("next_at2") - F.col("next_at") <= ring_m("act_now", F.col("v"))) & (F.col("next_kind2") != "arrive"), F.col("next_i") + 1)
    rank = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(n).alias("ring"), ring_m(n, F.col("v")).alias("r")) for k, n in enumerate(["at", "act_now", "heads_up"])])
    entered = inside.select("ride", "seq", "next_i", "rejoins", "next_kind", "gap", then.alias("then"), F.explode(F.filter(rank, lambda x: F.col("gap") <= x["r"])).alias("x")).select("*", "x.rank", "x.ring").drop("x", "r")
    first = cut_lineage(Ordered(entered, ["ride", "next_i", "rank"], ["seq"], F.floor(F.col("seq") / size)).previous(rejoins=F.col("rejoins"), seq=F.col("seq")).result())
    # spoken before: only a rejoining since then, short of this corner, arms it again
    again = first.filter("not is_first and rejoins > prev_rejoins")
    arms = d.filter(rejoined).select("ride", F.col("rejoins").alias("_at"), F.col("next_i").alias("_short"))
    armed = (again.join(arms, "ride").filter((F.col("_at") > F.col("prev_rejoins")) & (F.col("_at") <= F.col("rejoins")) & (F.col("_short") <= F.col("next_i")))
             .select(*again.columns).distinct())
    fires = first.filter("is_first").unionByName(armed).groupBy("ride", "seq").agg(F.min(F.struct("rank", "ring", "next_i", "next_kind", "gap", "then")).alias("f")).select("ride", "seq", "f.*")
    spoken = event(fires, "approach", ring=F.col("ring"), maneuver=F.col("next_i"), kind=F.col("next_kind"), distance=F.col("gap"), then=F.col("then"))
    return reduce(DataFrame.unionByName, [off, back, passed, arrived, spoken])
