"""OpenStreetMap way and node tags as Columns over a ``tags`` map."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Road class -> (default speed km/h, driveable, cycleable, crossing level as road met, as road ridden).
ROAD_CLASSES = {
    "motorway": (110, True, False, 0, 3), "motorway_link": (70, True, False, 0, 3), "trunk": (90, True, True, 3, 3),
    "trunk_link": (60, True, True, 0, 3), "primary": (80, True, True, 2, 2), "primary_link": (50, True, True, 0, 2),
    "secondary": (65, True, True, 1, 1), "secondary_link": (45, True, True, 0, 1), "tertiary": (55, True, True, 0, 0),
    "tertiary_link": (40, True, True, 0, 0), "unclassified": (45, True, True, 0, 0), "residential": (35, True, True, 0, 0),
    "living_street": (15, True, True, 0, 0), "service": (20, True, True, 0, 0), "track": (20, True, True, 0, 0),
    "pedestrian": (5, False, True, 0, 0), "footway": (5, False, True, 0, 0), "path": (5, False, True, 0, 0),
    "cycleway": (15, False, True, 0, 0), "steps": (2, False, False, 0, 0), "ferry": (20, True, True, 0, 0),
    "beach": (10, False, True, 0, 0), "beach_access": (4, False, True, 0, 0)}
# Surface -> how it rides.
SURFACES = {
    "paved": ["paved", "asphalt", "concrete", "concrete:plates", "concrete:lanes", "paving_stones", "bricks", "brick", "wood", "metal", "chipseal"],
    "compacted": ["compacted", "fine_gravel", "sett", "cobblestone", "unhewn_cobblestone"],
    "rough": ["unpaved", "gravel", "pebblestone", "dirt", "earth", "ground", "grass", "grass_paver", "sand", "mud", "rock", "woodchips"]}
PROVISION = {"track": 3, "lane": 2, "buffered_lane": 2, "share_busway": 2, "shared_lane": 1}


def tag(tags: Column, key: str) -> Column:
    return F.element_at(tags, key)


def truthy(c: Column) -> Column:
    return F.coalesce(c.isin("yes", "true", "1"), F.lit(False))


def falsy(c: Column) -> Column:
    return F.coalesce(c.isin("no", "false", "0"), F.lit(False))


def maxspeed_kph(c: Column) -> Column:
    """Whole km/h, mph converted, ``walk`` 5, at most 255; 0 when there is nothing usable."""
    n = F.regexp_extract(c, r"^[ \t]*(\d{1,9})", 1).try_cast("int")
    mph = c.rlike(r"^[ \t]*\d+ *mph")
    kph = F.when(mph, F.floor(n * 1.609344 + 0.5)).otherwise(n).cast("int")
    return F.coalesce(F.when(n.isNull(), F.when(c == "walk", 5).otherwise(0)).when(kph < 1, 0).otherwise(F.least(kph, F.lit(255))), F.lit(0)).cast("int")


def lanes(c: Column) -> Column:
    n = F.regexp_extract(c, r"^\s*([+-]?\d{1,9})", 1).try_cast("int")
    return F.coalesce(F.least(F.greatest(n, F.lit(0)), F.lit(15)), F.lit(0)).cast("int")


def duration_s(c: Column) -> Column:
    """Minutes, h:m or h:m:s (last part may be fractional) as whole seconds; 0 when unusable."""
    p = F.split(c, ":")
    ok = c.rlike(r"^\d+(\.\d+)?(:\d+(\.\d+)?){0,2}$")

    def part(i):
        return F.get(p, F.lit(i)).try_cast("double")
    s = F.when(F.size(p) == 1, part(0) * 60).when(F.size(p) == 2, part(0) * 3600 + part(1) * 60).otherwise(part(0) * 3600 + part(1) * 60 + part(2))
    return F.coalesce(F.when(ok, F.floor(s + 0.5)), F.lit(0)).cast("int")


def surface_class(c: Column) -> Column:
    out = F.lit("unknown")
    for k, vs in SURFACES.items():
        out = F.when(c.isin(*vs), k).otherwise(out)
    return out


def provision(c: Column) -> Column:
    """Rank of one cycleway value: 3 track, 2 lane, 1 shared lane, 0 none."""
    out = F.lit(0)
    for v, r in PROVISION.items():
        out = F.when(c == v, r).otherwise(out)
    return F.coalesce(out, F.lit(0))


def side_provision(tags: Column, side: str) -> Column:
    return provision(F.coalesce(tag(tags, f"cycleway:{side}"), tag(tags, "cycleway:both"), tag(tags, "cycleway")))


def access(tags: Column, *keys: str) -> Column:
    """The first key that is set decides: no, private or allowed; null when none is."""
    v = F.coalesce(*[tag(tags, k) for k in keys])
    return F.when(v == "no", "no").when(v == "private", "private").when(v.isNotNull(), "allowed")


def mode_access(tags: Column) -> dict[str, Column]:
    return {"bicycle": access(tags, "bicycle", "vehicle", "access"), "foot": access(tags, "foot", "access"),
            "motor": access(tags, "motor_vehicle", "vehicle", "access")}


def _class_map(i: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in ROAD_CLASSES.items() for x in (k, v[i])])


def default_kph(klass: Column) -> Column:
    return F.element_at(_class_map(0), klass)


def driveable(klass: Column) -> Column:
    return F.coalesce(F.element_at(_class_map(1), klass), F.lit(False))


def cycleable(klass: Column) -> Column:
    return F.coalesce(F.element_at(_class_map(2), klass), F.lit(False))


def crossing_level(klass: Column, ridden: bool) -> Column:
    return F.coalesce(F.element_at(_class_map(4 if ridden else 3), klass), F.lit(0))


def road_class(tags: Column, ferries: bool = True) -> Column:
    """The way's class, or null when it is no road; a ferry route outranks any highway tag."""
    h = tag(tags, "highway")
    known = F.when(h.isin(*[k for k in ROAD_CLASSES if k not in ("ferry", "beach", "beach_access")]), h)
    return F.when(F.coalesce(tag(tags, "route") == "ferry", F.lit(False)) & F.lit(ferries), "ferry").otherwise(known)


def verdict(tags: Column, cycle_only: bool = False, non_driveable: bool = True, ferries: bool = True) -> Column:
    """kept, not road or no access."""
    k, a = road_class(tags, ferries), mode_access(tags)
    shut = F.coalesce((a["bicycle"] == "no") & (a["foot"] == "no") & (a["motor"] == "no"), F.lit(False))
    off = F.lit(False)
    if cycle_only:
        off = ~cycleable(k) | F.coalesce(a["bicycle"] == "no", F.lit(False))
    elif not non_driveable:
        off = ~driveable(k)
    return F.when(k.isNull(), "not road").when(shut, "no access").when(off | truthy(tag(tags, "area")), "not road").otherwise("kept")


def direction(tags: Column, klass: Column) -> Column:
    """both, forward or backward."""
    implied = klass.isin("motorway", "motorway_link") | F.coalesce(tag(tags, "junction").isin("roundabout", "circular"), F.lit(False))
    o = tag(tags, "oneway")
    return (F.when(truthy(o), "forward").when(F.coalesce(o.isin("-1", "reverse"), F.lit(False)), "backward")
            .when(falsy(o), "both").when(implied, "forward").otherwise("both"))


def with_way_attributes(df):
    """Everything the graph keeps from a way's own tags, added in steps (each step reads earlier columns)."""
    t, c = F.col("tags"), F.col
    a = mode_access(t)
    d = df.withColumn("klass", road_class(t)).withColumn("_posted", maxspeed_kph(F.coalesce(tag(t, "maxspeed"), F.lit(""))))
    d = d.withColumn("_posted", F.when(c("klass") == "ferry", 0).otherwise(c("_posted"))).withColumn("dir", direction(t, c("klass")))
    d = d.withColumn("_right", side_provision(t, "right")).withColumn("_left", side_provision(t, "left"))

    def traffic(side):
        return F.when(F.coalesce(tag(t, f"cycleway:{side}:oneway") == "-1", F.lit(False)), 0).otherwise(c(f"_{side}"))
    d = d.withColumn("_best", F.greatest(traffic("right"), traffic("left")))
    both = c("dir") == "both"
    return d.select(*df.columns, "klass", F.when(c("_posted") > 0, c("_posted")).otherwise(default_kph(c("klass"))).cast("int").alias("speed_kph"), (c("_posted") > 0).alias("speed_posted"),
                    "dir", lanes(F.coalesce(tag(t, "lanes"), F.lit(""))).alias("lanes"), surface_class(tag(t, "surface")).alias("surface"),
                    F.when(c("klass") == "ferry", duration_s(F.coalesce(tag(t, "duration"), F.lit("")))).otherwise(0).alias("duration_s"),
                    *[F.coalesce(a[m], F.lit("allowed")).alias(f"{m}_access") for m in ("bicycle", "foot", "motor")], truthy(tag(t, "toll")).alias("toll"),
                    F.when(both, c("_right")).when(c("dir") == "forward", c("_best")).otherwise(0).alias("bike_fwd"),
                    F.when(both, c("_left")).when(c("dir") == "backward", c("_best")).otherwise(0).alias("bike_bwd"))


def is_signal(tags: Column) -> Column:
    c = F.coalesce
    return (c(tag(tags, "highway") == "traffic_signals", F.lit(False)) | c(tag(tags, "crossing") == "traffic_signals", F.lit(False))
            | c(tag(tags, "crossing:signals") == "yes", F.lit(False)))


def barrier_access(tags: Column) -> Column:
    """Struct(bicycle, foot, motor) a barrier node imposes: no, private or allowed; null for no barrier."""
    b, a = tag(tags, "barrier"), mode_access(tags)
    gate, block = b.isin("gate", "lift_gate", "swing_gate", "sliding_gate"), b.isin("bollard", "block", "chain", "cycle_barrier")
    motor = F.when(block & a["motor"].isNull(), "no").otherwise(F.coalesce(a["motor"], F.lit("allowed")))
    return F.when(gate | block, F.struct(F.coalesce(a["bicycle"], F.lit("allowed")).alias("bicycle"), F.coalesce(a["foot"], F.lit("allowed")).alias("foot"), motor.alias("motor")))
