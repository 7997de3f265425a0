"""OpenStreetMap tables to a road graph: nodes, arcs, restrictions.

A way holds at most 2,000 nodes by the data format, so windows over one way stay small. Node and way tables meet in sort-merge joins by hint:
their rows come out of exploded refs, which size estimates do not see, so a planner would send whole node tables through the driver.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo, tags as tg

def _along_way():
    return Window.partitionBy("way").orderBy("pos")


def merge_inputs(inputs: list[DataFrame], key: str = "id") -> DataFrame:
    """Union of extracts; the first copy of an id wins."""
    u = None
    for i, d in enumerate(inputs):
        d = d.withColumn("_in", F.lit(i))
        u = d if u is None else u.unionByName(d, allowMissingColumns=True)
    cols = [c for c in u.columns if c not in (key, "_in")]
    # a partial-aggregated minimum, not a window: many copies of one id never meet in one task
    return u.groupBy(key).agg(F.min_by(F.struct(*cols), "_in").alias("r")).select(key, "r.*")


def kept_ways(ways: DataFrame, **options) -> DataFrame:
    """Ways (way, refs, tags) the graph keeps, with their attributes."""
    t = F.col("tags")
    return tg.with_way_attributes(ways.filter(tg.verdict(t, **options) == "kept").select("way", "refs", "tags"))


def way_points(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Refs resolved to coordinates: (way, pos, node, lat, lon, run); a missing node breaks the way."""
    refs = ways.select("way", F.posexplode("refs").alias("pos", "node"))
    j = refs.join(nodes.select("node", "lat", "lon").hint("merge"), "node", "left")
    return j.withColumn("run", F.sum(F.when(F.col("lat").isNull(), 1).otherwise(0)).over(_along_way())).filter(F.col("lat").isNotNull())


def vertex_use(ways: DataFrame) -> DataFrame:
    """How often kept ways use a node, and whether it ends one; junctions are used twice or end a way."""
    refs = ways.select("way", F.size("refs").alias("_n"), F.posexplode("refs").alias("pos", "node"))
    end = (F.col("pos") == 0) | (F.col("pos") == F.col("_n") - 1)
    return refs.groupBy("node").agg(F.count("*").alias("uses"), F.max(end).alias("is_end")).withColumn("is_junction", (F.col("uses") > 1) | F.col("is_end"))


def build_edges(ways: DataFrame, nodes: DataFrame, cut_at: DataFrame | None = None) -> DataFrame:
    """Ways cut at junctions (and extra nodes): (way, edge_no, src, dst, length_m, points)."""
    use = vertex_use(ways).select("node", "is_junction")
    if cut_at is not None:
        use = use.join(cut_at.select("node", F.lit(True).alias("_cut")), "node", "left").select("node", (F.col("is_junction") | F.coalesce("_cut", F.lit(False))).alias("is_junction"))
    p = way_points(ways, nodes).join(use.hint("merge"), "node")
    w = Window.partitionBy("way", "run").orderBy("pos")
    seg = (p.withColumn("to_node", F.lead("node").over(w)).withColumn("to_lat", F.lead("lat").over(w)).withColumn("to_lon", F.lead("lon").over(w))
           .filter(F.col("to_node").isNotNull()))
    seg = seg.withColumn("piece", F.sum(F.when(F.col("is_junction"), 1).otherwise(0)).over(w))
    d = seg.withColumn("len", geo.sphere_m(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")))
    pts = F.array_sort(F.collect_list(F.struct("pos", "lat", "lon", "node", "to_lat", "to_lon", "to_node")))
    e = d.groupBy("way", "run", "piece").agg(F.min_by("node", "pos").alias("src"), F.max_by("to_node", "pos").alias("dst"),
                                             F.sum("len").alias("length_m"), F.min("pos").alias("pos"), pts.alias("_p"))
    shape = F.concat(F.array(F.struct(F.col("_p")[0]["lat"].alias("lat"), F.col("_p")[0]["lon"].alias("lon"), F.col("_p")[0]["node"].alias("node"))),
                     F.transform("_p", lambda x: F.struct(x.to_lat.alias("lat"), x.to_lon.alias("lon"), x.to_node.alias("node"))))
    # way and first position make a stable edge id, with room for a million positions and ways below 2^42 (arcs double the id); beyond that the job stops
    fits = (F.col("pos") < 1048576) & (F.abs("way") < 1 << 42)
    edge = F.when(fits, F.col("way") * 1048576 + F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("no edge id for way "), F.col("way").cast("string"))).cast("long"))
    return e.select("way", edge.alias("edge"), "src", "dst", "length_m", shape.alias("shape"))


def build_arcs(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """Each edge as one or two directed arcs; the mirror swaps ends, shape and side attributes."""
    attrs = [c for c in ways.columns if c not in ("refs", "tags", "way")]
    e = edges.join(ways.select("way", *attrs).hint("merge"), "way")
    e = e.withColumn("speed_kph", F.when((F.col("klass") == "ferry") & (F.col("duration_s") > 0),
                                         F.greatest(F.lit(1), F.round(F.col("length_m") / F.col("duration_s") * 3.6)).cast("int")).otherwise(F.col("speed_kph")))
    rest = [c for c in attrs if c not in ("bike_fwd", "bike_bwd", "dir")]
    fwd = e.filter("dir <> 'backward'").select((F.col("edge") * 2).alias("arc"), "edge", "way", "src", "dst", "length_m", "shape", *rest, F.col("bike_fwd").alias("bike"))
    bwd = e.filter("dir <> 'forward'").select((F.col("edge") * 2 + 1).alias("arc"), "edge", "way", F.col("dst").alias("src"), F.col("src").alias("dst"), "length_m",
                                              F.reverse("shape").alias("shape"), *rest, F.col("bike_bwd").alias("bike"))
    return fwd.unionByName(bwd)


def twin_arcs(arcs: DataFrame) -> DataFrame:
    """(arc, twin): the same road from its other end; null on one-way edges."""
    a = arcs.select("arc", "edge")
    return a.join(a.select(F.col("arc").alias("twin"), "edge").hint("merge"), "edge").groupBy("arc").agg(F.max(F.when(F.col("arc") != F.col("twin"), F.col("twin"))).alias("twin"))


# Fixed value: network -> strength of a signed bicycle route.
NETWORKS = {"ncn": 3, "icn": 3, "rcn": 2}


def bike_routes(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Strongest signed bicycle route of each way, with (fwd) and against (bwd) its direction."""
    net = F.create_map(*[F.lit(x) for k, v in NETWORKS.items() for x in (k, v)])
    r = relations.filter(F.element_at("tags", "route") == "bicycle").select(
        F.coalesce(F.try_element_at(net, F.coalesce(F.element_at("tags", F.lit("network")), F.lit(""))), F.lit(1)).alias("rank"), F.explode("members").alias("m")).filter("m.type = 'way'")
    per = r.groupBy(F.col("m.ref").alias("way")).agg(F.max(F.when(F.col("m.role") != "backward", F.col("rank"))).alias("fwd"),
                                                     F.max(F.when(F.col("m.role") != "forward", F.col("rank"))).alias("bwd"))
    return ways.select("way").join(per, "way").select("way", F.coalesce("fwd", F.lit(0)).alias("route_fwd"), F.coalesce("bwd", F.lit(0)).alias("route_bwd"))


def barrier_edges(edges: DataFrame, ways: DataFrame, barriers: DataFrame) -> DataFrame:
    """Access a barrier node imposes on the edges at it (edge, bicycle, foot, motor: worst of both ends).

    Where one way ends at the barrier and another passes through, only the ending way is guarded.
    """
    refs = ways.select("way", F.size("refs").alias("_n"), F.posexplode("refs").alias("pos", "node")).join(barriers.select("node"), "node", "left_semi")
    end = (F.col("pos") == 0) | (F.col("pos") == F.col("_n") - 1)
    role = refs.groupBy("node", "way").agg(F.min(end).alias("_ends"))
    both = role.groupBy("node").agg((F.max("_ends") & F.max(~F.col("_ends"))).alias("_mixed"))
    guards = role.join(both, "node").filter(~F.col("_mixed") | F.col("_ends")).select("node", "way")
    at = edges.select("edge", "way", F.explode(F.array("src", "dst")).alias("node"))
    rank = {"allowed": 0, "private": 1, "no": 2}
    m = F.create_map(*[F.lit(x) for k, v in rank.items() for x in (k, v)])
    j = at.join(guards, ["node", "way"]).join(barriers, "node")
    words = F.array(*[F.lit(k) for k in rank])
    return j.groupBy("edge").agg(*[F.get(words, F.max(F.element_at(m, F.col(f"imposed.{c}")))).alias(c) for c in ("bicycle", "foot", "motor")])


def signal_arcs(arcs: DataFrame, signals: DataFrame, reach_m: float = 30.0) -> DataFrame:
    """Arcs whose far end has a signal: at the node itself, or on the approach within reach of the end.

    Signals meet the shape by node id; the distance from a point to the edge's end is a cumulative length along one edge.
    """
    direct = arcs.join(signals.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_semi").select("arc")
    sh = arcs.select("arc", F.posexplode("shape").alias("pos", "p"))
    w = Window.partitionBy("arc").orderBy(F.col("pos").desc())
    back = sh.withColumn("_d", F.coalesce(geo.sphere_m(F.col("p.lat"), F.col("p.lon"), F.lag("p.lat").over(w), F.lag("p.lon").over(w)), F.lit(0.0)))
    back = back.withColumn("to_end", F.sum("_d").over(w)).filter(F.col("to_end") <= reach_m)
    near = back.join(signals.select(F.col("node").alias("_sn")).distinct().hint("merge"), F.col("p.node") == F.col("_sn")).filter(F.col("pos") > 0).select("arc")
    return direct.union(near).distinct()


def crossings(arcs: DataFrame, signal: DataFrame) -> DataFrame:
    """Crossing level met at each arc's end: the busiest other road there, if busier than the arc's own and unsignalled."""
    # the two strongest roads per node suffice: the arc's own edge may be one of them
    lv = arcs.select(F.explode(F.array("src", "dst")).alias("node"), "edge", tg.crossing_level(F.col("klass"), False).alias("lv"))
    per = lv.groupBy("node", "edge").agg(F.max("lv").alias("lv"))
    top = per.groupBy("node").agg(F.max(F.struct("lv", "edge")).alias("a"))
    second = per.join(top, "node").filter(F.col("edge") != F.col("a.edge")).groupBy("node").agg(F.max("lv").alias("b"))
    best = top.join(second, "node", "left").select("node", F.col("a.edge").alias("_e"), F.col("a.lv").alias("_lv"), F.coalesce("b", F.lit(0)).alias("_b"))
    own = tg.crossing_level(F.col("klass"), True)
    j = arcs.join(best.withColumnRenamed("node", "dst"), "dst").join(signal.withColumn("signal", F.lit(True)), "arc", "left")
    other = F.when(F.col("_e") == F.col("edge"), F.col("_b")).otherwise(F.col("_lv"))
    sig = F.coalesce("signal", F.lit(False))
    return j.select("arc", sig.alias("signal"), F.when(~sig & (other > own), other).otherwise(0).alias("crossing"))


def turn_restrictions(relations: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(via, from_arc, to_arc, kind) pairs, and a one-row count of unresolved, via-way and exempt relations."""
    t = F.col("tags")
    kind = F.element_at(t, F.lit("restriction"))
    r = relations.filter(kind.isNotNull()).select("id", F.when(kind.startswith("only_"), "only").otherwise("no").alias("kind"),
                                                  F.coalesce(F.element_at(t, F.lit("except")), F.lit("")).alias("exc"), "members")
    modes = F.transform(F.split("exc", ";"), lambda m: F.trim(m))
    exempt = F.arrays_overlap(modes, F.array(F.lit("motorcar"), F.lit("motor_vehicle"), F.lit("vehicle")))

    def member(role, typ):
        return F.get(F.filter("members", lambda m: (m.role == role) & (m.type == typ)), F.lit(0)).ref
    r = r.select("id", "kind", exempt.alias("exempt"), member("from", "way").alias("from_way"), member("via", "node").alias("via"), member("to", "way").alias("to_way"))
    live = r.filter(~F.col("exempt") & F.col("via").isNotNull())
    a = arcs.select("arc", "way", "src", "dst")
    fr = a.select(F.col("arc").alias("from_arc"), F.col("way").alias("from_way"), F.col("dst").alias("via"))
    to = a.select(F.col("arc").alias("to_arc"), F.col("way").alias("to_way"), F.col("src").alias("via"))
    pairs = live.join(fr.hint("merge"), ["from_way", "via"]).join(to.hint("merge"), ["to_way", "via"])
    lost = live.join(pairs.select("id").distinct().hint("merge"), "id", "left_anti").agg(F.count("*").alias("unresolved"))
    counts = r.agg(F.count_if(F.col("exempt")).alias("exempt"), F.count_if(~F.col("exempt") & F.col("via").isNull()).alias("via_way")).crossJoin(lost)
    return pairs.select("via", "from_arc", "to_arc", "kind").distinct(), counts


def build_stats(ways: DataFrame) -> DataFrame:
    """Conditional counts over all ways read, per class and in total (grouping sets)."""
    t = F.col("tags")
    d = ways.select(F.coalesce(tg.road_class(t), F.lit("none")).alias("klass"), tg.verdict(t).alias("v"), tg.truthy(tg.tag(t, "toll")).alias("toll"),
                    tg.direction(t, tg.road_class(t)).alias("dir"), tg.access(t, "bicycle", "vehicle", "access").alias("b"))
    return d.rollup("klass").agg(F.count("*").alias("ways"), F.count_if(F.col("v") == "kept").alias("kept"), F.count_if(F.col("v") == "no access").alias("no_access"),
                                 F.count_if(F.col("dir") != "both").alias("oneway"), F.count_if(F.col("b") == "private").alias("private_bicycle"))


def in_box(arcs: DataFrame, box: tuple) -> DataFrame:
    """Arcs whose shape touches a box."""
    lat, lon = F.transform("shape", lambda p: p.lat), F.transform("shape", lambda p: p.lon)
    b = (F.array_min(lat), F.array_min(lon), F.array_max(lat), F.array_max(lon))
    return arcs.filter(geo.box_intersects(b, tuple(F.lit(float(x)) for x in box)))


def tag_disagreements(ways: DataFrame, mine: dict[str, Column], theirs: dict[str, Column]) -> DataFrame:
    """Two readings of the same tags side by side; one row per way and field that differ."""
    cells = [F.struct(F.lit(k).alias("field"), mine[k].cast("string").alias("a"), theirs[k].cast("string").alias("b")) for k in mine]
    return ways.select("way", F.inline(F.array(*cells))).filter(~F.col("a").eqNullSafe(F.col("b")))
