"""OpenStreetMap tags to tile layers: a rule table looked up by (key, value), the first rule of each layer wins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Layer, key, the tag values, class (= : the value itself), least zoom (- : by area). In order of precedence inside a layer.
RULES = """
transportation highway motorway,trunk,primary = 4
transportation highway secondary,motorway_link,trunk_link = 9
transportation highway primary_link,secondary_link = 10
transportation highway tertiary,tertiary_link,busway,bus_guideway = 11
transportation highway unclassified,residential,road,living_street minor 12
transportation highway raceway = 12
transportation highway track,service = 13
transportation highway footway,cycleway,bridleway,path,steps,pedestrian,platform path 14
transportation public_transport platform path 14
railway railway rail,narrow_gauge,preserved,funicular rail 14
railway railway subway,light_rail,monorail,tram transit 14
aerialway aerialway * aerialway 12
landcover natural,landuse,leisure wood,forest wood -
landcover natural,landuse,leisure wetland wetland -
landcover natural,landuse,leisure beach,sand,dune sand -
landcover natural,landuse,leisure farmland,farm,orchard,vineyard,plant_nursery farmland -
landcover natural,landuse,leisure glacier,ice_shelf ice -
landcover natural,landuse,leisure bare_rock,scree rock -
landcover natural,landuse,leisure fell,grassland,grass,heath,meadow,allotments,park,village_green,recreation_ground,scrub,shrubbery,tundra,garden grass -
man_made man_made tower,communications_tower,water_tower,mast,lighthouse,windmill,watermill,silo,storage_tank,chimney,cooling_tower,observatory,obelisk,cross,flagpole = 10
building building * building 13
poi amenity townhall,public_building,courthouse,community_centre town_hall 12
poi leisure golf_course,miniature_golf golf 12
poi amenity fast_food,food_court fast_food 12
poi leisure park park 12
poi highway bus_stop bus 12
poi amenity bus_station bus 12
poi tourism camp_site,caravan_site campsite 12
poi shop supermarket,deli,delicatessen,department_store,greengrocer grocery 12
poi amenity library library 12
poi amenity university,college college 12
poi tourism hotel,motel,bed_and_breakfast,guest_house,hostel,chalet,alpine_hut lodging 12
poi amenity post_box,post_office post 12
poi amenity school,kindergarten school 12
poi amenity bar,nightclub bar 12
poi leisure marina harbor 12
poi amenity hospital,nursing_home,clinic hospital 12
poi landuse,amenity cemetery,grave_yard cemetery 12
poi tourism attraction,viewpoint attraction 12
poi leisure stadium stadium 12
poi shop bag,clothes clothing_store 12
poi shop * shop 12
poi amenity,tourism,leisure,historic,sport * @ 12
"""
# Ranks of classes of points of interest; others have 25. From rank 5 on they are details.
POI_RANKS = ("hospital railway bus attraction harbor college school stadium zoo town_hall campsite cemetery park library police post golf shop grocery fast_food clothing_store bar").split()
# Least zoom of places; towns and villages of so many people come a zoom or more before the others.
PLACES = {"continent": 0, "state": 4, "province": 5, "city": 5, "town": 8, "village": 10, "borough": 10, "suburb": 11, "quarter": 12, "hamlet": 12, "island": 12}
EARLIER = {"town": (8000, 7), "village": (2000, 9)}
COUNTRIES = [(50_000_000, 1), (20_000_000, 2), (-1, 3)]
CITY_RANKS = [(3_000_000, 1), (1_000_000, 2), (500_000, 3), (200_000, 4), (100_000, 5), (75_000, 6), (50_000, 7), (25_000, 8), (10_000, 9)]
#: Metres of a storey.
FLOOR_M = 3.66


def rules(spark: SparkSession, text: str = RULES) -> DataFrame:
    """The rule table: nth, layer, key, value (`*`: any), klass, zoom (null: by area)."""
    rows, n = [], 0
    for line in text.strip().splitlines():
        layer, keys, values, klass, zoom = line.split()
        for value in values.split(","):
            for key in keys.split(","):
                rows.append((n, layer, key, value, value if klass == "=" else key if klass == "@" else klass, None if zoom == "-" else int(zoom)))
            n += 1
    return spark.createDataFrame(rows, "nth int, layer string, key string, value string, klass string, zoom int")


def _tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def _number(name: str) -> Column:
    return F.trim(_tag(name)).try_cast("double")


def area_zoom(area_m2: Column, least: int = 0) -> Column:
    """The zoom from 6 to 13 at which an area covers a square of one tile row of 256 pixels at the zoom before, else 14; not below ``least``."""
    out = F.lit(14)
    for z in range(13, 5, -1):
        if z >= least:
            out = F.when(area_m2 > (40075016.68557849 / 256 / 2 ** (z - 1)) ** 2, z).otherwise(out)
    return out


def classify(elements: DataFrame, table: DataFrame) -> DataFrame:
    """Tile-layer rows (id, layer, klass, subclass, zoom, ramp, rank) of elements (id, tags, closed, area_m2); an element may be in several layers.

    Tags meet the rule table by key, exact values and `*` alike, in one broadcast lookup (the table is a parameter of a few hundred rows); the least rule of each layer is kept. Links lose their
    ending and are ramps, ways under construction take the class they will have, disused and proposed ones are in no layer; closed roads are left out but for footways. Rail shows
    from 8 on main lines, and earlier than 14 only where it is no service track. Points of interest of rank 5 and more go to `poi_detail`.
    """
    e = elements.filter((F.coalesce(_tag("disused"), F.lit("")) != "yes") & (F.coalesce(_tag("highway"), F.lit("")) != "proposed"))
    rises = F.coalesce((_tag("highway") == "construction") & _tag("construction").isNotNull(), F.lit(False))
    keyed = e.select("id", "tags", "closed", "area_m2", rises.alias("_rises"), F.explode("tags").alias("key", "value"))
    keyed = keyed.withColumn("value", F.when((F.col("key") == "highway") & F.col("_rises"), _tag("construction")).otherwise(F.col("value")))
    r = F.broadcast(table.select("nth", "layer", F.col("key").alias("_k"), F.col("value").alias("_v"), "klass", "zoom"))
    met = keyed.filter("value <> ''").join(r, (F.col("key") == F.col("_k")) & ((F.col("_v") == F.col("value")) | (F.col("_v") == "*")))
    first = met.groupBy("id", "layer").agg(F.min_by(F.struct("klass", "zoom", "key", "value", "tags", "closed", "area_m2", "_rises"), F.struct("nth", "key")).alias("m")).select("id", "layer", "m.*")
    link = (F.col("layer") == "transportation") & F.col("klass").endswith("_link")
    plain = F.when(link, F.regexp_replace("klass", "_link$", "")).otherwise(F.col("klass"))
    klass = F.when((F.col("layer") == "transportation") & F.col("_rises"), F.concat(plain, F.lit("_construction"))).otherwise(plain)
    area = F.col("closed") & ((F.coalesce(_tag("area"), F.lit("")) == "yes") | (F.coalesce(_tag("public_transport"), F.lit("")) == "platform"))
    sunk = (F.col("key") == "public_transport") & F.coalesce(_number("layer") < 0, F.lit(False))
    kept = (F.col("layer") != "transportation") | (~sunk & (~area | (F.col("klass") == "path")))
    side = F.coalesce(_tag("service"), F.lit("")) != ""
    rail = F.when(side, 14).when(F.col("value") == "rail", F.when(_tag("usage") == "main", 8).otherwise(10)).when(F.col("value") == "narrow_gauge", 10).when(F.col("value") == "light_rail", 11).otherwise(14)
    zoom = F.when(F.col("layer") == "railway", rail).when(F.col("zoom").isNull(), area_zoom(F.col("area_m2"))).otherwise(F.col("zoom"))
    rank = F.array_position(F.array(*[F.lit(x) for x in POI_RANKS]), F.col("klass"))
    rank = F.when(F.col("layer") == "poi", F.when(rank > 0, rank).otherwise(25).cast("int"))
    sub = F.when(F.col("klass").isin("minor", "path") | F.col("layer").isin("railway", "aerialway", "poi"), F.col("value")).when(F.col("layer") == "man_made", F.coalesce(_tag("tower:type"), F.col("value")))
    layer = F.when(F.col("layer").isin("railway", "aerialway"), "transportation").when(rank > 4, "poi_detail").otherwise(F.col("layer"))
    return first.filter(F.coalesce(kept, F.lit(True))).select("id", layer.alias("layer"), klass.alias("klass"), sub.alias("subclass"), zoom.cast("int").alias("zoom"), F.coalesce(link, F.lit(False)).alias("ramp"), rank.alias("rank"))


def places(elements: DataFrame) -> DataFrame:
    """Place rows (id, klass, zoom, rank, capital) of elements with a place tag: rank from population and, for capitals of a state or more, the level."""
    place, people = _tag("place"), F.coalesce(_number("population"), F.lit(0.0))
    capital = F.when(_tag("capital") == "yes", 2).otherwise(F.coalesce(_number("capital"), F.lit(0)).cast("int"))
    capital = F.when(capital != 0, capital)
    zoom = F.lit(13)
    for p, z in PLACES.items():
        here = F.when(people > EARLIER[p][0], EARLIER[p][1]).otherwise(z) if p in EARLIER else F.lit(z)
        zoom = F.when(place == p, here).otherwise(zoom)
    by_size, country = F.lit(10), F.lit(None).cast("int")
    for n, r in reversed(CITY_RANKS):
        by_size = F.when(people > n, r).otherwise(by_size)
    for n, r in reversed(COUNTRIES):
        country = F.when(people > n, r).otherwise(country)
    seat = capital + F.when(people > 3_000_000, -2).when(people > 1_000_000, -1).when(people < 100_000, 2).otherwise(0) + F.when(place == "city", 0).when(place == "town", 3).otherwise(5)
    rank = F.when(place == "country", country).when(capital.between(2, 4), seat).when(place.isin("city", "town"), by_size)
    return elements.filter(F.coalesce(place, F.lit("")) != "").select("id", place.alias("klass"), F.when(place == "country", country).otherwise(zoom).cast("int").alias("zoom"), rank.cast("int").alias("rank"), capital.alias("capital"))


def building_heights(elements: DataFrame) -> DataFrame:
    """(id, height_m, base_m) of buildings: tagged heights, else storeys, else one storey; one that would stand upside down stands on its base."""
    high = F.coalesce(_number("height"), _number("building:levels") * FLOOR_M, F.lit(FLOOR_M))
    base = F.coalesce(_number("min_height"), _number("building:min_level") * FLOOR_M, F.lit(0.0))
    return elements.filter(F.coalesce(_tag("building"), F.lit("")) != "").select("id", F.when(high < base, high + base).otherwise(high).alias("height_m"), base.alias("base_m"))


def passage(elements: DataFrame) -> DataFrame:
    """(id, passage): bridge, tunnel or ford of ways that are one."""
    bridge = F.coalesce(_tag("bridge"), F.lit(""))
    p = F.when((bridge != "") & (bridge != "no"), "bridge").when(_tag("man_made") == "bridge", "bridge").when(_tag("tunnel") == "yes", "tunnel").when(_tag("ford") == "yes", "ford")
    return elements.select("id", p.alias("passage")).filter(F.col("passage").isNotNull())
