"""Tile layers of OpenStreetMap-like tags derived from parts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tile_layers as tl
from .derived import table
from .registry import query


def _pick(n: int, *values: str) -> str:
    return f"CASE k % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_TAGS = {
    "highway": _pick(23, "motorway", "trunk_link", "primary", "secondary_link", "tertiary", "residential", "track", "footway", "steps", "construction", "proposed", "raceway", "unclassified"),
    "construction": _pick(5, "motorway", "residential", "footway"), "railway": _pick(19, "rail", "narrow_gauge", "light_rail", "tram", "abandoned"), "usage": _pick(3, "main"), "service": _pick(7, "yard"),
    "natural": _pick(11, "wood", "scree", "beach"), "landuse": _pick(13, "forest", "meadow", "cemetery"), "amenity": _pick(17, "school", "cafe", "bar", "hospital"), "shop": _pick(29, "deli", "clothes", "toys"),
    "man_made": _pick(47, "mast", "tower", "pier"), "tower:type": _pick(2, "cooling"), "building": _pick(6, "yes", "house"), "height": _pick(4, "12.5", "x"), "building:levels": _pick(3, "4", "2"),
    "min_height": _pick(14, "3"), "place": _pick(9, "city", "town", "village", "country", "hamlet", "suburb"), "population": _pick(10, "4000000", "900000", "60000000", "9000", "3000", "300"),
    "capital": _pick(12, "yes", "4", "6", "no"), "disused": _pick(37, "yes"), "area": _pick(4, "yes"), "layer": _pick(31, "-1"), "public_transport": _pick(41, "platform"), "bridge": _pick(8, "yes", "no", "boardwalk"),
    "tunnel": _pick(5, "yes"), "ford": _pick(3, "yes"),
}
_REST = "k % 2 = 0 AS closed, (k*7919 % 100000)*1e3 AS area_m2"


def elements(spark, sf):
    d = table(spark, sf, "part").selectExpr("p_partkey AS k").selectExpr("k AS id", *[f"{e} AS `{n}`" for n, e in _TAGS.items()], *_REST.split(", "))
    pairs = F.array_compact(F.array(*[F.when(F.col(f"`{n}`").isNotNull(), F.struct(F.lit(n).alias("key"), F.col(f"`{n}`").alias("value"))) for n in _TAGS]))
    return d.select("id", F.explode(F.array(F.map_from_entries(pairs))).alias("tags"), "closed", "area_m2")


def _rules() -> str:
    rows, n = [], 0
    for line in tl.RULES.strip().splitlines():
        layer, keys, values, klass, zoom = line.split()
        for v in values.split(","):
            rows += [f"({n}, '{layer}', '{k}', '{v}', '{v if klass == '=' else k if klass == '@' else klass}', {'NULL' if zoom == '-' else zoom})" for k in keys.split(",")]
        n += 1
    return ", ".join(rows)


_AREA = "CASE " + " ".join(f"WHEN area_m2 > {(40075016.68557849 / 256 / 2 ** (z - 1)) ** 2!r}e0 THEN {z}" for z in range(6, 14)) + " ELSE 14 END"
E_SQL = "WITH e AS (SELECT k AS id, " + ", ".join(f'{e} AS "{n}"' for n, e in _TAGS.items()) + f", {_REST} FROM (SELECT p_partkey AS k FROM part))"
LAYERS = E_SQL + f""", r(nth, layer, key, value, klass, zoom) AS (VALUES {_rules()}), f AS (SELECT *, highway = 'construction' AND construction IS NOT NULL AS rises FROM e WHERE coalesce(disused, '') <> 'yes' AND coalesce(highway, '') <> 'proposed'),
 t AS (""" + " UNION ALL ".join(f"""SELECT id, '{n}' AS key, {"CASE WHEN rises THEN construction ELSE highway END" if n == "highway" else f'"{n}"'} AS value FROM f""" for n in _TAGS) + f"""),
 m AS (SELECT t.id, r.layer, r.klass, r.zoom, t.key, t.value FROM t JOIN r ON r.key = t.key AND (r.value = t.value OR r.value = '*') WHERE t.value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t.id, r.layer ORDER BY nth, t.key) = 1),
 x AS (SELECT m.*, f.*, m.layer AS lay, m.layer = 'transportation' AND ends_with(klass, '_link') AS ramp, list_position([{', '.join(f"'{p}'" for p in tl.POI_RANKS)}], klass) AS pos FROM m JOIN f ON f.id = m.id
   WHERE m.layer <> 'transportation' OR (NOT (m.key = 'public_transport' AND coalesce(try_cast(f.layer AS DOUBLE) < 0, false)) AND (NOT (closed AND (coalesce(area, '') = 'yes' OR coalesce(public_transport, '') = 'platform')) OR klass = 'path')))
 SELECT id, CASE WHEN lay IN ('railway', 'aerialway') THEN 'transportation' WHEN lay = 'poi' AND coalesce(nullif(pos, 0), 25) > 4 THEN 'poi_detail' ELSE lay END AS layer,
  CASE WHEN ramp THEN regexp_replace(klass, '_link$', '') ELSE klass END || CASE WHEN lay = 'transportation' AND coalesce(rises, false) THEN '_construction' ELSE '' END AS klass,
  CASE WHEN klass IN ('minor', 'path') OR lay IN ('railway', 'aerialway', 'poi') THEN value WHEN lay = 'man_made' THEN coalesce("tower:type", value) END AS subclass,
  CAST(CASE WHEN lay = 'railway' THEN CASE WHEN service IS NOT NULL THEN 14 WHEN value = 'rail' THEN CASE WHEN usage = 'main' THEN 8 ELSE 10 END WHEN value = 'narrow_gauge' THEN 10 WHEN value = 'light_rail' THEN 11 ELSE 14 END WHEN zoom IS NULL THEN {_AREA} ELSE zoom END AS INT) AS zoom,
  ramp, CAST(CASE WHEN lay = 'poi' THEN coalesce(nullif(pos, 0), 25) END AS INT) AS rank FROM x"""


@query("F26_tile_layers", LAYERS)
def _(spark, sf):
    return tl.classify(elements(spark, sf), tl.rules(spark))


_SEAT = "cap + CASE WHEN pop > 3000000 THEN -2 WHEN pop > 1000000 THEN -1 WHEN pop < 100000 THEN 2 ELSE 0 END + CASE place WHEN 'city' THEN 0 WHEN 'town' THEN 3 ELSE 5 END"
_SIZE = "CASE " + " ".join(f"WHEN pop > {n} THEN {r}" for n, r in tl.CITY_RANKS) + " ELSE 10 END"


@query("F26_places", E_SQL + f""", p AS (SELECT id, place, coalesce(try_cast(population AS DOUBLE), 0) AS pop, CASE capital WHEN 'yes' THEN 2 WHEN '4' THEN 4 WHEN '6' THEN 6 END AS cap FROM e WHERE place IS NOT NULL)
 SELECT id, place AS klass, CAST(CASE place WHEN 'country' THEN CASE WHEN pop > 50000000 THEN 1 WHEN pop > 20000000 THEN 2 ELSE 3 END WHEN 'city' THEN 5 WHEN 'town' THEN CASE WHEN pop > 8000 THEN 7 ELSE 8 END WHEN 'village' THEN CASE WHEN pop > 2000 THEN 9 ELSE 10 END WHEN 'suburb' THEN 11 WHEN 'hamlet' THEN 12 END AS INT) AS zoom,
 CAST(CASE WHEN place = 'country' THEN CASE WHEN pop > 50000000 THEN 1 WHEN pop > 20000000 THEN 2 ELSE 3 END WHEN cap BETWEEN 2 AND 4 THEN {_SEAT} WHEN place IN ('city', 'town') THEN {_SIZE} END AS INT) AS rank, CAST(cap AS INT) AS capital FROM p""")
def _(spark, sf):
    return tl.places(elements(spark, sf))


@query("F26_buildings", E_SQL + """, b AS (SELECT id, coalesce(try_cast(height AS DOUBLE), try_cast("building:levels" AS DOUBLE)*3.66e0, 3.66e0) AS h, coalesce(try_cast(min_height AS DOUBLE), 0e0) AS lo, CASE WHEN bridge IN ('yes', 'boardwalk') THEN 'bridge' WHEN tunnel = 'yes' THEN 'tunnel' WHEN ford = 'yes' THEN 'ford' END AS passage, building FROM e)
 SELECT id, CASE WHEN building IS NOT NULL THEN round(CASE WHEN h < lo THEN h + lo ELSE h END, 3) END AS height_m, CASE WHEN building IS NOT NULL THEN lo END AS base_m, passage FROM b WHERE building IS NOT NULL OR passage IS NOT NULL""")
def _(spark, sf):
    e = elements(spark, sf)
    d = tl.building_heights(e).join(tl.passage(e), "id", "full_outer")
    return d.select("id", F.round("height_m", 3).alias("height_m"), "base_m", "passage")
