"""SQL names for the main functions, as SQL-bodied functions so that Catalyst inlines them."""
from __future__ import annotations

from pyspark.sql import SparkSession

from .geo import EARTH_R, M_PER_DEG

SCALARS = {
    "normalize_lon": ("lon DOUBLE", "DOUBLE", "IF(pmod(lon + 180D, 360D) = 0, 180D, pmod(lon + 180D, 360D) - 180D)"),
    "great_circle_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
                       f"2 * {EARTH_R}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    "plane_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
                f"sqrt(pow((pmod(lon2 - lon1 + 180D, 360D) - 180D) * {M_PER_DEG!r}D * greatest(1e-6D, cos(radians(lat1))), 2) + pow((lat2 - lat1) * {M_PER_DEG!r}D, 2))"),
    # 180 degrees exactly lies in the last column, or unbounded in the one after it
    "tile_x": ("lon DOUBLE, z INT, bounded BOOLEAN DEFAULT true", "INT", "CAST(IF(bounded, least(greatest(floor((lon + 180D) / 360D * pow(2, z)), 0), pow(2, z) - 1), floor((lon + 180D) / 360D * pow(2, z))) AS INT)"),
    "tile_y": ("lat DOUBLE, z INT", "INT", "CAST(least(greatest(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * pow(2, z)), 0), pow(2, z) - 1) AS INT)"),
}
TABLES = {
    "tile_cover": ("s DOUBLE, w DOUBLE, n DOUBLE, e DOUBLE, z INT", "x INT, y INT",
                   "SELECT x, y FROM (SELECT explode(array_distinct(transform(sequence(CAST(floor((w + 180D) / 360D * pow(2, z)) AS INT), CAST(floor((e + IF(w > e, 540D, 180D)) / 360D * pow(2, z)) AS INT)), i -> pmod(i, CAST(pow(2, z) AS INT))))) AS x) a, "
                   "(SELECT explode(sequence(CAST(floor((1 - asinh(tan(radians(n))) / pi()) / 2 * pow(2, z)) AS INT), CAST(floor((1 - asinh(tan(radians(s))) / pi()) / 2 * pow(2, z)) AS INT))) AS y) b"),
}


def register(spark: SparkSession) -> None:
    """Create the temporary functions in this session."""
    for name, (args, out, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {out} RETURN {body}")
    for name, (args, out, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE ({out}) RETURN {body}")
