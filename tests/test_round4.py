import duckdb
from pyspark.sql import functions as F

from geolattice.plans.derived import rounded
from geolattice.sources import landed


def test_dted_cells_past_ninety_degrees(spark, tmp_path):
    landed.register(spark)
    p = spark.range(4).selectExpr("-91 AS w", "100 AS s", "id div 2 AS row", "id % 2 AS col", "id * 5D AS elev")
    landed.write_dted(p, f"file://{tmp_path}/dted")
    d = spark.read.format("landed").option("kind", "dted").load(f"file://{tmp_path}/dted").collect()
    assert sorted((r["cell"], r["level"], r["lat"], r["lon"], r["elev"]) for r in d) == [
        ("w091/n100", 1, 100.0, -91.0, 0.0), ("w091/n100", 1, 100.0, -90.0, 5.0), ("w091/n100", 1, 101.0, -91.0, 10.0), ("w091/n100", 1, 101.0, -90.0, 15.0)]



def test_costs_are_rounded_as_the_checks_round(spark):
    costs = spark.range(60000).select(F.round(100 + F.col("id") / 1000 + 0.0005, 6).alias("x"))
    d = costs.select("x", rounded(F.col("x"), 3).alias("y"), F.round("x", 3).alias("digits")).toPandas()
    want = duckdb.sql("SELECT round(x, 3) AS y FROM d").df()["y"]
    assert (d["y"] == want).all()
    assert (d["digits"] != want).any()     # the reason for it
