"""Connected groups of a graph held in a table of edges."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geolattice.session import written


def connected(edges: DataFrame) -> DataFrame:
    """`edges` (a, b), integers, to (node, root): the least node of each node's connected group.

    Every round each node takes the least label among its own and its neighbours', then the label of that label. Rounds go on until
    a round changes no label (an exact count), so groups are whole at any diameter; the doubling keeps the rounds few.
    Tables are written to the shared folder between rounds; a node with very many edges meets one label row in a join that Spark can split.
    """
    both = written(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "label")
    while True:
        offered = both.join(label, F.col("b") == F.col("node")).select("a", F.col("root").alias("offer")).groupBy("a").agg(F.min("offer").alias("offer"))
        lower = written(label.join(offered, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "offer").alias("root")), "lower")
        above = lower.select(F.col("node").alias("up"), F.col("root").alias("top"))
        label = written(lower.join(above, F.col("root") == F.col("up")).select("node", "was", F.least("root", "top").alias("root")), "label")
        if not label.where("root <> was").count():
            return label.select("node", "root")
