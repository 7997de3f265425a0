"""Line logs: one feed line per row, batch or stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _split(df: DataFrame) -> DataFrame:
    p = F.split("value", "\t", 4)
    return df.select(F.get(p, F.lit(0)).cast("long").alias("feed"), F.get(p, F.lit(1)).cast("double").alias("t"), F.get(p, F.lit(2)).cast("long").alias("seq"), F.get(p, F.lit(3)).alias("line"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated feed, arrival time, sequence and sentence."""
    return _split(spark.read.text(path))


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return _split(spark.readStream.text(path)).withColumn("ts", F.timestamp_seconds("t"))
