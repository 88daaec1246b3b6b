"""Zone maps: minimum, maximum and NULL count for each chunk of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plinth.operators.relational import with_position


def build(df: DataFrame, column: str, row_id: str, chunk_size: int = 8192) -> DataFrame:
    """Zones of consecutive rows in row-id order; chunks of only NULLs have none."""
    chunked = with_position(df.select(F.col(column).alias("_v"), row_id), row_id, "_pos").withColumn("chunk_id", F.floor(F.col("_pos") / chunk_size))
    return chunked.groupBy("chunk_id").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count_if(F.col("_v").isNull()).alias("null_count"), F.count(F.lit(1)).alias("row_count")).where(F.col("lo").isNotNull())


def candidates(zones: DataFrame, low=None, high=None) -> DataFrame:
    """Chunks that may hold values in the inclusive range; a missing bound is unbounded."""
    if low is not None:
        zones = zones.where(F.col("hi") >= F.lit(low))
    return zones.where(F.col("lo") <= F.lit(high)) if high is not None else zones
