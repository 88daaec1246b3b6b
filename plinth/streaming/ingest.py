"""Continuous ingestion of JSON lines into Parquet; an extension beyond batch loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plinth.sources.jsonl import events_schema


def read_events_stream(spark: SparkSession, path: str) -> DataFrame:
    fields = [T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in events_schema()]
    return spark.readStream.schema(T.StructType(fields)).json(path).withColumn("ts", F.timestamp_seconds("ts"))


def append_stream(df: DataFrame, path: str, checkpoint: str):
    """Exactly-once append; processes what is there and stops."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(df: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return df.withWatermark("ts", late).groupBy(F.window("ts", width), "region").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
