"""How tables lie on disk: partitions, buckets, sorted files, Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plinth.functions.hashing import mod_partition, partition_of


def route(df: DataFrame, column: str, buckets: int = 8, kind: str = "hash") -> DataFrame:
    """Adds the partition id of each row: by hash, or by integer key modulo buckets."""
    return df.withColumn("partition_id", (partition_of if kind == "hash" else mod_partition)(column, buckets))


def partition_rows(df: DataFrame, column: str, buckets: int = 8, kind: str = "hash") -> DataFrame:
    return route(df, column, buckets, kind).groupBy("partition_id").agg(F.count(F.lit(1)).alias("row_count"))


def write_partitioned(df: DataFrame, path: str, column: str, buckets: int = 8, kind: str = "hash") -> None:
    routed = route(df, column, buckets, kind)
    routed.repartition("partition_id").write.mode("overwrite").partitionBy("partition_id").parquet(path)


def write_sorted(df: DataFrame, path: str, column: str, row_group_bytes: int = 128 << 20, bloom: list[str] | None = None) -> None:
    """Range-partitioned and sorted files, so that row-group statistics prune range scans; optional Parquet Bloom filters."""
    w = df.repartitionByRange(column).sortWithinPartitions(column).write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    for c in bloom or []:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    w.parquet(path)
