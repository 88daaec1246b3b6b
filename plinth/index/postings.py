"""Hash, composite and ordered indexes."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, functions as F


def build(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Key to ascending row ids; rows with a NULL key are left out."""
    return df.dropna(subset=keys).groupBy(*keys).agg(F.sort_array(F.collect_list(row_id)).alias("row_ids"))


def build_chunks(df: DataFrame, key: str, row_id: str, span: int = 1 << 16) -> DataFrame:
    """The same for integer row ids in bounded rows: key, chunk, ascending ids from chunk x span on. A hot key has many rows instead of one long list."""
    return df.dropna(subset=[key]).groupBy(F.col(f"`{key}`"), F.floor(F.col(f"`{row_id}`") / span).alias("chunk")).agg(F.sort_array(F.collect_set(f"`{row_id}`")).alias("row_ids"))


def lookup(df: DataFrame, key: dict[str, object], row_id: str) -> DataFrame:
    """Row ids of one key, ascending. The equality is pushed to the scan."""
    return df.where(functools.reduce(operator.and_, (F.col(c) == F.lit(v) for c, v in key.items()))).select(row_id).orderBy(row_id)


def contains(df: DataFrame, column: str, value) -> bool:
    return bool(df.where(F.col(column) == F.lit(value)).limit(1).count())


def probe(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows with any of many keys."""
    return df.join(keys.select(*on).dropna().distinct(), on, "left_semi")


def entry_count(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys)).agg(F.countDistinct(*keys).alias("entries"))


def bucket_count(df: DataFrame, column: str, buckets: int) -> DataFrame:
    return df.where(F.col(column).isNotNull()).agg(F.countDistinct(F.pmod(F.xxhash64(column), F.lit(buckets))).alias("buckets"))


def ordered(df: DataFrame, column: str, path: str) -> DataFrame:
    """Sorted Parquet copy: range scans of it skip row groups by their statistics."""
    df.where(F.col(column).isNotNull()).repartitionByRange(column).sortWithinPartitions(column).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def range_scan(df: DataFrame, column: str, row_id: str, low=None, high=None) -> DataFrame:
    from plinth.operators.relational import between

    return between(df, column, low, high).orderBy(column, row_id)
