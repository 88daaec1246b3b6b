"""Column statistics, and a cost estimate over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def collect(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    """One row per column: rows, nulls, distinct, min, max, average text width. ``approximate`` counts distinct values by sketch."""
    names = list(columns) or df.columns
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    aggs = []
    for c in names:
        x = F.col(f"`{c}`")
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("row_count"), F.count_if(x.isNull()).alias("null_count"), distinct(x).alias("distinct_count"), F.min(x).cast("string").alias("min_value"), F.max(x).cast("string").alias("max_value"), F.avg(F.length(x.cast("string"))).alias("avg_width")).alias(f"s_{c}"))
    return df.agg(*aggs).select(F.explode(F.array(*(F.col(f"`s_{c}`") for c in names))).alias("s")).select("s.*")


def table_stats(df: DataFrame, order: str, chunk_size: int = 8192, indexes: list[str] | None = None) -> DataFrame:
    """One row: rows, chunks (of all columns), encoded_bytes with the codec chosen for each chunk, raw_estimate, indexes (sorted names, comma-joined)."""
    from plinth.plans.codecs import chunked, encode

    sizes = None
    for c in df.columns:
        kind = df.schema[c].dataType
        plain = df if isinstance(kind, T.NumericType | T.StringType | T.BooleanType | T.TimestampType) else df.withColumn(c, F.col(f"`{c}`").cast("string"))
        one = encode(chunked(plain, c, order, chunk_size)).select("row_count", "encoded_size", F.lit(c == order).alias("_first"))
        sizes = one if sizes is None else sizes.unionByName(one)
    rows = F.coalesce(F.sum(F.when(F.col("_first"), F.col("row_count"))), F.lit(0))
    return sizes.agg(rows.alias("rows"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("encoded_size"), F.lit(0)).cast("bigint").alias("encoded_bytes"), (rows * len(df.columns) * 16).alias("raw_estimate"), F.lit(",".join(sorted(indexes or []))).alias("indexes"))


def join_order(sizes: dict[str, int]) -> list[str]:
    """Smallest first. Spark orders joins itself; this reports what that order would be."""
    return sorted(sizes, key=lambda n: (sizes[n], n))


# Factor of each plan step, rows assumed for an unknown table
COST = {"filter": 1.25, "project": 1.1, "aggregate": 2.0, "sort": 1.8, "limit": 0.5}
UNKNOWN_ROWS = 1000


def estimate(steps: list[str], rows: int | None = None) -> float:
    cost = float(UNKNOWN_ROWS if rows is None else rows)
    for s in steps:
        cost *= COST[s]
    return cost


def estimate_join(left: float, right: float) -> float:
    return (left + right) * 1.5 + min(left, right) * 1.2
