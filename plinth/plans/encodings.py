"""Analytic forms of the column codecs and the advice which of them would pay. Parquet applies its own when it writes."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plinth.operators.relational import part_starts, sequenced


def _neighbours(df: DataFrame, column: str, order: str, partition: list[str]) -> DataFrame:
    """The rows in order, each with the value before it (``_prev``) and whether it begins its partition (``_first``).

    Parts are numbered by a range exchange. Inside one, a window sees the row
    before; across a border, the last row of the part before comes from a table
    of one row per part.
    """
    kept = sequenced(df.select(*dict.fromkeys((*partition, order, column))), [F.col(f"`{c}`").asc_nulls_first() for c in (*partition, order)])
    state = F.struct(F.col(f"`{column}`").alias("v"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(partition)))
    ends = kept.groupBy("_part").agg(F.max_by(state, "_local").alias("_end"))
    borders = ends.withColumn("_border", F.lag("_end").over(Window.orderBy("_part"))).select("_part", "_border")
    before = F.coalesce(F.lag(state).over(Window.partitionBy("_part").orderBy("_local")), F.col("_border"))
    rows = kept.join(F.broadcast(borders), "_part").withColumn("_before", before)
    same = functools.reduce(operator.and_, (F.col(f"_before.k{i}").eqNullSafe(F.col(f"`{c}`")) for i, c in enumerate(partition)), F.col("_before").isNotNull())
    return rows.withColumns({"_first": ~same, "_prev": F.when(same, F.col("_before.v"))}).drop("_before", "_border")


def delta(df: DataFrame, column: str, order: str, partition: list[str] | None = None) -> DataFrame:
    """First value and then differences; NULL stays NULL."""
    rows = _neighbours(df, column, order, partition or [])
    return rows.select(order, *(partition or []), (F.col(f"`{column}`") - F.when(F.col("_first"), F.lit(0)).otherwise(F.col("_prev"))).alias("delta"))


def _marked(df: DataFrame, column: str, order: str, partition: list[str]) -> DataFrame:
    """With 1 where a run begins."""
    return _neighbours(df, column, order, partition).withColumn("_new", (F.col("_first") | ~F.col(f"`{column}`").eqNullSafe(F.col("_prev"))).cast("int"))


def runs(df: DataFrame, column: str, order: str, partition: list[str] | None = None) -> DataFrame:
    """Runs of equal neighbours: first position, value, length."""
    keys = partition or []
    marked = _marked(df, column, order, keys)
    starts = part_starts(marked.groupBy("_part").agg(F.sum("_new").alias("_n")))
    inside = F.sum("_new").over(Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0))
    # a run over several parts meets as partial rows, at most one per part
    pieces = marked.withColumn("_inside", inside).groupBy("_part", "_inside", *keys).agg(F.min(order).alias("start"), F.first(column).alias("value"), F.count(F.lit(1)).alias("length"))
    numbered = pieces.join(F.broadcast(starts), "_part").withColumn("_run", F.col("_start") + F.col("_inside"))
    return numbered.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.first("value").alias("value"), F.sum("length").alias("length")).drop("_run")


def dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """Codes 0.. in order of first sight. Grouping comes first, so the window sees distinct values only."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first_seen"))
    return first.withColumn("code", (F.row_number().over(Window.orderBy("first_seen")) - 1).cast("bigint"))


def advise(kind: T.DataType, n: Column, distinct: Column, run_count: Column) -> Column:
    """Codec name from row, distinct and run counts."""
    if isinstance(kind, T.LongType | T.TimestampType):
        return F.when(n > 0, "delta").otherwise("raw")
    choice = F.when((n > 8) & (run_count < F.floor(n / 3)), "rle").otherwise("raw")
    return F.when((n > 0) & (distinct < F.greatest(F.lit(1), F.floor(n / 4))), "dict").otherwise(choice) if isinstance(kind, T.StringType) else choice


def choose_codec(df: DataFrame, column: str, order: str) -> DataFrame:
    marked = _marked(df, column, order, [])
    counts = marked.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(f"`{column}`").alias("distinct_values"), F.coalesce(F.sum("_new"), F.lit(0)).cast("bigint").alias("runs"))
    return counts.withColumn("codec", advise(df.schema[column].dataType, F.col("n"), F.col("distinct_values"), F.col("runs")))
