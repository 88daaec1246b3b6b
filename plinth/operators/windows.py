"""Row numbers and running sums. Give partition keys: without any, all rows meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _spec(partition: list[str], order: list[str]):
    spec = Window.partitionBy(*partition) if partition else Window
    return spec.orderBy(*(F.col(c).asc_nulls_first() for c in order))


def row_number(partition: list[str], order: list[str]) -> Column:
    return F.row_number().over(_spec(partition, order)).cast("bigint")


def running_sum(column: str, partition: list[str], order: list[str]) -> Column:
    """Cumulative DOUBLE from 0.0; NULL carries the total forward."""
    return F.sum(F.coalesce(F.col(column).cast("double"), F.lit(0.0))).over(_spec(partition, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def with_row_number(df: DataFrame, partition: list[str], order: list[str], name: str = "row_number") -> DataFrame:
    return df.withColumn(name, row_number(partition, order))
