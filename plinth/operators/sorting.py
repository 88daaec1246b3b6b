"""Ordering and top-k. NULLs come first in both directions unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plinth.operators.relational import with_position


def key(name: str, descending: bool = False) -> Column:
    c = F.col(f"`{name}`")
    return c.desc_nulls_first() if descending else c.asc_nulls_first()


def order(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    return df.orderBy(*(key(n, d) for n, d in keys))


def top_k(df: DataFrame, column: str, k: int, tie_breaker: str, reverse: bool = False) -> DataFrame:
    """k first rows, NULLs first; reversed, k largest with NULLs last. Planned as TakeOrderedAndProject."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if reverse else c.asc_nulls_first(), F.col(tie_breaker)).limit(k)


def argsort(df: DataFrame, column: str, tie_breaker: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """Rank of each row, from 1, with NULLs first and ties by ``tie_breaker`` in ascending order."""
    return with_position(df, [key(column, descending), key(tie_breaker)], name).withColumn(name, F.col(name) + 1)
