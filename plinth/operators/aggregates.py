"""The five aggregates with the dialect's semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plinth.errors import PlanError


def build(fn: str, column: str, kind: T.DataType, count_includes_nulls: bool = False) -> Column:
    c = F.col(f"`{column}`")
    if fn == "count":
        return F.count(F.lit(1)) if count_includes_nulls else F.count(c)
    if fn in ("sum", "avg"):
        if not isinstance(kind, T.NumericType):
            raise PlanError(f"{fn.upper()} needs a number, {column} is {kind.simpleString()}")
        return F.coalesce(F.sum(c.cast("double")), F.lit(0.0)) if fn == "sum" else F.avg(c.cast("double"))
    return {"min": F.min, "max": F.max}[fn](c)


def over_star(fn: str) -> Column:
    """COUNT(*) counts rows; the others have no argument and are NULL."""
    return F.count(F.lit(1)) if fn == "count" else F.max(F.lit(None).cast("double"))


def group(df: DataFrame, keys: list[str], made: dict[str, Column]) -> DataFrame:
    """Grouped or global aggregate. Spark combines on the map side; NULL is a group; a global aggregate has one row even on no input."""
    aggs = [c.alias(n) for n, c in made.items()]
    if not keys:
        return df.agg(*aggs)
    by = df.groupBy(*(F.col(f"`{k}`") for k in keys))
    return by.agg(*aggs) if aggs else df.select(*(F.col(f"`{k}`") for k in keys)).distinct()


def having(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)
