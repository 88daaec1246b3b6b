"""Row groups: rows of consecutive positions packed by column, each column with its zone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plinth.operators.relational import with_position

GROUP = 8192


def build(df: DataFrame, order: str, size: int = GROUP) -> DataFrame:
    """group_id, row_count, and for each column its values in order, its minimum and its maximum. A group has at most ``size`` rows."""
    rows = with_position(df, order, "_pos")
    packed = rows.groupBy(F.floor(F.col("_pos") / size).alias("group_id")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sort_array(F.collect_list(F.struct("_pos", F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("r")))).alias("_rows"),
        *(f(f"`{c}`").alias(f"{n}_{c}") for c in df.columns for n, f in (("min", F.min), ("max", F.max))),
    )
    return packed.select("group_id", "row_count", *(F.col("_rows")["r"][c].alias(c) for c in df.columns), *(f"`{n}_{c}`" for c in df.columns for n in ("min", "max")))


def candidates(groups: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Groups that may hold values in the inclusive range. A missing or NULL bound is unbounded; groups of only NULLs hold none."""
    lo, hi = F.col(f"`min_{column}`"), F.col(f"`max_{column}`")
    out = groups.where(lo.isNotNull()) if low is not None or high is not None else groups
    out = out.where(hi >= F.lit(low)) if low is not None else out
    return out.where(lo <= F.lit(high)) if high is not None else out


def rows(groups: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of the groups again, with group_id and place."""
    return groups.select("group_id", F.posexplode(F.arrays_zip(*(F.col(f"`{c}`").alias(c) for c in columns))).alias("place", "_r")).select("group_id", "place", *(F.col("_r")[c].alias(c) for c in columns))


def scan(groups: DataFrame, column: str, columns: list[str], low=None, high=None) -> DataFrame:
    """Exactly the rows in the range, from the candidate groups alone."""
    c = F.col(f"`{column}`")
    found = rows(candidates(groups, column, low, high), list(dict.fromkeys((*columns, column))))
    found = found.where(c >= F.lit(low)) if low is not None else found
    found = found.where(c <= F.lit(high)) if high is not None else found
    return found.select(*(f"`{x}`" for x in columns))


def read_column(groups: DataFrame, column: str) -> DataFrame:
    """group_id, place and value of one column; other columns are not read."""
    if column not in groups.columns:
        raise KeyError(column)
    return groups.select("group_id", F.posexplode(f"`{column}`").alias("place", column))


def read_cell(groups: DataFrame, column: str, group_id: int, place: int):
    found = groups.where(F.col("group_id") == group_id).select(F.get(f"`{column}`", F.lit(place)).alias("v"), "row_count").first()
    if found is None or not 0 <= place < found["row_count"]:
        raise IndexError((group_id, place))
    return found["v"]


def total_rows(groups: DataFrame) -> int:
    return groups.agg(F.coalesce(F.sum("row_count"), F.lit(0))).first()[0]
