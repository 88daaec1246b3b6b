"""Projection, filtering, limits, appends and access by position."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.errors import IngestError
from plinth.plans.shared import Scratch

#: Slices that end by this position are the first rows of an ordering, kept by each task; later ones are numbered.
HEAD = 100_000


def project(df: DataFrame, names: list[str]) -> DataFrame:
    return df if names == ["*"] else df.select(*(F.col(f"`{n}`") for n in names))


def keep(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows for which all predicates are TRUE; NULL rejects."""
    return df.where(functools.reduce(operator.and_, predicates)) if predicates else df


def between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Inclusive range scan; a missing bound is unbounded. The comparison reaches Parquet statistics."""
    c = F.col(column)
    return keep(df, c.isNotNull(), *([c >= F.lit(low)] if low is not None else []), *([c <= F.lit(high)] if high is not None else []))


def append(df: DataFrame, new: DataFrame, validator=None) -> DataFrame:
    """All rows of both. The batch must have the table's columns and types; a ``BatchValidator`` adds its own checks, NULLs in NOT NULL columns among them."""
    want, got = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in new.schema}
    problems = [f"column {c} is in one side only" for c in sorted(want.keys() ^ got.keys())]
    problems += [f"{c}: expected {want[c].simpleString()}, found {got[c].simpleString()}" for c in want if c in got and want[c] != got[c]]
    if validator:
        problems += validator.validate(new)
    if problems:
        raise IngestError("; ".join(problems[:5]))
    return df.unionByName(new)


def sequenced(df: DataFrame, keys: list[Column], name: str = "ordered") -> DataFrame:
    """The rows in the order of the keys, with their part (``_part``, from 0) and their place in it (``_local``, from 0).

    One range exchange, sorted and kept once in the shared folder: whatever reads
    it later sees the same parts, also after a lost executor.
    """
    taken = {"_part", "_local", "_id"} & set(df.columns)
    if taken:
        raise ValueError(f"columns called {sorted(taken)} must be renamed first")
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    kept = Scratch(df.sparkSession, name).keep(ranged, "rows")
    # monotonically increasing ids have the part in their upper bits, 33 bits for the place
    return kept.withColumns({"_part": F.shiftright("_id", 33), "_local": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def part_starts(parts: DataFrame, count: str = "_n", name: str = "_start") -> DataFrame:
    """The sum of ``count`` over the parts before each. One row per part, so the window is small whatever the table."""
    return parts.withColumn(name, F.sum(count).over(Window.orderBy("_part")) - F.col(count)).drop(count)


def with_position(df: DataFrame, key: str | list[Column], name: str = "row_id") -> DataFrame:
    """Positions 0..n-1 in the order of a column or of sort keys, without a global window. Ties get positions in any order among them, NULLs come first."""
    keys = [F.col(f"`{key}`").asc_nulls_first()] if isinstance(key, str) else key
    own = {c: f"_own{i}" for i, c in enumerate(df.columns) if c in ("_part", "_local", "_id", "_start", "_n")}
    if own:  # names that the numbering uses itself
        back = {v: k for k, v in own.items()}
        if not isinstance(key, str):
            raise ValueError(f"sort keys and columns called {sorted(own)} do not go together")
        numbered = with_position(df.withColumnsRenamed(own), own.get(key, key), name)
        return numbered.withColumnsRenamed(back)
    kept = sequenced(df, keys)
    starts = part_starts(kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")))
    return kept.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_local")).cast("bigint")).select(*(f"`{c}`" for c in df.columns), name)


def read_rows(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """The rows at positions start..stop-1, with ``row_id``."""
    start = max(0, start)
    if stop <= start:
        return df.limit(0).withColumn("row_id", F.lit(0).cast("bigint"))
    if stop > HEAD:
        return with_position(df, key).where((F.col("row_id") >= start) & (F.col("row_id") < stop))
    head = df.orderBy(F.col(f"`{key}`").asc_nulls_first()).limit(stop)
    order = Window.orderBy(F.col(f"`{key}`").asc_nulls_first())  # over at most HEAD rows
    return head.withColumn("row_id", (F.row_number().over(order) - 1).cast("bigint")).where(F.col("row_id") >= start)
