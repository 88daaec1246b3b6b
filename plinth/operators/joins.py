"""Inner equi-joins on one key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plinth.errors import PlanError
from plinth.types import family


def _same_kind(left: DataFrame, right: DataFrame, lk: str, rk: str) -> None:
    a, b = left.schema[lk].dataType, right.schema[rk].dataType
    integral = {"long", "integer", "short", "byte"}
    kinds = ["integer" if t.typeName() in integral else t.typeName() for t in (a, b)]
    if family(a) != family(b) or kinds[0] != kinds[1]:
        raise PlanError(f"join keys differ in type: {a.simpleString()}, {b.simpleString()}")


def hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, strategy: str = "hash", merge_names: bool = False) -> DataFrame:
    """Null-safe equi-join. Columns of the right side are called ``{right_key}__{column}``.

    ``merge_names`` leaves those right-hand names bare that do not clash, for
    the ordinary JOIN form. No side is broadcast by hint: Spark and adaptive
    execution decide by measured size.
    """
    _same_kind(left, right, left_key, right_key)
    taken = set(left.columns)
    names = {c: c if merge_names and c not in taken else f"{right_key}__{c}" for c in right.columns}
    r = right.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    if strategy not in ("hash", "nested", "auto"):
        raise PlanError(f"unknown join strategy {strategy!r}")
    return left.join(r, left[f"`{left_key}`"].eqNullSafe(r[f"`{names[right_key]}`"]), "inner")


def nested_loop_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The same relation with all columns prefixed ``l.`` and ``r.``. An equality needs no cartesian product, so Spark plans it as any equi-join."""
    _same_kind(left, right, left_key, right_key)
    l = left.select(*(F.col(f"`{c}`").alias(f"l.{c}") for c in left.columns))
    r = right.select(*(F.col(f"`{c}`").alias(f"r.{c}") for c in right.columns))
    return l.join(r, F.col(f"`l.{left_key}`").eqNullSafe(F.col(f"`r.{right_key}`")), "inner")
