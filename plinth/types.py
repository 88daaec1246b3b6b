"""The five column types of the dialect and their coercions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

TYPES: dict[str, T.DataType] = {
    "INT64": T.LongType(),
    "FLOAT64": T.DoubleType(),
    "STRING": T.StringType(),
    "BOOL": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
}


def struct(pairs: list[tuple[str, str]], not_null: tuple[str, ...] = ()) -> T.StructType:
    """A schema from (name, type name) pairs; repeated names are an error."""
    from plinth.errors import SchemaError

    names = [n for n, _ in pairs]
    if len(set(names)) != len(names):
        raise SchemaError(f"repeated column in {names}")
    return T.StructType([T.StructField(n, TYPES[t], n not in not_null) for n, t in pairs])


def coerce(c: Column, source: str, target: str) -> Column:
    """Cast between dialect types. Numbers truncate, booleans print as True/False, text is trimmed before it is parsed."""
    if target == "STRING" and source == "BOOL":
        return F.when(c, "True").when(~c, "False")
    if source == "STRING" and target in ("INT64", "FLOAT64"):
        return F.trim(c).cast(TYPES[target])
    if target == "TIMESTAMP" and source == "INT64":
        return F.timestamp_seconds(c)
    if target == "BOOL" and source == "INT64":
        return c != 0
    if source == target or target == "STRING" or {source, target} <= {"INT64", "FLOAT64", "BOOL"}:
        return c.cast(TYPES[target])
    raise TypeError(f"no coercion from {source} to {target}")


def family(t: T.DataType) -> str:
    """Columns compare, join and group only within one family."""
    if isinstance(t, T.NumericType):
        return "number"
    return t.typeName()
