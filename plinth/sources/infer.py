"""Type inference over a bounded sample, and schema merging."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from plinth.errors import SchemaError

COLUMN_SAMPLES = 20
WHOLE, FLOAT = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def _kind(text: str) -> T.DataType:
    if text.lower() in ("true", "false"):
        return T.BooleanType()
    if WHOLE.fullmatch(text) and -(2**63) <= int(text) < 2**63:
        return T.LongType()
    return T.DoubleType() if FLOAT.fullmatch(text) else T.StringType()


def infer_column(samples: list[str | None], mode: str = "all") -> T.DataType:
    """``all``: every sample must fit, integers widen to DOUBLE. ``first``: the first sample that is no plain text decides."""
    kinds = [_kind(s) for s in samples if s is not None and s.lower() not in ("", "null")][:COLUMN_SAMPLES]
    if mode == "first":
        return next((k for k in kinds if not isinstance(k, T.StringType)), T.StringType())
    found = set(kinds)
    if len(found) == 1:
        return kinds[0]
    return T.DoubleType() if found == {T.LongType(), T.DoubleType()} else T.StringType()


def infer_columns(columns: list[str], rows: list[dict], mode: str = "all") -> T.StructType:
    return T.StructType([T.StructField(c, infer_column([r.get(c) for r in rows], mode)) for c in columns])


def infer_from_rows(rows: list[dict]) -> T.StructType:
    """Richer form: BOOL if all of true/false/0/1, else DOUBLE if any float, else INT64 if all integers; nullable if a sample is missing."""
    fields = []
    for c in dict.fromkeys(k for r in rows[:100] for k in r):
        cells = [None if r.get(c) is None else str(r[c]) for r in rows[:100]]
        there = [s for s in cells if s not in (None, "")]
        if there and all(s.lower() in ("true", "false", "0", "1") for s in there):
            kind: T.DataType = T.BooleanType()
        elif there and all(FLOAT.fullmatch(s) for s in there):
            kind = T.LongType() if all(WHOLE.fullmatch(s) for s in there) else T.DoubleType()
        else:
            kind = T.StringType()
        fields.append(T.StructField(c, kind, len(there) < len(cells)))
    return T.StructType(fields)


def merge_schemas(a: T.StructType, b: T.StructType) -> T.StructType:
    """Names must agree in order; differing types become STRING."""
    if a.names != b.names:
        raise SchemaError(f"columns differ: {a.names}, {b.names}")
    return T.StructType([T.StructField(x.name, x.dataType if x.dataType == y.dataType else T.StringType(), x.nullable or y.nullable) for x, y in zip(a, b, strict=True)])
