"""Batch validation: one static schema comparison and one aggregate over the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from plinth.errors import IngestError, SchemaError


@dataclass
class BatchValidator:
    schema: T.StructType
    strict: bool = False

    def violations(self, df: DataFrame) -> DataFrame:
        """One row: for each NOT NULL column the number of NULLs in it."""
        must = [f.name for f in self.schema if not f.nullable and f.name in df.columns]
        return df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in must))

    def validate(self, df: DataFrame) -> list[str]:
        problems = [f"missing column {f.name}" for f in self.schema if f.name not in df.columns]
        if self.strict:
            problems += [f"{f.name}: expected {f.dataType.simpleString()}, found {df.schema[f.name].dataType.simpleString()}" for f in self.schema if f.name in df.columns and df.schema[f.name].dataType != f.dataType]
        row = self.violations(df).first().asDict()
        problems += [f"{k.removesuffix('_nulls')}: {v} NULLs in a NOT NULL column" for k, v in row.items() if k != "rows" and v]
        if self.strict and problems:
            raise IngestError("; ".join(problems[:5]))
        return problems

    def validate_columns(self, batch: dict[str, list]) -> list[str]:
        """The same for a small driver-side batch of columns, which must be equally long."""
        sizes = {len(v) for v in batch.values()}
        problems = [f"columns differ in length: {sorted(sizes)}"] if len(sizes) > 1 else []
        problems += [f"missing column {f.name}" for f in self.schema if f.name not in batch]
        problems += [f"{f.name}: NULL in a NOT NULL column" for f in self.schema if not f.nullable and any(v is None for v in batch.get(f.name, []))]
        if self.strict and problems:
            raise IngestError("; ".join(problems[:5]))
        return problems


def validate_row(schema: T.StructType, row: list) -> list:
    """Width, NOT NULL and coercion of one row."""
    if len(row) != len(schema):
        raise SchemaError(f"{len(row)} cells for {len(schema)} columns")
    out = []
    for f, v in zip(schema, row, strict=True):
        if v is None and not f.nullable:
            raise SchemaError(f"{f.name} is NOT NULL")
        make = {T.LongType: int, T.DoubleType: float, T.StringType: str, T.BooleanType: bool}.get(type(f.dataType), lambda x: x)
        out.append(None if v is None else make(v))
    return out
