"""CSV in and out. Cells are read as text and parsed by one projection, so the rules do not depend on Spark's own inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plinth.errors import IngestError
from plinth.sources.infer import infer_columns

SAMPLE_ROWS = 100


def parse_value(c: Column, kind: T.DataType) -> Column:
    """Empty and ``null`` are NULL, bad numbers are NULL, booleans are true for 1/true/yes, timestamps are epoch seconds."""
    missing = c.isNull() | F.lower(c).isin("", "null")
    whole = F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))
    if isinstance(kind, T.LongType):
        value = whole
    elif isinstance(kind, T.DoubleType):
        value = F.when(~c.rlike(r"^\s|\s$"), c.try_cast("double"))
    elif isinstance(kind, T.BooleanType):
        value = F.lower(c).isin("1", "true", "yes")
    elif isinstance(kind, T.TimestampType):
        value = F.timestamp_seconds(whole)
    else:
        value = c
    return F.when(~missing, value)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, inference: str = "all") -> DataFrame:
    """A CSV with header; columns map by position. Without a schema the first rows decide the types; ragged rows fail."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    if not raw.columns:
        raise IngestError(f"{path}: no header")
    if schema is None:
        sample = [r.asDict() for r in raw.limit(SAMPLE_ROWS).collect()]
        schema = infer_columns(raw.columns, sample, mode=inference)
    if len(schema) != len(raw.columns):
        raise IngestError(f"{path}: {len(raw.columns)} columns for a schema of {len(schema)}")
    return raw.select(*(parse_value(F.col(f"`{c}`"), f.dataType).alias(f.name) for c, f in zip(raw.columns, schema, strict=True)))


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Timestamps leave as epoch seconds, as ``read_csv`` takes them."""
    stamps = {f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)}
    df.select(*(F.unix_seconds(c).alias(c) if c in stamps else F.col(c) for c in df.columns)).write.mode(mode).option("header", True).csv(path)
