"""JSON lines in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def events_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("event_id", T.LongType(), False),
            T.StructField("user_id", T.LongType()),
            T.StructField("region", T.StringType()),
            T.StructField("category", T.StringType()),
            T.StructField("amount", T.DoubleType()),
            T.StructField("ts", T.TimestampType()),
        ]
    )


def _cell(v: Column, kind: T.DataType, zero: bool) -> Column:
    """One field of a line from its JSON text. Text under a number, or a number under BOOL, is a mismatch."""
    quoted = F.get_json_object(v, "$")
    is_text, missing = v.startswith('"'), v.isNull() | (v == "null")
    if isinstance(kind, T.StringType):
        return F.when(~missing, F.when(is_text, quoted).otherwise(v))
    cast = {T.LongType: "bigint", T.DoubleType: "double", T.BooleanType: "boolean", T.TimestampType: "bigint"}[type(kind)]
    fits = v.isin("true", "false") if cast == "boolean" else v.rlike(r"^-?\d+$") if cast == "bigint" else v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    value = F.when(fits, v.try_cast(cast))
    if zero:
        value = F.coalesce(value, F.lit(0).cast(cast))
    return F.when(~missing, F.timestamp_seconds(value) if isinstance(kind, T.TimestampType) else value)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, mismatch: str = "null") -> DataFrame:
    """One object a line; blank lines are skipped, a malformed line fails, missing keys are NULL.

    A value of another type is NULL, or with ``mismatch='zero'`` the type's
    zero. Timestamps are epoch seconds.
    """
    text = T.StructType([T.StructField("_line", T.StringType())])
    lines = spark.read.schema(text).text(path).where(F.trim("_line") != "")
    fields = F.from_json("_line", "map<string,variant>", {"mode": "FAILFAST"})
    parsed = lines.select(fields.alias("m"))
    return parsed.select(*(_cell(F.to_json(F.col("m")[f.name]), f.dataType, mismatch == "zero").alias(f.name) for f in schema))
