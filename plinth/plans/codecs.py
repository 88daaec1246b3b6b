"""Column chunks encoded and decoded as DataFrames: raw, delta, run-length and dictionary, with slices and sizes.

A chunk is a row that holds the values of at most ``CHUNK`` consecutive
positions of a column, so every list is bounded. Encoding is array functions in
the JVM; decoding gives back one row per value. NULLs survive every codec
(delta keeps their places apart). Chunks are independent, so a slice decodes
only the chunks it touches, and of a delta chunk the stretch up to its end.
``encoded_size`` is the number of bytes that the chunk's byte form takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plinth.operators.relational import with_position
from plinth.plans.encodings import advise

CHUNK, MOST = 8192, 65_535
CODECS = ("raw", "delta", "rle", "dict")


def chunked(df: DataFrame, column: str, order: str, size: int = CHUNK) -> DataFrame:
    """chunk_id, values: the column in the order of ``order``, ``size`` values to a row."""
    if not 0 < size <= MOST:
        raise ValueError(f"a chunk has 1 to {MOST} values")
    rows = with_position(df.select(F.col(f"`{order}`").alias("_order"), F.col(f"`{column}`").alias("value")), "_order", "pos")
    packed = rows.groupBy(F.floor(F.col("pos") / size).alias("chunk_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_rows"))
    return packed.select("chunk_id", F.col("_rows.value").alias("values"))


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _value_size(v: Column, kind: T.DataType) -> Column:
    """Bytes of one value: a tag, then 8 bytes, or 1, or a length of 4 and the text."""
    size = F.lit(2) if isinstance(kind, T.BooleanType) else F.octet_length(v) + 5 if isinstance(kind, T.StringType) else F.lit(9)
    return F.when(v.isNull(), 1).otherwise(size).cast("bigint")


def _total(values: Column, size) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, v: s + size(v))


def encode(chunks: DataFrame, codec: str = "auto") -> DataFrame:
    """chunk_id, row_count, codec, encoded_size and the chunk's data: raw, deltas, runs or dictionary and codes. ``auto`` decides for each chunk by its distinct values and runs."""
    kind = chunks.schema["values"].dataType.elementType
    whole = isinstance(kind, T.LongType | T.IntegerType | T.ShortType | T.ByteType | T.TimestampType)
    if codec not in ("auto", *CODECS):
        raise ValueError(f"unknown codec {codec!r}")
    if codec == "delta" and not whole:
        raise ValueError("delta needs integers or timestamps")
    x = F.col("values")
    n = F.size(x)
    rows = chunks.select("chunk_id", "values", n.cast("bigint").alias("row_count"))
    rows = rows.withColumn("_starts", F.filter(_places(n), lambda i: (i == 0) | ~x[i].eqNullSafe(F.get(x, i - 1))))
    rows = rows.withColumn("_distinct", F.array_distinct(x))
    chosen = F.lit(codec) if codec != "auto" else advise(T.LongType() if whole else kind, F.col("row_count"), F.size(F.filter("_distinct", lambda v: v.isNotNull())), F.size("_starts"))
    rows = rows.withColumn("codec", chosen)
    is_ = lambda c: F.col("codec") == c
    ends = F.concat(F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), F.array(n))
    # exact beyond 64 bits, so that no difference overflows
    number = (lambda v: F.unix_micros(v)) if isinstance(kind, T.TimestampType) else (lambda v: v)
    filled = F.transform(x, lambda v: F.coalesce(number(v).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")))
    deltas = F.transform(filled, lambda v, i: (v - F.when(i > 0, F.get(filled, i - 1)).otherwise(F.lit(0))).cast("decimal(21,0)"))
    out = rows.select(
        "chunk_id", "row_count", "codec",
        F.when(is_("raw"), x).alias("raw"),
        *([F.when(is_("delta"), deltas).alias("deltas"), F.when(is_("delta"), F.filter(_places(n), lambda i: x[i].isNull())).alias("nulls")] if whole else []),
        F.when(is_("rle"), F.transform(F.arrays_zip(F.col("_starts").alias("start"), ends.alias("stop")), lambda r: F.struct(x[r["start"]].alias("value"), (r["stop"] - r["start"]).alias("length")))).alias("runs"),
        F.when(is_("dict"), F.col("_distinct")).alias("dictionary"),
        F.when(is_("dict"), F.transform(x, lambda v: F.when(v.isNull(), F.array_position(F.transform("_distinct", lambda d: d.isNull()), True)).otherwise(F.array_position("_distinct", v)).cast("int") - 1)).alias("codes"),
    )
    size = lambda v: _value_size(v, kind)
    sizes = F.when(is_("raw"), _total(F.col("raw"), size)).when(is_("rle"), _total(F.col("runs"), lambda r: size(r["value"]) + 3)).when(is_("dict"), _total(F.col("dictionary"), lambda v: size(v) + 2) + 4 + 4 * F.col("row_count"))
    return out.withColumn("encoded_size", F.when(is_("delta"), 8 * F.col("row_count")).otherwise(sizes))


def decode(encoded: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """chunk_id, pos, value: the values at places start..stop-1 of each chunk, in any row order."""
    kind = encoded.schema["raw"].dataType.elementType
    top = F.lit(MOST if stop is None else stop)
    parts = [
        encoded.where("codec = 'raw'").select("chunk_id", F.posexplode("raw").alias("pos", "value")),
        encoded.where("codec = 'dict'").select("chunk_id", "dictionary", F.posexplode("codes").alias("pos", "_c")).select("chunk_id", "pos", F.get("dictionary", F.col("_c")).alias("value")),
        encoded.where("codec = 'rle'").select("chunk_id", F.posexplode(F.flatten(F.transform("runs", lambda r: F.array_repeat(r["value"], r["length"])))).alias("pos", "value")),
    ]
    if "deltas" in encoded.columns:
        steps = encoded.where("codec = 'delta'").select("chunk_id", "nulls", F.posexplode("deltas").alias("pos", "_d")).where(F.col("pos") < top)
        total = F.sum("_d").over(Window.partitionBy("chunk_id").orderBy("pos")).cast("bigint")
        back = F.timestamp_micros(total) if isinstance(kind, T.TimestampType) else total.cast(kind)
        parts.append(steps.withColumn("value", F.when(~F.array_contains("nulls", F.col("pos")), back)).select("chunk_id", "pos", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where((F.col("pos") >= start) & (F.col("pos") < top))


def decode_range(encoded: DataFrame, start: int, stop: int, size: int = CHUNK) -> DataFrame:
    """pos, value at positions start..stop-1 of the column; bounds beyond it give what there is. Only the chunks in question are read."""
    if stop <= start:
        return decode(encoded).select("pos", "value").limit(0)
    near = encoded.where(F.col("chunk_id").between(max(0, start) // size, (stop - 1) // size))
    whole = decode(near).select((F.col("chunk_id") * size + F.col("pos")).alias("pos"), "value")
    return whole.where((F.col("pos") >= start) & (F.col("pos") < stop))


def get(encoded: DataFrame, position: int, size: int = CHUNK):
    """One value; an index that no chunk holds is an error."""
    found = decode_range(encoded, position, position + 1, size).collect()
    if not found:
        raise IndexError(position)
    return found[0]["value"]


def compression_ratio(encoded: DataFrame, raw_bytes: int) -> float:
    """Encoded bytes to raw ones, 1.0 where there are none."""
    return (encoded.agg(F.sum("encoded_size")).first()[0] or 0) / raw_bytes if raw_bytes else 1.0
