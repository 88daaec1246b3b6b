"""Bitsets of row ids, as bitmaps per bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def build(df: DataFrame, row_id: str) -> DataFrame:
    """bucket, bits: one 4 KB bitmap for each 32768 ids."""
    return df.where(F.col(row_id).isNotNull()).groupBy(F.bitmap_bucket_number(row_id).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row_id)).alias("bits"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that are in both."""
    buckets = a.join(b.select("bucket"), "bucket", "left_semi").unionByName(b.join(a.select("bucket"), "bucket", "left_semi"))
    return buckets.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"))


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def get(bitmaps: DataFrame, row_id: int) -> bool:
    """Whether an id is set."""
    return bool(ids(bitmaps.where(F.col("bucket") == F.bitmap_bucket_number(F.lit(row_id)))).where(F.col("row_id") == row_id).limit(1).count())


def clear(bitmaps: DataFrame, row_ids: DataFrame) -> DataFrame:
    """Without the ids of a one-column table. Only the buckets they lie in are taken apart."""
    gone = row_ids.toDF("row_id").where(F.col("row_id").isNotNull()).distinct()
    touched = gone.select(F.bitmap_bucket_number("row_id").alias("bucket")).distinct()
    rest = build(ids(bitmaps.join(touched, "bucket", "left_semi")).join(gone, "row_id", "left_anti"), "row_id")
    return bitmaps.join(touched, "bucket", "left_anti").unionByName(rest)


def ids(bitmaps: DataFrame) -> DataFrame:
    """The set ids, one row each."""
    byte = F.conv(F.hex(F.substring("bits", F.col("_at") + 1, F.lit(1))), 16, 10).cast("int")
    cells = bitmaps.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.octet_length("bits") - 1)).alias("_at")).withColumn("_byte", byte).where("_byte > 0")
    bits = cells.select("bucket", "_at", "_byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_bit")).where(F.expr("bit_get(_byte, _bit) = 1"))
    place = F.col("_at") * 8 + F.col("_bit")  # positive ids count from bucket 1, the others downwards from bucket 0
    return bits.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + place + 1).otherwise(F.col("bucket") * 32768 - place).cast("bigint").alias("row_id"))


def popcount(bitmaps: DataFrame) -> DataFrame:
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("n"))
