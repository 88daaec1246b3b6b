"""Append journal: JSON lines of (seq, table, payload), replayed in order.

Each append writes the rows of one batch as one line per row group, in
parallel; the batch number orders them. For continuous ingestion use
``plinth.streaming``, whose checkpoint is the durable form of this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

RECORD = "seq bigint, table string, payload string"


def append_insert(df: DataFrame, path: str, table: str, seq: int) -> None:
    line = df.select(F.lit(seq).cast("bigint").alias("seq"), F.lit(table).alias("table"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("payload"))
    line.write.mode("append").json(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """The records, in order of their batches; they are returned, not applied."""
    return spark.read.schema(RECORD).json(path).orderBy("seq")


def rows_of(records: DataFrame, table: str, schema) -> DataFrame:
    return records.where(F.col("table") == table).select("seq", F.from_json("payload", schema).alias("r")).select("seq", "r.*")
