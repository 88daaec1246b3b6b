"""Integer keys, and rows without those of some keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Keys that are sent to every executor at most (8 bytes each); more are joined by a shuffle.
MOST_SENT = 2_000_000


def integer_key(rows: DataFrame, key: str) -> Column:
    """The key as a bigint. Operators that order keys or pack them as numbers take whole-number columns only; any other is an error before a job runs."""
    kind = rows.schema[key].dataType
    if not isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        raise TypeError(f"{key} must be a whole-number column, not {kind.simpleString()}: number the rows first")
    return F.col(f"`{key}`").cast("bigint")


def without(docs: DataFrame, dropped: DataFrame, *keys: str) -> DataFrame:
    """docs whose keys are not in ``dropped`` (its columns in the same order). With one key, rows where it is null stay; several are compared null-safely. dropped is counted, so it should be a kept table."""
    few = dropped.limit(MOST_SENT + 1).count() <= MOST_SENT
    d = dropped.toDF(*(f"_dropped{i}" for i in range(len(keys))))
    same = [docs[f"`{k}`"] == d[c] if len(keys) == 1 else docs[f"`{k}`"].eqNullSafe(d[c]) for k, c in zip(keys, d.columns, strict=True)]
    return docs.join(F.broadcast(d) if few else d, same, "left_anti")


def doubtful(rows: DataFrame, key: str) -> bool:
    """Whether a key is null or repeats, so that it does not tell rows apart."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col(key).isNull()).limit(1).count() > 0
