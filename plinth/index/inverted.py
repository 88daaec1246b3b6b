"""Inverted text index: lower-cased tokens of ASCII letters and digits, one posting per token and row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def build(df: DataFrame, text: str, row_id: str) -> DataFrame:
    tokens = F.array_distinct(F.split(F.lower(F.col(text)), "[^a-z0-9]+"))  # empty before a leading or after a trailing separator
    return df.select(F.explode(F.array_remove(tokens, "")).alias("token"), F.col(row_id).alias("row_id"))


def search(postings: DataFrame, term: str) -> DataFrame:
    return postings.where(F.col("token") == term.lower()).select("row_id").orderBy("row_id")


def search_and(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Rows that hold all terms; no terms, no rows."""
    want = sorted({t.lower() for t in terms})
    hits = postings.where(F.col("token").isin(want)) if want else postings.limit(0)
    return hits.groupBy("row_id").agg(F.countDistinct("token").alias("_n")).where(F.col("_n") == len(want)).select("row_id").orderBy("row_id")


def term_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


def vocabulary_size(postings: DataFrame) -> DataFrame:
    return postings.agg(F.countDistinct("token").alias("tokens"))
