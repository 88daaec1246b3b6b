"""Deterministic synthetic events.

The sequence is a 64-bit linear congruential generator with four draws a row.
k steps of it are one affine map, so every batch jumps straight to its first
row and the rows are made in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed values
REGIONS = ["us-east", "us-west", "eu-central", "ap-south", "ap-northeast"]
CATEGORIES = ["ads", "subscription", "marketplace", "storage", "compute"]
MULTIPLIER = 6364136223846793005
INCREMENT = 1442695040888963407
FIRST_SECOND = 1_700_000_000

WORD = (1 << 64) - 1
DRAWS = 4


def jump(k: int) -> tuple[int, int]:
    """(a, c) with state after k steps = a * state + c mod 2**64."""
    a, c, step_a, step_c = 1, 0, MULTIPLIER, INCREMENT
    while k:
        if k & 1:
            a, c = a * step_a & WORD, (c * step_a + step_c) & WORD
        step_a, step_c, k = step_a * step_a & WORD, (step_c * step_a + step_c) & WORD, k >> 1
    return a, c


def draws(seed: int, first: int, rows: int) -> np.ndarray:
    """The states of rows first..first+rows-1 as an array of rows x 4."""
    a, c = jump(first * DRAWS)
    state = (a * (seed or 1) + c) & WORD
    n = rows * DRAWS
    out = np.empty(n, np.uint64)
    if n:
        out[0] = (MULTIPLIER * state + INCREMENT) & WORD
    have = 1
    while have < n:  # doubles the known stretch: x[i + have] is x[i] after that many steps
        a, c = jump(have)
        m = min(have, n - have)
        out[have : have + m] = out[:m] * np.uint64(a) + np.uint64(c)
        have += m
    return out.reshape(rows, DRAWS)


def generate_events(spark: SparkSession, rows: int, start_id: int = 1, seed: int = 7, users: int = 50_000, amount: tuple[float, float] = (0.5, 500.0)) -> DataFrame:
    low, high = amount

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            ids = b["id"].to_numpy()
            x = draws(seed, int(ids[0]), len(ids))
            share = x[:, 3].astype(np.float64) / float(WORD)
            yield pd.DataFrame(
                {
                    "event_id": ids + start_id,
                    "user_id": (x[:, 0] % np.uint64(users)).astype(np.int64) + 1,
                    "region": np.array(REGIONS)[(x[:, 1] % np.uint64(len(REGIONS))).astype(np.int64)],
                    "category": np.array(CATEGORIES)[(x[:, 2] % np.uint64(len(CATEGORIES))).astype(np.int64)],
                    "amount": np.floor((low + share * (high - low)) * 100 + 0.5) / 100,
                    "seconds": FIRST_SECOND + ids + start_id,
                }
            )

    made = spark.range(rows).mapInPandas(make, "event_id long, user_id long, region string, category string, amount double, seconds long")
    return made.withColumn("ts", F.timestamp_seconds("seconds")).drop("seconds")


def write_sample_csv(spark: SparkSession, path: str, rows: int, seed: int = 7) -> None:
    from plinth.sources.csv import write_csv

    write_csv(generate_events(spark, rows, seed=seed, users=5000, amount=(1.0, 250.0)), path)
