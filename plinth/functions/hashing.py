"""Hash kernels. The 64-bit wrapping ones run on numpy, since ANSI bigint arithmetic raises on overflow."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Fixed values
FNV_OFFSET = 1469598103934665603
FNV_PRIME = 1099511628211
FMIX_1 = 0xFF51AFD7ED558CCD
FMIX_2 = 0xC4CEB9FE1A85EC53


def fnv1a64_bytes(values: list[bytes]) -> np.ndarray:
    """Byte-wise FNV-1a of many values at once: step i handles byte i of all values that are long enough."""
    lengths = np.fromiter((len(v) for v in values), np.int64, len(values))
    data = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    out = np.full(len(values), FNV_OFFSET, np.uint64)
    live = np.arange(len(values))
    for i in range(int(lengths.max(initial=0))):
        live = live[lengths[live] > i]
        out[live] = (out[live] ^ data[starts[live] + i]) * np.uint64(FNV_PRIME)
    return out


def fmix64_array(k: np.ndarray) -> np.ndarray:
    k = k.astype(np.uint64)
    for m in (FMIX_1, FMIX_2):
        k = (k ^ (k >> np.uint64(33))) * np.uint64(m)
    return k ^ (k >> np.uint64(33))


@F.pandas_udf(T.LongType())
def fnv1a64(s: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 text as a signed bigint; NULL stays NULL."""
    out = pd.Series(pd.array([None] * len(s), dtype="Int64"), index=s.index)
    there = s.notna()
    out[there] = fnv1a64_bytes([x.encode() for x in s[there]]).view(np.int64)
    return out


@F.pandas_udf(T.LongType())
def fmix64(k: pd.Series) -> pd.Series:
    out = pd.Series(pd.array([None] * len(k), dtype="Int64"), index=k.index)
    there = k.notna()
    out[there] = fmix64_array(k[there].to_numpy(np.int64).view(np.uint64)).view(np.int64)
    return out


def fingerprint(*columns: str) -> Column:
    """One 64-bit fingerprint of a value or a row key."""
    return F.xxhash64(*(F.col(c) for c in columns))


def partition_of(column: str, buckets: int) -> Column:
    if buckets <= 0:
        raise ValueError("buckets must be positive")
    return F.pmod(F.xxhash64(F.col(column)), F.lit(buckets))


def mod_partition(column: str, buckets: int) -> Column:
    """Integer key modulo buckets; keys of other types and NULL go to 0."""
    if buckets <= 0:
        raise ValueError("buckets must be positive")
    return F.coalesce(F.pmod(F.col(column).try_cast("bigint"), F.lit(buckets)), F.lit(0))
