"""Explicit Bloom filter: bits set per partition, merged on the executors, at most the filter's own size at the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plinth.functions.hashing import fmix64_array, fnv1a64_bytes

MAX_BITS = 1 << 30


@dataclass(frozen=True)
class BloomFilter:
    size: int
    hashes: int
    bits: bytes = b""

    @classmethod
    def sized(cls, expected: int, false_positives: float = 0.01) -> BloomFilter:
        if expected <= 0:
            return cls(64, 1)
        size = max(64, int(-expected * math.log(false_positives) / math.log(2) ** 2))
        if size > MAX_BITS:
            raise ValueError("this filter would exceed 128 MB; Spark's runtime filter joins are the way beyond it")
        return cls(size, min(12, max(1, int(size / expected * math.log(2)))))

    def places(self, texts: list[str]) -> np.ndarray:
        first = fnv1a64_bytes([t.encode() for t in texts])
        second = fmix64_array(first)
        steps = np.arange(self.hashes, dtype=np.uint64)
        return ((first[:, None] + steps * second[:, None]) % np.uint64(self.size)).astype(np.int64)

    def build(self, df: DataFrame, column: str) -> BloomFilter:
        """NULL is never a member."""
        size = (self.size + 7) // 8

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bits, seen = np.zeros(size * 8, np.uint8), False
            for b in batches:
                if len(b):
                    bits[self.places(b["v"].tolist()).ravel()], seen = 1, True
            if seen:
                yield pd.DataFrame({"bits": [np.packbits(bits, bitorder="little").tobytes()]})

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(size, np.uint8)
            for b in batches:
                for x in b["bits"]:
                    out |= np.frombuffer(x, np.uint8)
            yield pd.DataFrame({"bits": [out.tobytes()]})

        texts = df.select(F.col(column).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
        parts = texts.mapInPandas(partial, "bits binary").repartition(8).mapInPandas(merge, "bits binary")
        bits = np.zeros(size, np.uint8)
        for row in parts.toLocalIterator():
            bits |= np.frombuffer(row["bits"], np.uint8)
        return BloomFilter(self.size, self.hashes, bits.tobytes())

    def maybe_contains(self, text: str | None) -> bool:
        if text is None or not self.bits:
            return False
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places([text])[0].tolist())

    def fill_ratio(self) -> float:
        return sum(b.bit_count() for b in self.bits) / self.size

    def column(self, name: str) -> Column:
        """Membership as a boolean column; false positives only. Spark ships the bits to each executor once."""
        me = self

        @F.pandas_udf("boolean")
        def member(s: pd.Series) -> pd.Series:
            there = s.notna()
            out = pd.Series(False, index=s.index)
            if there.any() and me.bits:
                bits, p = np.frombuffer(me.bits, np.uint8), me.places(s[there].tolist())
                out[there] = ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=1)
            return out

        return member(F.col(name).cast("string"))
