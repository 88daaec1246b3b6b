"""Timers, and row counts observed while a query runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, functions as F


class Metrics:
    def __init__(self) -> None:
        self.totals: dict[str, list[float]] = {}

    def record(self, name: str, seconds: float) -> None:
        self.totals.setdefault(name, []).append(seconds)

    @contextmanager
    def time(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record(name, time.perf_counter() - began)

    def average_ms(self, name: str) -> float:
        v = self.totals.get(name, [])
        return 1000 * sum(v) / len(v) if v else 0.0

    def report(self) -> list[tuple[str, int, float]]:
        """(name, calls, total seconds), the largest total first."""
        return sorted(((n, len(v), round(sum(v), 3)) for n, v in self.totals.items()), key=lambda r: -r[2])


#: Where to look first when one of these is slow.
PROFILE_TARGETS = {
    "groupby": "plinth.operators.aggregates.group",
    "filter": "plinth.operators.relational.keep",
    "codec": "plinth.plans.codecs.decode_range",
    "scan": "plinth.session.Engine.table",
    "hash": "plinth.index.postings.lookup",
}


def time_call(call: Callable[[], object], iterations: int = 5) -> tuple[float, object]:
    """Average seconds of at least one call, and the last result."""
    n = max(1, iterations)
    began = time.perf_counter()
    for _ in range(n):
        out = call()
    return (time.perf_counter() - began) / n, out


def batches(items: list, size: int) -> list[list]:
    """Lists of ``size`` items, the last one shorter."""
    if size <= 0:
        raise ValueError("size must be positive")
    return [items[i : i + size] for i in range(0, len(items), size)]


def flatten(lists: list[list]) -> list:
    return [x for part in lists for x in part]


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows; after an action ``observation.get['rows']`` is their number, without a second pass."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o
