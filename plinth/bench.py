"""The six micro-benchmarks, each to the noop sink after one warm-up."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from plinth.index import postings
from plinth.operators.relational import read_rows
from plinth.session import Engine


def timed(df: Callable[[], DataFrame], iterations: int) -> float:
    """Average seconds of planning and running."""
    run = lambda: df().write.format("noop").mode("overwrite").save()
    run()
    began = time.perf_counter()
    for _ in range(iterations):
        run()
    return (time.perf_counter() - began) / iterations


def run(engine: Engine, events: DataFrame, iterations: int = 5) -> dict[str, float]:
    engine.register("events", events, replace=True)
    users = engine.spark.range(1, 50_001).select("id", F.when(F.col("id") % 3 == 0, "pro").otherwise("free").alias("tier"))
    engine.register("users", users, replace=True)
    keys = engine.spark.range(5000).select(F.col("id").alias("user_id"))
    cases = {
        "groupby": lambda: engine.sql("SELECT region, COUNT(*) AS n, SUM(amount) AS total FROM events GROUP BY region"),
        "filter": lambda: engine.sql("SELECT event_id, user_id, amount FROM events WHERE amount > 100"),
        "sort": lambda: engine.sql("SELECT user_id, amount FROM events ORDER BY amount DESC LIMIT 100"),
        "hash_lookup": lambda: postings.probe(events, keys, ["user_id"]),
        "codec_slice": lambda: read_rows(events.select("event_id", "amount"), "event_id", 0, 64),
        "join": lambda: engine.sql("SELECT tier, COUNT(*) AS n FROM events JOIN users ON user_id = id GROUP BY tier"),
    }
    return {name: timed(f, iterations) for name, f in cases.items()}
