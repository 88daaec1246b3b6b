"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``queries`` times each whole query, planning included, over opened tables.
``scaling`` repeats four of them on the events table copied 10 and 100 times
and gives seconds per million rows, which tells work from start-up.
"""

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from plinth import Engine, build_session
from plinth.index import postings
from plinth.queries import QUERIES

HEADLINE = ["flagship", "group_count_sum", "filter_and", "topk", "hash_lookup", "join_group", "group_multi", "having", "null_safe_join", "window_running_sum", "hash_postings", "inverted_df", "read_rows"]
SCALED = {
    "group_count_sum": lambda e: e.sql("SELECT event_type, COUNT(*) AS n, SUM(value) AS rev FROM many GROUP BY event_type"),
    "filter_and": lambda e: e.sql("SELECT event_id, value FROM many WHERE value > 50.0 AND event_type = 'click'"),
    "topk": lambda e: e.sql("SELECT event_id, value FROM many ORDER BY value DESC, event_id LIMIT 100"),
    "hash_lookup": lambda e: postings.lookup(e.table("many"), {"user_id": 7}, "event_id"),
}
RUNS = 3


def best(make) -> float:
    took = []
    for _ in range(RUNS + 1):  # the first compiles
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return min(took[1:])


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: round(best(lambda n=name: QUERIES[n](spark, sf_dir)), 4) for name in HEADLINE}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    rows, scaling = events.count(), {}
    with tempfile.TemporaryDirectory(prefix="bench-") as at:
        for times in (1, 10, 100):
            path = f"{at}/{times}"
            events.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy").repartition(int(cpus)).write.parquet(path)
            engine = Engine(spark, loader=lambda _, p=path: spark.read.parquet(p))
            scaling[rows * times] = {name: round(best(lambda f=f: f(engine)) / (rows * times / 1e6), 4) for name, f in SCALED.items()}
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "scaling_seconds_per_million_rows": scaling}))


if __name__ == "__main__":
    main()
