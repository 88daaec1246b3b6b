"""Command line: ingest, generate, query, bench, tables. Tables persist in a warehouse folder of Parquet."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from plinth.errors import IngestError, PlinthError
from plinth.index import postings
from plinth.index.bloom import BloomFilter
from plinth.result import format_table
from plinth.session import Engine, build_session
from plinth.sources.csv import read_csv
from plinth.sources.generate import generate_events
from plinth.sources.jsonl import events_schema, read_jsonl

DEMO_ROWS = 5000


def load(spark, path: str):
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("jsonl", "ndjson"):
        return read_jsonl(spark, path, events_schema())
    raise IngestError(f"{path}: only csv, jsonl and ndjson can be read")


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="plinth")
    top.add_argument("--warehouse", default="plinth-warehouse")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("ingest")
    p.add_argument("path")
    p.add_argument("--table", default="events")
    p.add_argument("--build-index", default="user_id,region")
    p = commands.add_parser("generate")
    p.add_argument("--rows", type=int, default=DEMO_ROWS)
    p.add_argument("--table", default="events")
    p.add_argument("--seed", type=int, default=7)
    p = commands.add_parser("query")
    p.add_argument("sql")
    p.add_argument("--max-rows", type=int, default=50)
    p.add_argument("--explain", action="store_true")
    p.add_argument("--demo", action="store_true", help="answer from generated events if the warehouse has none")
    p = commands.add_parser("bench")
    p.add_argument("--table", default="events")
    p.add_argument("--iterations", type=int, default=5)
    p.add_argument("--rows", type=int, default=500_000, help="events to generate where the table is missing")
    commands.add_parser("tables")
    a = top.parse_args(argv)

    try:
        return run(a, Engine(build_session(), warehouse=a.warehouse))
    except PlinthError as e:
        print(e, file=sys.stderr)
        return 1


def run(a: argparse.Namespace, engine: Engine) -> int:
    if a.command == "ingest":
        df = engine.save(a.table, load(engine.spark, a.path))
        for c in [c for c in a.build_index.split(",") if c in df.columns]:
            engine.save(f"{a.table}__{c}_index", df.groupBy(c).agg(F.count(F.lit(1)).alias("row_count")).where(F.col(c).isNotNull()))
            print(f"index {c}: {postings.entry_count(df, c).first()[0]} entries")
        if "region" in df.columns:
            print(f"bloom region: fill {BloomFilter.sized(postings.entry_count(df, "region").first()[0]).build(df, "region").fill_ratio():.4f}")
        print(f"{a.table}: {df.count()} rows")
    elif a.command == "generate":
        print(f"{a.table}: {engine.save(a.table, generate_events(engine.spark, a.rows, seed=a.seed)).count()} rows")
    elif a.command == "query":
        if a.demo and "events" not in engine.tables():
            engine.register("events", generate_events(engine.spark, DEMO_ROWS))
        print(engine.explain(a.sql) if a.explain else format_table(engine.sql(a.sql), a.max_rows))
    elif a.command == "bench":
        from plinth.bench import run

        events = engine.table(a.table) if a.table in engine.tables() else generate_events(engine.spark, a.rows)
        for name, seconds in run(engine, events, a.iterations).items():
            print(f"{name:<12} {seconds:.4f} s")
    else:
        for t in engine.tables():
            df = engine.table(t)
            print(f"{t}: {df.count()} rows, {', '.join(f'{n} {k}' for n, k in df.dtypes)}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
