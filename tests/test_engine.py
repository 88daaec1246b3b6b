"""Dialect, sources, indexes and session: the component assertions and the binding decisions."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from plinth import Engine, EngineConfig
from plinth.dialect import parse
from plinth.errors import IngestError, ParseError, PlanError, SchemaError
from plinth.index import inverted, postings, zonemap
from plinth.index.bloom import BloomFilter
from plinth.operators import joins
from plinth.queries import QUERIES, engine as query_engine, sparse
from plinth.result import format_table
from plinth.sources import generate, infer, journal
from plinth.sources.csv import parse_value, read_csv, write_csv
from plinth.sources.jsonl import events_schema, read_jsonl
from plinth.sources.validate import BatchValidator, validate_row


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    rows = [("a", 10.0, 1), ("a", 5.0, 2), ("b", 7.0, 3), (None, None, 4)]
    e.register("events", spark.createDataFrame(rows, "region string, amount double, id long"), replace=True)
    return e


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_group_and_having(engine):
    got = rows(engine.sql("SELECT region, COUNT(*) AS n, SUM(amount) AS total FROM events GROUP BY region ORDER BY region"))
    assert got == [(None, 1, 0.0), ("a", 2, 15.0), ("b", 1, 7.0)]
    assert rows(engine.sql("SELECT region FROM events GROUP BY region HAVING COUNT(*) > 1")) == [("a",)]
    assert rows(engine.sql("SELECT COUNT(*) AS n FROM events WHERE id > 100")) == [(0,)]
    assert engine.queries_executed == 3


def test_order_and_strings(engine, spark):
    assert [r[0] for r in rows(engine.sql("SELECT region FROM events ORDER BY region DESC"))] == [None, "b", "a", "a"]
    old = Engine(spark, EngineConfig(compat_string_desc=True))
    old.catalog.register("events", engine.table("events"))
    assert [r[0] for r in rows(old.sql("SELECT region FROM events ORDER BY region DESC"))] == [None, "a", "a", "b"]


@pytest.mark.parametrize("text", ["SELECT a FROM t WHERE a > 1 OR b < 2", "SELECT a FROM t;", "SELECT FROM t", "SELECT a FROM t LIMIT -1", "SELECT a FROM t extra"])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("text", ["SELECT nope FROM events", "SELECT id FROM events WHERE region = 5", "SELECT id FROM none", "SELECT id FROM events ORDER BY nope", "SELECT SUM(region) AS s FROM events", "SELECT *, COUNT(*) FROM events"])
def test_plan_errors(engine, text):
    with pytest.raises(PlanError):
        engine.sql(text)


def test_both_inequalities_and_keyword_prefixes():
    assert parse("SELECT a FROM t WHERE a != 1") == parse("SELECT a FROM t WHERE a <> 1")
    assert parse("SELECT country, min_x FROM orders").table == "orders"


def test_join_types_and_nulls(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string"), spark.createDataFrame([(1, "p"), (None, "q")], "j long, w string")
    assert sorted(rows(joins.hash_join(a, b, "k", "j")), key=str) == [(1, "x", 1, "p"), (None, "y", None, "q")]
    assert joins.hash_join(a, b, "k", "j").columns == ["k", "v", "j__j", "j__w"]
    with pytest.raises(PlanError):
        joins.hash_join(a, b.withColumn("j", F.col("j").cast("double")), "k", "j")


def test_pushdown(spark, sf_dir):
    e = Engine(spark)
    e.catalog.register("events", spark.read.parquet(f"{sf_dir}/events.parquet"))
    plan = e.explain("SELECT event_id FROM events WHERE 5 < value")
    assert "GreaterThan(value,5" in plan and "props" not in plan


def test_csv(spark, tmp_path):
    df = generate.generate_events(spark, 50)
    write_csv(df, f"{tmp_path}/c")
    back = read_csv(spark, f"{tmp_path}/c", events_schema())
    assert sorted(rows(back)) == sorted(rows(df))
    assert read_csv(spark, f"{tmp_path}/c").schema["ts"].dataType == T.LongType()


def test_parse_value(spark):
    df = spark.createDataFrame([("42",), ("3.14",), ("true",), ("null",), ("",), (" 5 ",)], "c string")
    assert [r[0] for r in rows(df.select(parse_value(F.col("c"), T.LongType())))] == [42, None, None, None, None, None]
    assert [r[0] for r in rows(df.select(parse_value(F.col("c"), T.BooleanType())))] == [False, False, True, None, None, False]


def test_inference():
    assert infer.infer_column(["abc", "5"]) == T.StringType() and infer.infer_column(["abc", "5"], "first") == T.LongType()
    assert infer.infer_column(["1", "2.5"]) == T.DoubleType()
    assert infer.infer_from_rows([{"a": "0", "b": "1.5"}, {"a": "1", "b": None}]) == T.StructType([T.StructField("a", T.BooleanType(), False), T.StructField("b", T.DoubleType(), True)])
    with pytest.raises(SchemaError):
        infer.merge_schemas(T.StructType([T.StructField("a", T.LongType())]), T.StructType([T.StructField("b", T.LongType())]))


def test_jsonl(spark, tmp_path):
    lines = [{"event_id": 1, "region": "x", "amount": 2.5, "ts": 1700000000}, {"event_id": 2, "region": 7, "amount": "bad"}]
    (tmp_path / "j.jsonl").write_text("\n\n".join(json.dumps(x) for x in lines))
    got = {r["event_id"]: r for r in read_jsonl(spark, f"{tmp_path}/j.jsonl", events_schema()).collect()}
    assert got[1]["amount"] == 2.5 and got[2]["region"] == "7" and got[2]["amount"] is None and got[1]["user_id"] is None
    zero = {r["event_id"]: r["amount"] for r in read_jsonl(spark, f"{tmp_path}/j.jsonl", events_schema(), mismatch="zero").collect()}
    assert zero[2] == 0.0


def test_validation(spark):
    with pytest.raises(IngestError):
        BatchValidator(events_schema(), strict=True).validate_columns({"event_id": [1], "user_id": [1, 2]})
    assert validate_row(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())]), [1, "x"]) == [1, "x"]


def test_generator_is_one_sequence(spark):
    state, want = 7, []
    for _ in range(40):
        state = (state * generate.MULTIPLIER + generate.INCREMENT) & generate.WORD
        want.append(state)
    assert generate.draws(7, 0, 10).ravel().tolist() == want and generate.draws(7, 4, 6).ravel().tolist() == want[16:]
    assert generate.generate_events(spark, 1000).repartition(3).distinct().count() == 1000


def test_journal(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x long, y string")
    journal.append_insert(df, f"{tmp_path}/log", "t", 2)
    journal.append_insert(df, f"{tmp_path}/log", "t", 1)
    back = journal.rows_of(journal.replay(spark, f"{tmp_path}/log"), "t", df.schema)
    assert sorted(rows(back), key=str) == [(1, 1, "a"), (1, 2, None), (2, 1, "a"), (2, 2, None)]


def test_indexes(spark):
    ids = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (3, 3), (4, None)], "row long, id long")
    assert [r[0] for r in rows(postings.lookup(ids, {"id": 2}, "row"))] == [1, 2] and not postings.contains(ids, "id", 99)
    bloom = BloomFilter.sized(10).build(spark.createDataFrame([("us-east",), ("eu-central",), (None,)], "r string"), "r")
    assert bloom.maybe_contains("us-east") and not bloom.maybe_contains("missing-region-xyz") and not bloom.maybe_contains(None)
    zones = zonemap.build(spark.range(1000).select("id", F.col("id").alias("x")), "x", "id", 100)
    assert sorted(r["chunk_id"] for r in zonemap.candidates(zones, 250, 350).collect()) == [2, 3]
    p = inverted.build(spark.createDataFrame([(1, "A b"), (2, "b c")], "i long, t string"), "t", "i")
    assert rows(inverted.search_and(p, ["B", "c"])) == [(2,)] and rows(inverted.search_and(p, [])) == []


def test_catalog_and_format(engine, spark):
    with pytest.raises(PlanError):
        engine.catalog.register("events", spark.range(1))
    with pytest.raises(PlanError):
        engine.catalog.drop("none")
    assert engine.catalog.find_table_with_column("amount") == "events"
    text = format_table(engine.sql("SELECT region, id FROM events ORDER BY id"), 2)
    assert text.splitlines()[0].startswith("region | id") and text.endswith("... (2 more rows)")


@pytest.mark.parametrize("direction", ["ASC", "DESC"])
def test_order_over_the_whole_table(spark, sf_dir, direction):
    """The dialect's order and the ranks of sort_nulls_first_ranks, NULLs and values alike."""
    ranks = QUERIES["sort_nulls_first_ranks"](spark, sf_dir).collect()
    ne = sparse(spark, sf_dir).select("event_id", "v").collect()
    values = sorted((r for r in ne if r["v"] is not None), key=lambda r: (r["v"] if direction == "ASC" else -r["v"], r["event_id"]))
    want = sorted(r["event_id"] for r in ne if r["v"] is None) + [r["event_id"] for r in values]
    assert 0 < len(values) < len(want)
    assert [r["event_id"] for r in sorted(ranks, key=lambda r: r[f"rank_{direction.lower()}"])] == want
    e = query_engine(spark, sf_dir)
    e.catalog.register("ne", sparse(spark, sf_dir))
    assert [r["event_id"] for r in e.sql(f"SELECT event_id, v FROM ne ORDER BY v {direction}, event_id").collect()] == want


def test_types_that_first_appear_late(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    late = F.col("event_id") % 50 == 2
    events.withColumn("event_type", F.when((F.col("event_id") >= 100) & late, "late").otherwise(F.col("event_type"))).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["null_safe_join"](spark, str(tmp_path))
    assert got.count() == events.count() and got.where("right_k = 'late'").count() == events.where((F.col("event_id") >= 100) & late).count() > 0
    assert QUERIES["fnv1a64_rows"](spark, str(tmp_path)).count() == events.count()
