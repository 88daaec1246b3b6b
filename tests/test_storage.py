"""Positions, codecs, row groups, caches, layout, statistics, streaming, the command line and the engine's limits."""

import importlib
import random

import pytest
from pyspark.sql import Window, functions as F, types as T

from plinth import Engine, EngineConfig, bench, cli
from plinth.errors import IngestError, PlanError
from plinth.functions import hashing
from plinth.index import bitset, postings, rowgroups
from plinth.operators import joins, relational, sorting
from plinth.plans import codecs, encodings, layout, metrics, shared, stats
from plinth.plans.cache import DecodeCache
from plinth.session import _opened, open_parquet
from plinth.sources import generate
from plinth.sources.jsonl import events_schema
from plinth.sources.validate import BatchValidator
from plinth.streaming import append_stream, read_events_stream, windowed_counts


@pytest.fixture()
def settings(spark):
    """Sets session options for one test."""
    before = {}

    def set_(**options):
        for k, v in options.items():
            k = k.replace("__", ".")
            before[k] = spark.conf.get(k, None)
            spark.conf.set(k, v)

    yield set_
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_positions_beyond_the_range_sample(spark, settings):
    """Two million rows in 200 ranges, whose borders come from a small sample; every column is read."""
    settings(spark__sql__execution__rangeExchange__sampleSizePerPartition="20", spark__sql__shuffle__partitions="200")
    df = spark.range(2_000_000).select((F.col("id") * 7919 % 2_000_003).alias("k"), (F.col("id") % 1000).alias("v"), F.col("id").cast("string").alias("t"))
    exact = df.select("k", (F.row_number().over(Window.orderBy("k")) - 1).alias("want")).cache()
    got = relational.with_position(df, "k")
    assert got.columns == ["k", "v", "t", "row_id"]
    assert got.join(exact, "k").agg(F.count(F.lit(1)), F.count_if(F.col("row_id") != F.col("want")), F.countDistinct("row_id"), F.countDistinct("t")).first() == (2_000_000, 0, 2_000_000, 2_000_000)
    far = relational.read_rows(df, "k", 1_000_000, 1_000_064).select("k").collect()
    assert {r[0] for r in far} == {r[0] for r in exact.where("want >= 1000000 AND want < 1000064").collect()}
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in text  # the kept rows are read; no range exchange runs again
    exact.unpersist()


def test_positions_of_ties_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (2, 3), (None, 4), (1, 5)], "k long, _part long").repartition(3)
    ranks = {r["_part"]: r["row_id"] for r in relational.with_position(df, "k").collect()}
    assert {ranks[1], ranks[4]} == {0, 1} and ranks[5] == 2 and {ranks[2], ranks[3]} == {3, 4}
    assert relational.with_position(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("start,stop,want", [(0, 2, [0, 1]), (-5, 1, [0]), (3, 3, []), (4, 2, []), (8, 99, [8, 9]), (99, 100, [])])
def test_slices(spark, monkeypatch, start, stop, want):
    df = spark.range(10).withColumn("k", 9 - F.col("id"))
    for head in (100_000, 1):
        monkeypatch.setattr(relational, "HEAD", head)
        assert sorted((r["row_id"], r["k"]) for r in relational.read_rows(df, "k", start, stop).collect()) == [(i, i) for i in want]


def test_argsort_descending(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 2.0), (4, 5.0)], "id long, v double")
    assert {r["id"]: r["rank"] for r in sorting.argsort(df, "v", "id", descending=True).collect()} == {2: 1, 4: 2, 1: 3, 3: 4}


def test_append_checks_the_batch(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    assert relational.append(df, df.select("t", "id")).count() == 2
    for bad in (df.select("id"), df.withColumn("x", F.lit(1)), df.withColumn("id", F.lit("1"))):
        with pytest.raises(IngestError):
            relational.append(df, bad)
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("t", T.StringType())])
    with pytest.raises(IngestError, match="NULL"):
        relational.append(df, df.withColumn("id", F.lit(None).cast("long")), BatchValidator(schema))


def by_hand_runs(values):
    out = []
    for i, v in enumerate(values):
        if out and out[-1][1] == v:
            out[-1][2] += 1
        else:
            out.append([i, v, 1])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("partitions", ["1", "3", "40"])
def test_neighbours_across_parts(spark, settings, partitions):
    settings(spark__sql__shuffle__partitions=partitions, spark__sql__adaptive__coalescePartitions__enabled="false")
    rng = random.Random(3)
    values = [rng.choice([None, 1, 1, 1, 2]) for _ in range(200)] + [7] * 150
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(values)], "id long, v long, g long").repartition(5)
    assert sorted(tuple(r) for r in encodings.runs(df, "v", "id").select("start", "value", "length").collect()) == by_hand_runs(values)
    got = {r["id"]: r["delta"] for r in encodings.delta(df, "v", "id").collect()}
    assert got == {i: None if v is None or i and values[i - 1] is None else v - (values[i - 1] if i else 0) for i, v in enumerate(values)}
    halves = {g: by_hand_runs(values[g::2]) for g in (0, 1)}
    got = sorted(tuple(r) for r in encodings.runs(df, "v", "id", ["g"]).select("g", "start", "value", "length").collect())
    assert got == sorted((g, 2 * s + g, v, n) for g, rows in halves.items() for s, v, n in rows)
    assert encodings.choose_codec(df, "v", "id").first()["runs"] == len(by_hand_runs(values))
    assert encodings.runs(df.limit(0), "v", "id").count() == 0


CASES = {
    "bigint": [3, None, -5, 2**63 - 1, -(2**63), 0, 0, 0, None, None, 9, 9],
    "string": ["a", "", None, "a", "é", "é", None, None, "b", "b", "b", "b"],
    "double": [0.0, 1.5, None, float("inf"), 1.5, 1.5, 1.5, -2.0, None, None, 3.0, 3.0],
    "boolean": [True, True, None, False, False, True, None, None, True, True, True, True],
}


@pytest.mark.parametrize("kind", CASES)
@pytest.mark.parametrize("codec", ["auto", *codecs.CODECS])
def test_codec_round_trips(spark, kind, codec):
    values = CASES[kind]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, v {kind}").repartition(3)
    chunks = codecs.chunked(df, "v", "id", 5)
    if codec == "delta" and kind != "bigint":
        with pytest.raises(ValueError):
            codecs.encode(chunks, codec)
        return
    encoded = codecs.encode(chunks, codec)
    assert {(r["chunk_id"] * 5 + r["pos"]): r["value"] for r in codecs.decode(encoded).collect()} == dict(enumerate(values))
    assert {r["pos"]: r["value"] for r in codecs.decode_range(encoded, 3, 11, 5).collect()} == dict(list(enumerate(values))[3:11])
    assert codecs.decode_range(encoded, 11, 99, 5).collect()[0]["value"] == values[11] and not codecs.decode_range(encoded, 50, 60, 5).collect()
    assert codecs.get(encoded, 7, 5) == values[7]
    with pytest.raises(IndexError):
        codecs.get(encoded, 12, 5)
    assert codecs.compression_ratio(encoded, 0) == 1.0 and codecs.compression_ratio(encoded, 12 * 16) > 0


def test_codec_sizes_and_choice(spark):
    df = spark.createDataFrame([(i, "east" if i < 50 else "west", [1] * 30 + [2] * 10 + [5] * 5) for i in range(100)], "id long, t string, x array<long>")
    text = codecs.chunked(df, "t", "id", 100)
    # a tag, a length of 4 and the text; runs add 3, entries 2 and codes 4 bytes
    assert [codecs.encode(text, c).first()["encoded_size"] for c in ("raw", "rle", "dict")] == [900, 2 * (9 + 3), 4 + 2 * (9 + 2) + 400]
    assert codecs.encode(text).first()["codec"] == "dict"
    assert codecs.encode(codecs.chunked(df, "id", "id", 100)).first()["codec"] == "delta"
    stamps = df.select("id", F.timestamp_seconds(1000 + 13 * F.col("id")).alias("ts"))
    encoded = codecs.encode(codecs.chunked(stamps, "ts", "id", 30))
    assert codecs.decode(encoded).join(stamps, F.expr("chunk_id * 30 + pos = id")).where("value = ts").count() == 100
    with pytest.raises(ValueError):
        codecs.encode(text, "zip")
    assert codecs.decode(codecs.encode(text.limit(0))).count() == 0


def test_row_groups(spark):
    df = spark.createDataFrame([(i, None if i < 20 else i % 7) for i in range(100)], "x long, y long")
    groups = rowgroups.build(df, "x", 10)
    assert rowgroups.total_rows(groups) == 100 and groups.count() == 10
    assert rowgroups.candidates(groups, "x", 25, 47).count() == 3
    assert rowgroups.candidates(groups, "x", low=200).count() == 0
    assert rowgroups.candidates(groups, "y", 0, 99).count() == 8 and rowgroups.candidates(groups, "y").count() == 10
    assert [r["x"] for r in rowgroups.scan(groups, "x", ["x", "y"], 25, 27).orderBy("x").collect()] == [25, 26, 27]
    assert rowgroups.scan(groups, "x", ["x"], high=None, low=98).count() == 2
    assert [r["y"] for r in rowgroups.read_column(groups, "y").where("group_id = 2").orderBy("place").collect()] == [i % 7 for i in range(20, 30)]
    assert rowgroups.read_cell(groups, "y", 1, 0) is None and rowgroups.read_cell(groups, "x", 3, 9) == 39
    with pytest.raises(IndexError):
        rowgroups.read_cell(groups, "x", 3, 10)
    with pytest.raises(KeyError):
        rowgroups.read_column(groups, "z")


def test_decode_cache(spark):
    c = DecodeCache(2)
    assert c.get("t:x", 0) is None
    for i in range(3):
        c.put("t:x", i, [i])
    assert c.get("t:x", 0) is None and c.get("t:x", 2) == [2]
    assert c.stats() == {"hits": 1, "misses": 2, "size": 2, "hit_rate": 1 / 3} and DecodeCache().stats()["hit_rate"] == 0.0
    e = Engine(spark, EngineConfig(chunk_size=4, cache_chunk_decodes=True))
    e.register("chunky", spark.range(10).withColumn("v", 9 - F.col("id")), replace=True)
    assert [e.read_chunk("chunky", "v", "id", i) for i in (0, 2, 0, 5)] == [[9, 8, 7, 6], [1, 0], [9, 8, 7, 6], []]
    assert e.decoded.stats()["hits"] == 1 and e.decoded.stats()["size"] == 3
    e.reset_cache()
    assert e.decoded.stats()["size"] == 0


def test_bitsets(spark):
    sets = [spark.createDataFrame([(i,) for i in ids], "i long") for ids in ([0, 1, 7, 8, 40_000, -3, None], [1, 8, 32_768, 32_769])]
    a, b = (bitset.build(s, "i") for s in sets)
    ids = lambda x: sorted(r["row_id"] for r in bitset.ids(x).collect())
    assert ids(a) == [-3, 0, 1, 7, 8, 40_000] and ids(bitset.either(a, b)) == [-3, 0, 1, 7, 8, 32_768, 32_769, 40_000] and ids(bitset.both(a, b)) == [1, 8]
    assert ids(bitset.clear(a, sets[1])) == [-3, 0, 7, 40_000] and bitset.get(a, 7) and not bitset.get(a, 2) and not bitset.get(a, 10**9)
    assert bitset.popcount(a.limit(0)).first()["n"] == 0


def test_metrics_and_lists():
    m = metrics.Metrics()
    with m.time("a"):
        pass
    m.record("b", 2.0)
    assert m.report()[0][:2] == ("b", 1) and m.average_ms("b") == 2000.0 and m.average_ms("none") == 0.0
    calls = []
    seconds, last = metrics.time_call(lambda: calls.append(1) or len(calls), 0)
    assert last == 1 and seconds >= 0
    assert metrics.batches([1, 2, 3], 2) == [[1, 2], [3]] and metrics.flatten([[1], [], [2, 3]]) == [1, 2, 3]
    with pytest.raises(ValueError):
        metrics.batches([1], 0)
    for target in metrics.PROFILE_TARGETS.values():
        module, name = target.rsplit(".", 1) if ".Engine." not in target else (target.split(".Engine.")[0], "Engine")
        assert hasattr(importlib.import_module(module), name)


def test_observed_rows(spark):
    df, o = metrics.observed(spark.range(7), "seen")
    df.collect()
    assert o.get["rows"] == 7


def test_hash_functions(spark):
    r = spark.createDataFrame([(1, "x"), (None, None)], "a long, b string").select(hashing.fmix64("a").alias("m"), hashing.fingerprint("a", "b").alias("f"), hashing.partition_of("b", 8).alias("p"), hashing.mod_partition("a", 8).alias("q")).collect()
    assert r[1]["m"] is None and r[0]["f"] != r[1]["f"] and 0 <= r[0]["p"] < 8 and [x["q"] for x in r] == [1, 0]
    with pytest.raises(ValueError):
        hashing.partition_of("a", 0)


def test_layout(spark, tmp_path):
    df = spark.range(1000).withColumn("v", F.col("id") % 10)
    layout.write_partitioned(df, f"{tmp_path}/p", "id", 4, "mod")
    back = spark.read.parquet(f"{tmp_path}/p")
    assert back.count() == 1000 and back.where("partition_id <> id % 4").count() == 0
    layout.write_sorted(df, f"{tmp_path}/s", "id", bloom=["v"])
    assert spark.read.parquet(f"{tmp_path}/s").where("id between 10 and 19").count() == 10
    assert postings.ordered(df, "v", f"{tmp_path}/o").where("v = 3").count() == 100
    assert postings.bucket_count(df, "v", 1).first()["buckets"] == 1


def test_statistics(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "ccc")], "id long, t string")
    r = stats.table_stats(df, "id", 2, ["t", "id"]).first()
    # integers by delta, the text raw: 6 + 1 + 8 bytes
    assert tuple(r) == (3, 4, 24 + 15, 96, "id,t")
    assert stats.table_stats(df.limit(0), "id").first()["rows"] == 0
    assert stats.collect(df, "t", approximate=True).first()["null_count"] == 1
    assert stats.join_order({"b": 2, "a": 2, "c": 1}) == ["c", "a", "b"]
    assert stats.estimate(["filter", "limit"], 100) == 62.5 and stats.estimate([]) == 1000.0 and stats.estimate_join(10, 20) == 57.0


def test_joins_have_no_cartesian_product(spark):
    a, b = spark.range(100).toDF("k"), spark.range(50, 120).toDF("k")
    for j in (joins.nested_loop_join(a, b, "k", "k"), joins.hash_join(a, b, "k", "k", "nested")):
        assert j.count() == 50 and "Cartesian" not in j._jdf.queryExecution().executedPlan().toString()


def test_opened_tables_follow_their_files(spark, tmp_path):
    at = f"{tmp_path}/t"
    spark.range(3).write.parquet(at)
    assert open_parquet(spark, at) is open_parquet(spark, at) and open_parquet(spark, at).count() == 3
    spark.range(4).write.mode("append").parquet(at)
    assert open_parquet(spark, at).count() == 7
    spark.range(2).toDF("other").write.mode("overwrite").parquet(at)
    assert open_parquet(spark, at).columns == ["other"] and (spark.sparkContext.applicationId, at) in _opened


def test_shared_folder(spark, tmp_path):
    at = spark.conf.get("spark.checkpoint.dir")
    assert at.startswith("/") and shared.shared_dir(spark) == f"file://{at}"
    scratch = shared.Scratch(spark, "x")
    assert scratch.keep(spark.range(3), "t").count() == 3 and shared.exists(spark, f"{scratch.root}/t")
    assert shared.folders(spark, scratch.root) == ["t"] and shared.folders(spark, f"{tmp_path}/none") == []
    scratch.drop("t")
    assert not shared.exists(spark, f"{scratch.root}/t")


def test_timeouts_leave_broadcasts_alone(spark):
    before = spark.conf.get("spark.sql.broadcastTimeout")
    e = Engine(spark, EngineConfig(query_timeout_ms=300))
    assert spark.conf.get("spark.sql.broadcastTimeout") == before
    slow = F.udf(lambda x: __import__("time").sleep(0.2) or x, "long")
    e.register("slow", spark.range(400).select(slow("id").alias("id")), replace=True)
    with pytest.raises(PlanError, match="more than 300 ms"):
        e.collect("SELECT COUNT(id) AS n FROM slow")
    quick = Engine(spark)
    quick.register("quick", spark.range(400), replace=True)
    assert [tuple(r) for r in quick.collect("SELECT COUNT(*) AS n FROM quick")] == [(400,)]


def test_command_line(spark, tmp_path, capsys):
    wh = ["--warehouse", f"{tmp_path}/wh"]
    assert cli.main([*wh, "query", "SELECT COUNT(*) AS n FROM events"]) == 1 and "no table" in capsys.readouterr().err
    assert cli.main([*wh, "query", "SELECT FROM events"]) == 1 and capsys.readouterr().err
    assert cli.main([*wh, "query", "--demo", "SELECT COUNT(*) AS n FROM events"]) == 0 and "5000" in capsys.readouterr().out
    assert cli.main([*wh, "generate", "--rows", "300"]) == 0
    generate.write_sample_csv(spark, f"{tmp_path}/more.csv", 40)
    assert cli.main([*wh, "ingest", f"{tmp_path}/more.csv", "--table", "more"]) == 0
    out = capsys.readouterr().out
    assert "more: 40 rows" in out and "index region" in out and "bloom region" in out
    assert cli.main([*wh, "ingest", f"{tmp_path}/more.xml"]) == 1
    assert cli.main([*wh, "query", "SELECT region, COUNT(*) AS n FROM events GROUP BY region ORDER BY region"]) == 0
    assert "ap-northeast" in capsys.readouterr().out
    assert cli.main([*wh, "query", "--explain", "SELECT region FROM events"]) == 0 and "Scan parquet" in capsys.readouterr().out
    assert cli.main([*wh, "tables"]) == 0 and "events: 300 rows" in capsys.readouterr().out
    assert cli.main([*wh, "bench", "--iterations", "1"]) == 0 and "join" in capsys.readouterr().out


def test_bench_cases(spark):
    assert set(bench.run(Engine(spark), generate.generate_events(spark, 2000), 1)) == {"groupby", "filter", "sort", "hash_lookup", "codec_slice", "join"}


def test_streaming(spark, tmp_path):
    rows = generate.generate_events(spark, 500).withColumn("ts", F.unix_seconds("ts"))
    rows.write.json(f"{tmp_path}/in")
    stream = read_events_stream(spark, f"{tmp_path}/in")
    assert [f.name for f in stream.schema] == [f.name for f in events_schema()]
    append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 500
    q = windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cw").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 500


def test_null_bounds_and_float_groups(spark):
    zones = spark.createDataFrame([(0, 1, 5), (1, 6, 9)], "chunk_id long, lo long, hi long")
    from plinth.index import zonemap

    assert zonemap.candidates(zones, None, None).count() == 2 and zonemap.candidates(zones, 6, None).count() == 1
    e = Engine(spark)
    e.register("floats", spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double"), replace=True)
    assert sorted(r["n"] for r in e.sql("SELECT x, COUNT(*) AS n FROM floats GROUP BY x").collect()) == [2, 2]
