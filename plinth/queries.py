"""Queries of the driver contract for the relational engine, each with its SQL counterpart.

Dialect queries are written once: the dialect text is what ``Engine.sql``
plans, the oracle is ANSI SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plinth.config import EngineConfig
from plinth.functions import hashing
from plinth.index import bitset, bloom, inverted, postings, rowgroups, zonemap
from plinth.operators import joins, relational, sorting, windows
from plinth.plans import codecs, encodings, layout, stats
from plinth.plans.shared import Scratch
from plinth.session import Engine, open_parquet
from plinth.sources import journal
from plinth.sources.csv import read_csv, write_csv
from plinth.sources.jsonl import read_jsonl
from plinth.sources.validate import BatchValidator

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return open_parquet(spark, f"{sf_dir}/{table}.parquet")


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """An engine over the driver's tables, each opened when a query names it."""
    return Engine(spark, EngineConfig(**options), loader=lambda t: read(spark, sf_dir, t))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with NULLs in value (v) and type (et)."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("et"))


NE = "(SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CASE WHEN event_id % 5 <> 0 THEN event_type END AS et FROM events)"


def _dialect(name: str, text: str, oracle: str, rounded: tuple[str, ...] = (), over_sparse: bool = False, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, **options)
        if over_sparse:
            e.catalog.register("ne", sparse(spark, sf_dir))
        out = e.sql(text)
        return out.withColumns({c: F.round(c, 4) for c in rounded}) if rounded else out

    QUERIES[name], ORACLES[name] = run, oracle


def _frame(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_dialect("flagship", "SELECT event_type, COUNT(*) AS n, SUM(value) AS rev FROM events WHERE value > 10 GROUP BY event_type ORDER BY n DESC LIMIT 5", "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS rev FROM events WHERE value > 10 GROUP BY event_type ORDER BY n DESC LIMIT 5", ("rev",))
_dialect("scan_region", "SELECT * FROM region", "SELECT * FROM region")
_dialect("alias", "SELECT event_id AS id, value AS amount FROM events", "SELECT event_id AS id, value AS amount FROM events")
_dialect("filter_and", "SELECT event_id, value FROM events WHERE value > 50.0 AND event_type = 'click'", "SELECT event_id, value FROM events WHERE value > 50 AND event_type = 'click'")
_dialect("filter_literal_left", "SELECT event_id FROM events WHERE 50 < value", "SELECT event_id FROM events WHERE 50 < value")
_dialect("filter_ops", "SELECT event_id, value FROM events WHERE value >= 1 AND value <= 90 AND event_type <> 'error' AND user_id < 900 AND event_id > 10", "SELECT event_id, value FROM events WHERE value >= 1 AND value <= 90 AND event_type <> 'error' AND user_id < 900 AND event_id > 10")
_dialect("filter_col_col", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")
_dialect("filter_null_false", "SELECT event_id FROM ne WHERE v > 10", f"SELECT event_id FROM {NE} ne WHERE v > 10", over_sparse=True)
_dialect("group_count_sum", "SELECT event_type, COUNT(*) AS n, SUM(value) AS rev FROM events GROUP BY event_type", "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS rev FROM events GROUP BY event_type", ("rev",))
_dialect("group_min_max", "SELECT event_type, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY event_type", "SELECT event_type, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi FROM events GROUP BY event_type")
_dialect("group_avg", "SELECT event_type, AVG(value) AS mean FROM events GROUP BY event_type", "SELECT event_type, ROUND(AVG(value), 4) AS mean FROM events GROUP BY event_type", ("mean",))
_dialect("group_multi", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 4) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus", ("qty",))
_dialect("group_null_key", "SELECT et, COUNT(*) AS n, SUM(v) AS total FROM ne GROUP BY et", f"SELECT et, COUNT(*) AS n, ROUND(COALESCE(SUM(v), 0), 4) AS total FROM {NE} ne GROUP BY et", ("total",), over_sparse=True)
_dialect("sum_int_as_double", "SELECT event_type, SUM(user_id) AS total FROM events GROUP BY event_type", "SELECT event_type, COALESCE(SUM(CAST(user_id AS DOUBLE)), 0.0) AS total FROM events GROUP BY event_type")
_dialect("global_agg", "SELECT COUNT(*) AS n, SUM(value) AS total, MIN(value) AS lo, MAX(value) AS hi, AVG(value) AS mean FROM events", "SELECT COUNT(*) AS n, ROUND(SUM(value), 4) AS total, MIN(value) AS lo, MAX(value) AS hi, ROUND(AVG(value), 4) AS mean FROM events", ("total", "mean"))
_dialect("default_names", "SELECT event_type, COUNT(*), MIN(value) FROM events GROUP BY event_type", 'SELECT event_type, COUNT(*) AS "count_*", MIN(value) AS min_value FROM events GROUP BY event_type')
_dialect("count_column", "SELECT et, COUNT(v) AS n FROM ne GROUP BY et", f"SELECT et, COUNT(v) AS n FROM {NE} ne GROUP BY et", over_sparse=True)
_dialect("star_aggregates", "SELECT event_type, SUM(*) AS s, AVG(*) AS a, MIN(*) AS lo, MAX(*) AS hi FROM events GROUP BY event_type", "SELECT event_type, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi FROM events GROUP BY event_type")
_dialect("where_group", "SELECT event_type, COUNT(*) AS n FROM events WHERE value > 100 GROUP BY event_type", "SELECT event_type, COUNT(*) AS n FROM events WHERE value > 100 GROUP BY event_type")
_dialect("implicit_max", "SELECT event_type, props, COUNT(*) AS n FROM events GROUP BY event_type", "SELECT event_type, MAX(props) AS props, COUNT(*) AS n FROM events GROUP BY event_type")
_dialect("having", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id HAVING COUNT(*) > 60", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id HAVING COUNT(*) > 60")
_dialect("having_alias", "SELECT user_id, COUNT(*) AS n, SUM(value) AS total FROM events GROUP BY user_id HAVING n >= 60 AND total > 100", "SELECT user_id, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY user_id HAVING COUNT(*) >= 60 AND SUM(value) > 100", ("total",))
_dialect("topk", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100", "SELECT event_id, value FROM events ORDER BY value DESC NULLS FIRST, event_id LIMIT 100")
_dialect("sort_nulls_first", "SELECT event_id, v FROM ne ORDER BY v, event_id", f"SELECT event_id, v FROM {NE} ne ORDER BY v ASC NULLS FIRST, event_id", over_sparse=True)
_dialect("sort_nulls_first_desc", "SELECT event_id, v FROM ne ORDER BY v DESC, event_id", f"SELECT event_id, v FROM {NE} ne ORDER BY v DESC NULLS FIRST, event_id", over_sparse=True)
_dialect("sort_text_desc", "SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC LIMIT 25", "SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC NULLS FIRST LIMIT 25")
_dialect("limit_total_order", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 5", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 5")
_dialect("join_inner", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey", "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
_dialect("join_two_selects", "SELECT event_id, user_id FROM events JOIN customer ON user_id = c_custkey SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0", "SELECT event_id, user_id, c_custkey AS c_custkey__c_custkey, c_mktsegment AS c_custkey__c_mktsegment FROM events JOIN customer ON user_id = c_custkey WHERE c_acctbal > 0")
_dialect("join_group", "SELECT c_mktsegment, COUNT(*) AS n, SUM(value) AS rev FROM events JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(value), 4) AS rev FROM events JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment", ("rev",))
_dialect("join_chain", "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "SELECT c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_dialect("keyword_prefixed_names", "SELECT o_orderstatus, COUNT(*) AS order_count FROM orders WHERE o_totalprice != 0 GROUP BY o_orderstatus", "SELECT o_orderstatus, COUNT(*) AS order_count FROM orders WHERE o_totalprice <> 0 GROUP BY o_orderstatus")


@_frame("sum_all_null", "SELECT event_type, 0.0::DOUBLE AS total FROM events GROUP BY event_type")
def _(spark, d):
    e = engine(spark, d)
    e.catalog.register("nothing", read(spark, d, "events").withColumn("v", F.lit(None).cast("double")))
    return e.sql("SELECT event_type, SUM(v) AS total FROM nothing GROUP BY event_type")


@_frame("null_safe_join", f"SELECT a.event_id AS event_id, b.k AS right_k FROM {NE} a JOIN (SELECT DISTINCT et AS k FROM {NE} x) b ON a.et IS NOT DISTINCT FROM b.k")
def _(spark, d):
    ne = sparse(spark, d)
    right = ne.select(F.col("et").alias("k")).distinct()
    return joins.hash_join(ne, right, "et", "k").select("event_id", F.col("k__k").alias("right_k"))


@_frame("hash_join_named", "SELECT event_id, user_id, c_custkey AS c_custkey__c_custkey, c_mktsegment AS c_custkey__c_mktsegment FROM events JOIN customer ON user_id = c_custkey")
def _(spark, d):
    return joins.hash_join(read(spark, d, "events").select("event_id", "user_id"), read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "user_id", "c_custkey")


@_frame("nested_loop_join", 'SELECT n_nationkey AS "l.n_nationkey", n_regionkey AS "l.n_regionkey", r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey')
def _(spark, d):
    return joins.nested_loop_join(read(spark, d, "nation").select("n_nationkey", "n_regionkey"), read(spark, d, "region"), "n_regionkey", "r_regionkey")


@_frame("topk_nulls_last", f"SELECT event_id, v FROM {NE} ne ORDER BY v DESC NULLS LAST, event_id LIMIT 20")
def _(spark, d):
    return sorting.top_k(sparse(spark, d).select("event_id", "v"), "v", 20, "event_id", reverse=True)


@_frame("argsort", f"SELECT event_id, ROW_NUMBER() OVER (ORDER BY v ASC NULLS FIRST, event_id) AS rank FROM {NE} ne")
def _(spark, d):
    return sorting.argsort(sparse(spark, d), "v", "event_id").select("event_id", "rank")


@_frame("sort_nulls_first_ranks", f"SELECT event_id, v, ROW_NUMBER() OVER (ORDER BY v ASC NULLS FIRST, event_id) AS rank_asc, ROW_NUMBER() OVER (ORDER BY v DESC NULLS FIRST, event_id) AS rank_desc FROM {NE} ne")
def _(spark, d):
    """Each row's place in both directions, as a comparison by rows does not see an order."""
    up = sorting.argsort(sparse(spark, d).select("event_id", "v"), "v", "event_id", "rank_asc")
    return sorting.argsort(up, "v", "event_id", "rank_desc", descending=True).select("event_id", "v", "rank_asc", "rank_desc")


@_frame("window_row_number", "SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS rn FROM events")
def _(spark, d):
    return windows.with_row_number(read(spark, d, "events"), ["event_type"], ["event_id"], "rn").select("event_id", "rn")


@_frame("window_running_sum", f"SELECT event_id, ROUND(SUM(COALESCE(v, 0.0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM {NE} ne")
def _(spark, d):
    return sparse(spark, d).select("event_id", F.round(windows.running_sum("v", ["user_id"], ["event_id"]), 2).alias("running"))


@_frame("read_rows", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 64 OFFSET 128")
def _(spark, d):
    return relational.read_rows(read(spark, d, "events").select("event_id", "value"), "event_id", 128, 192).select("event_id", "value")


@_frame("append_rows", "SELECT event_id, value FROM events UNION ALL SELECT event_id + 1000000 AS event_id, value FROM events")
def _(spark, d):
    x = read(spark, d, "events").select("event_id", "value")
    return relational.append(x, x.withColumn("event_id", F.col("event_id") + 1_000_000))


@_frame("hash_postings", "SELECT user_id, ARRAY_TO_STRING(LIST(event_id ORDER BY event_id), ',') AS row_ids FROM events GROUP BY user_id")
def _(spark, d):
    return postings.build(read(spark, d, "events"), ["user_id"], "event_id").withColumn("row_ids", F.concat_ws(",", F.col("row_ids").cast("array<string>")))


@_frame("hash_lookup", "SELECT event_id FROM events WHERE user_id = 7")
def _(spark, d):
    return postings.lookup(read(spark, d, "events"), {"user_id": 7}, "event_id")


@_frame("hash_entries", f"SELECT COUNT(DISTINCT et) AS entries FROM {NE} ne")
def _(spark, d):
    return postings.entry_count(sparse(spark, d), "et")


@_frame("composite_lookup", "SELECT l_orderkey FROM lineitem WHERE l_partkey = (SELECT MIN(l_partkey) FROM lineitem) AND l_linenumber = 1")
def _(spark, d):
    li = read(spark, d, "lineitem")
    least = li.agg(F.min("l_partkey")).first()[0]
    return postings.lookup(li, {"l_partkey": least, "l_linenumber": 1}, "l_orderkey")


@_frame("composite_entries", "SELECT COUNT(*) AS entries FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def _(spark, d):
    return postings.entry_count(read(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@_frame("range_scan", "SELECT event_id, user_id FROM events WHERE user_id BETWEEN 5 AND 9")
def _(spark, d):
    return postings.range_scan(read(spark, d, "events"), "user_id", "event_id", 5, 9).select("event_id", "user_id")


@_frame("btree_size", "SELECT COUNT(DISTINCT user_id) AS entries FROM events")
def _(spark, d):
    return postings.entry_count(read(spark, d, "events"), "user_id")


TOKENS = "(SELECT doc_id, UNNEST(LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER(text), '([a-z0-9]+)', 1))) AS token FROM documents)"


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return inverted.build(read(spark, d, "documents"), "text", "doc_id")


@_frame("inverted_df", f"SELECT token, COUNT(*) AS documents FROM {TOKENS} t GROUP BY token")
def _(spark, d):
    return inverted.term_frequency(_postings(spark, d))


@_frame("inverted_search", f"SELECT doc_id AS row_id FROM {TOKENS} t WHERE token = 'the'")
def _(spark, d):
    return inverted.search(_postings(spark, d), "The")


@_frame("inverted_search_and", f"SELECT doc_id AS row_id FROM {TOKENS} t WHERE token IN ('the', 'of', 'and') GROUP BY doc_id HAVING COUNT(DISTINCT token) = 3")
def _(spark, d):
    return inverted.search_and(_postings(spark, d), ["the", "of", "and"])


@_frame("inverted_vocabulary", f"SELECT COUNT(DISTINCT token) AS tokens FROM {TOKENS} t")
def _(spark, d):
    return inverted.vocabulary_size(_postings(spark, d))


ZONES = f"(SELECT (rn // 1024) AS chunk_id, MIN(v) AS lo, MAX(v) AS hi, COUNT(*) FILTER (WHERE v IS NULL) AS null_count, COUNT(*) AS row_count FROM (SELECT v, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS rn FROM {NE} ne) GROUP BY 1)"


@_frame("zone_map", f"SELECT * FROM {ZONES} z")
def _(spark, d):
    return zonemap.build(sparse(spark, d), "v", "event_id", 1024)


@_frame("zone_candidates", "SELECT c AS chunk_id FROM (SELECT (rn // 1024) AS c, MIN(event_id) AS lo, MAX(event_id) AS hi FROM (SELECT event_id, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS rn FROM events) GROUP BY 1) WHERE hi >= 2500 AND lo <= 3500")
def _(spark, d):
    x = read(spark, d, "events").withColumn("x", F.col("event_id"))
    return zonemap.candidates(zonemap.build(x, "x", "event_id", 1024), 2500, 3500).select("chunk_id")


@_frame("bloom_membership", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000)")
def _(spark, d):
    keys = read(spark, d, "customer").where("c_acctbal > 8000").select(F.col("c_custkey").alias("user_id"))
    filtered = bloom.BloomFilter.sized(10_000).build(keys, "user_id")
    events = read(spark, d, "events")
    return events.where(filtered.column("user_id")).join(keys, "user_id", "left_semi").select("event_id")


@_frame("bitset_and", "SELECT COUNT(*) AS n FROM events WHERE value > 50 AND event_type = 'click'")
def _(spark, d):
    e = read(spark, d, "events")
    return bitset.popcount(bitset.both(bitset.build(e.where("value > 50"), "event_id"), bitset.build(e.where("event_type = 'click'"), "event_id")))


@_frame("delta_encode", "SELECT event_id, user_id - LAG(user_id, 1, 0) OVER (ORDER BY event_id) AS delta FROM events")
def _(spark, d):
    return encodings.delta(read(spark, d, "events"), "user_id", "event_id")


@_frame("rle_encode", "SELECT MIN(event_id) AS start, ANY_VALUE(event_type) AS value, COUNT(*) AS length FROM (SELECT event_id, event_type, ROW_NUMBER() OVER (ORDER BY event_id) - ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) GROUP BY event_type, g")
def _(spark, d):
    return encodings.runs(read(spark, d, "events"), "event_type", "event_id")


@_frame("dict_encode", "SELECT value, first_seen, ROW_NUMBER() OVER (ORDER BY first_seen) - 1 AS code FROM (SELECT event_type AS value, MIN(event_id) AS first_seen FROM events GROUP BY event_type)")
def _(spark, d):
    return encodings.dictionary(read(spark, d, "events"), "event_type", "event_id")


@_frame("codec_choice", "SELECT n, distinct_values, runs, CASE WHEN n > 0 AND distinct_values < GREATEST(1, n // 4) THEN 'dict' WHEN n > 8 AND runs < n // 3 THEN 'rle' ELSE 'raw' END AS codec FROM (SELECT COUNT(*) AS n, COUNT(DISTINCT event_type) AS distinct_values, CAST(SUM(CASE WHEN event_type IS DISTINCT FROM prev OR rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS runs FROM (SELECT event_type, LAG(event_type) OVER (ORDER BY event_id) AS prev, ROW_NUMBER() OVER (ORDER BY event_id) AS rn FROM events))")
def _(spark, d):
    return encodings.choose_codec(read(spark, d, "events"), "event_type", "event_id")


@_frame("column_stats", f"SELECT 'v' AS column_name, COUNT(*) AS row_count, COUNT(*) FILTER (WHERE v IS NULL) AS null_count, COUNT(DISTINCT v) AS distinct_count FROM {NE} ne UNION ALL SELECT 'et', COUNT(*), COUNT(*) FILTER (WHERE et IS NULL), COUNT(DISTINCT et) FROM {NE} ne")
def _(spark, d):
    return stats.collect(sparse(spark, d), "v", "et").select("column_name", "row_count", "null_count", "distinct_count")


@_frame("not_null_violations", f"SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE v IS NULL) AS v_nulls, COUNT(*) FILTER (WHERE et IS NULL) AS et_nulls FROM {NE} ne")
def _(spark, d):
    schema = T.StructType([T.StructField("v", T.DoubleType(), False), T.StructField("et", T.StringType(), False)])
    return BatchValidator(schema).violations(sparse(spark, d))


@_frame("partition_mod", "SELECT ((user_id % 8) + 8) % 8 AS partition_id, COUNT(*) AS row_count FROM events GROUP BY 1")
def _(spark, d):
    return layout.partition_rows(read(spark, d, "events"), "user_id", 8, "mod")


@_frame("ts_epoch", "SELECT event_id, CAST(FLOOR(EPOCH(ts)) AS BIGINT) AS seconds FROM events")
def _(spark, d):
    return read(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"))


@_frame("coerce_float_int", "SELECT event_id, CAST(TRUNC(value) AS BIGINT) AS whole FROM events")
def _(spark, d):
    from plinth.types import coerce

    return read(spark, d, "events").select("event_id", coerce(F.col("value"), "FLOAT64", "INT64").alias("whole"))


@_frame("fnv1a64", "SELECT event_type, CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END::BIGINT AS fnv FROM (SELECT event_type, LIST_REDUCE(LIST_PREPEND(1469598103934665603::HUGEINT, LIST_TRANSFORM(RANGE(1, LENGTH(event_type) + 1), lambda i: ASCII(SUBSTRING(event_type, i, 1))::HUGEINT)), lambda a, b: (XOR(a::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT) AS h FROM (SELECT DISTINCT event_type FROM events))")
def _(spark, d):
    return read(spark, d, "events").select("event_type").distinct().select("event_type", hashing.fnv1a64("event_type").alias("fnv"))


@_frame("fnv1a64_rows", "SELECT event_id, CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END::BIGINT AS fnv FROM (SELECT event_id, LIST_REDUCE(LIST_PREPEND(1469598103934665603::HUGEINT, LIST_TRANSFORM(RANGE(1, LENGTH(event_type) + 1), lambda i: ASCII(SUBSTRING(event_type, i, 1))::HUGEINT)), lambda a, b: (XOR(a::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616::HUGEINT) AS h FROM events)")
def _(spark, d):
    """Every row's hash, where fnv1a64 hashes the distinct types."""
    return read(spark, d, "events").select("event_id", hashing.fnv1a64("event_type").alias("fnv"))


@_frame("parse_csv_cells", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS whole, event_id % 2 = 0 AS flag FROM events")
def _(spark, d):
    from plinth.sources.csv import parse_value

    e = read(spark, d, "events")
    text = F.when(F.col("event_id") % 7 == 0, "NULL").otherwise(F.col("event_id").cast("string"))
    flag = F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("no")
    return e.select("event_id", parse_value(text, T.LongType()).alias("whole"), parse_value(flag, T.BooleanType()).alias("flag"))


FMIX = "(SELECT event_id, user_id::UBIGINT AS h FROM events)"
for _m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):  # the low half of the product of two 64-bit numbers, by halves that fit
    FMIX = f"(SELECT event_id, (((h & 4294967295)::HUGEINT * {_m} + (((h >> 32)::HUGEINT * {_m}) % 4294967296) * 4294967296) % 18446744073709551616)::UBIGINT AS h FROM (SELECT event_id, xor(h, h >> 33) AS h FROM {FMIX}))"


@_frame("fmix64_rows", f"SELECT event_id, CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h END::BIGINT AS mixed FROM (SELECT event_id, xor(h, h >> 33) AS h FROM {FMIX})")
def _(spark, d):
    return read(spark, d, "events").select("event_id", hashing.fmix64(F.col("user_id").cast("bigint")).alias("mixed"))


EVENT_CELLS = ["event_id", "user_id", "event_type", "value"]
CELLS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
ALL_CELLS = "SELECT event_id, user_id, event_type, value FROM events"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(*(F.col(f.name).cast(f.dataType) for f in CELLS))


@_frame("csv_round_trip", ALL_CELLS)
def _(spark, d):
    at = f"{Scratch(spark, 'csv').root}/events"
    write_csv(_cells(spark, d), at)
    return read_csv(spark, at, CELLS)


@_frame("csv_inferred", ALL_CELLS)
def _(spark, d):
    at = f"{Scratch(spark, 'csv').root}/events"
    write_csv(_cells(spark, d), at)
    return read_csv(spark, at)


@_frame("jsonl_round_trip", ALL_CELLS)
def _(spark, d):
    at = f"{Scratch(spark, 'jsonl').root}/events"
    _cells(spark, d).write.json(at)
    return read_jsonl(spark, at, CELLS)


@_frame("journal_replay", f"SELECT seq, event_id, user_id, event_type, value FROM ({ALL_CELLS}), (SELECT UNNEST([1, 2]) AS seq)")
def _(spark, d):
    at = f"{Scratch(spark, 'journal').root}/events"
    for seq in (1, 2):
        journal.append_insert(_cells(spark, d), at, "events", seq)
    return journal.rows_of(journal.replay(spark, at), "events", CELLS)


@_frame("hash_posting_chunks", "SELECT user_id, event_id // 4096 AS chunk, ARRAY_TO_STRING(LIST(event_id ORDER BY event_id), ',') AS row_ids FROM events GROUP BY ALL")
def _(spark, d):
    return postings.build_chunks(read(spark, d, "events"), "user_id", "event_id", 4096).withColumn("row_ids", F.concat_ws(",", F.col("row_ids").cast("array<string>")))


def _encoded(spark: SparkSession, d: str, column: str, codec: str, size: int = 1024) -> DataFrame:
    return codecs.encode(codecs.chunked(sparse(spark, d), column, "event_id", size), codec)


for _codec, _column in (("raw", "v"), ("delta", "user_id"), ("rle", "et"), ("dict", "et"), ("auto", "et"), ("auto", "user_id")):

    @_frame(f"decode_{_codec}_{_column}", f"SELECT (rn // 1024) AS chunk_id, CAST(rn % 1024 AS INTEGER) AS pos, {_column} AS value FROM (SELECT {_column}, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS rn FROM {NE} ne)")
    def _(spark, d, codec=_codec, column=_column):
        return codecs.decode(_encoded(spark, d, column, codec))


@_frame("codec_slice", f"SELECT rn AS pos, et AS value FROM (SELECT et, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS rn FROM {NE} ne) WHERE rn >= 1000 AND rn < 1064")
def _(spark, d):
    return codecs.decode_range(_encoded(spark, d, "et", "auto"), 1000, 1064, 1024)


#: Bytes of the raw, the delta and the dictionary form of each chunk.
SIZES = f"SELECT rn // 1024 AS chunk_id, CAST(SUM(CASE WHEN et IS NULL THEN 1 ELSE 5 + strlen(et) END) AS BIGINT) AS raw_size, 8 * COUNT(*) AS delta_size, (SELECT SUM(CASE WHEN x IS NULL THEN 1 ELSE 5 + strlen(x) END + 2) FROM (SELECT UNNEST(LIST(DISTINCT et) || CASE WHEN COUNT(*) > COUNT(et) THEN [NULL] ELSE [] END) AS x)) + 4 + 4 * COUNT(*) AS dict_size FROM (SELECT et, ROW_NUMBER() OVER (ORDER BY event_id) - 1 AS rn FROM {NE} ne) GROUP BY 1"


@_frame("codec_sizes", f"SELECT chunk_id, raw_size, delta_size, CAST(dict_size AS BIGINT) AS dict_size FROM ({SIZES})")
def _(spark, d):
    by = lambda column, codec: _encoded(spark, d, column, codec).select("chunk_id", F.col("encoded_size").alias(f"{codec}_size"))
    return by("et", "raw").join(by("user_id", "delta"), "chunk_id").join(by("et", "dict"), "chunk_id")


@_frame("row_group_scan", "SELECT event_id, user_id FROM events WHERE event_id BETWEEN 2500 AND 3500")
def _(spark, d):
    groups = rowgroups.build(read(spark, d, "events").select("event_id", "user_id"), "event_id", 1024)
    return rowgroups.scan(groups, "event_id", ["event_id", "user_id"], 2500, 3500)


@_frame("bitset_clear", "SELECT event_id AS row_id FROM events WHERE value > 50 AND event_type <> 'click'")
def _(spark, d):
    e = read(spark, d, "events")
    return bitset.ids(bitset.clear(bitset.build(e.where("value > 50"), "event_id"), e.where("event_type = 'click'").select("event_id")))


@_frame("bitset_or", "SELECT COUNT(*) AS n FROM events WHERE value > 50 OR event_type = 'click'")
def _(spark, d):
    e = read(spark, d, "events")
    return bitset.popcount(bitset.either(bitset.build(e.where("value > 50"), "event_id"), bitset.build(e.where("event_type = 'click'"), "event_id")))


@_frame("table_stats", "SELECT COUNT(*) AS rows, 2 * CAST(CEIL(COUNT(*) / 1024) AS BIGINT) AS chunks, 16 * COUNT(*) AS encoded_bytes, 32 * COUNT(*) AS raw_estimate, 'user_id' AS indexes FROM events")
def _(spark, d):
    return stats.table_stats(read(spark, d, "events").select("event_id", "user_id"), "event_id", 1024, ["user_id"])


@_frame("generate_events")
def _(spark, d):
    from plinth.sources.generate import generate_events

    return generate_events(spark, 10_000)

