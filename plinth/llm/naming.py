"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed number of characters. Level 0 sorts the
distinct blocks and names each by an integer; every further level names the
distinct pairs of adjacent names, until one name is left for each document.
Names are given to sorted distinct contents and never stand for a hash, so two
texts have the same (level, name) exactly when they are identical.

How it spreads: distinct blocks are combined on the map side before their
shuffle, so copies collapse where they are read. Blocks that make up more than
1/HOT of all are routed apart, by counts of their hashes: fewer than HOT of
them exist, which bounds the broadcast that hands them their names, and no task
gets all rows of one block. After level 0 only integers move, and only those
of texts with more than one block.

Null texts count as empty, and all empty texts are equal. Rows with a null key
take part; a group of only such rows keeps the null key. Repeated rows each
appear, and exactly one row of each group is marked kept. An empty table gives an empty result. Input that is not read from files
as it is, and so may come in another order to a repeated task, is kept first.
Only key and text are read; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.llm.scratch import Scratch, steady

BLOCK = 4096
HOT = 1024
#: A pair's name = shard * SPAN + rank in the shard. A shard is sorted in one task.
SHARDS, SPAN = 4096, 1 << 40


def blocks(text: Column, size: int) -> Column:
    """Blocks of ``size`` characters, the last one shorter; the empty text is one empty block."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def hot_hashes(cut: DataFrame, scratch: Scratch, share: int = HOT) -> list[int]:
    """Hashes of the blocks that make up more than 1/share of all: fewer than ``share``."""
    counts = scratch.keep(cut.groupBy(F.xxhash64("block").alias("hash")).agg(F.count(F.lit(1)).alias("n")), "hashes")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = [r["hash"] for r in counts.where(F.col("n") > max(1, total / share)).select("hash").collect()]
    scratch.drop("hashes")
    return found


def named_pairs(pairs: DataFrame) -> DataFrame:
    """Gives each distinct (a, b) an integer: pairs are dealt to shards and sorted inside them."""
    dealt = pairs.select("a", "b").distinct().withColumn("_shard", F.pmod(F.xxhash64("a", "b"), F.lit(SHARDS)))
    rank = F.row_number().over(Window.partitionBy("_shard").orderBy("a", "b"))
    return dealt.select("a", "b", (F.col("_shard") * SPAN + rank).alias("name"))


def named_blocks(docs: DataFrame, text: Column, size: int, carried: list[Column], scratch: Scratch) -> DataFrame:
    """Level 0: the carried columns, position and name of each block."""
    whole = docs.select(*carried, text.alias("_body"))  # apart from the generator, so that a row keeps one number
    cut = whole.select(*(c for c in whole.columns if c != "_body"), F.posexplode(blocks(F.col("_body"), size)).alias("at", "block"))
    bare = docs.select(F.explode(blocks(text, size)).alias("block"))
    hot = hot_hashes(bare, scratch)
    is_hot = F.xxhash64("block").isin(hot) if hot else F.lit(False)
    # sorted distinct blocks take the integers of their partition; 0 stands for no block
    names = bare.where(~is_hot).distinct().sortWithinPartitions("block").select("block", (F.monotonically_increasing_id() + 1).alias("name"))
    out = cut.where(~is_hot).join(names, "block").drop("block")
    if hot:
        few = bare.where(is_hot).distinct().withColumn("name", -F.row_number().over(Window.orderBy("block")).cast("bigint"))
        out = out.unionByName(cut.where(is_hot).join(F.broadcast(few), "block").drop("block"))
    return scratch.keep(out, "level0")


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> tuple[DataFrame, Scratch]:
    """row, key, text_sha256, level, name: one row per input row, which ``row`` numbers."""
    scratch = Scratch(docs.sparkSession, "naming")
    docs = steady(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), scratch)
    body = F.coalesce("text", F.lit(""))
    carried = [F.monotonically_increasing_id().alias("row"), F.col("key"), F.sha2(F.encode(body, "UTF-8"), 256).alias("text_sha256"), F.ceil(F.length(body) / block).alias("n")]
    level = named_blocks(docs, body, block, carried, scratch)
    done = [level.where("n <= 1").select("row", "key", "text_sha256", F.lit(0).alias("level"), "name")]
    rest, k = level.where("n > 1"), 0
    while rest.limit(1).count():
        k += 1
        even = F.col("at") % 2 == 0
        pairs = rest.groupBy("row", F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.max(F.when(~even, F.col("name"))).alias("b"),
            *(F.first(c).alias(c) for c in ("key", "text_sha256")),
            F.ceil(F.first("n") / 2).alias("n"),
        )
        pairs = scratch.keep(pairs.withColumn("b", F.coalesce("b", F.lit(0))), f"pairs{k}")
        level = scratch.keep(pairs.join(named_pairs(pairs), ["a", "b"]).drop("a", "b"), f"level{k}")
        scratch.drop(f"pairs{k}")
        done.append(level.where("n = 1").select("row", "key", "text_sha256", F.lit(k).alias("level"), "name"))
        rest = level.where("n > 1")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, scratch


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """key, keep_id, group_size, kept, text_sha256 for every row; of equal texts the row with the largest key stays."""
    ids, scratch = identities(docs, key, text, block)
    last = F.max(F.struct("key", "row"))
    groups = ids.groupBy("level", "name").agg(last.alias("_last"), F.count(F.lit(1)).alias("group_size"))
    groups = scratch.keep(groups.select("level", "name", "group_size", F.col("_last.key").alias("keep_id"), F.col("_last.row").alias("_row")), "groups")
    return ids.join(groups, ["level", "name"]).select(F.col("key").alias(key), "keep_id", "group_size", (F.col("row") == F.col("_row")).alias("kept"), "text_sha256")
