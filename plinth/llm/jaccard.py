"""Exact Jaccard join on word shingles with token-combination prefixes.

Two sets link when their Jaccard similarity is at least num/den. A set of n
tokens (hashed shingles) can miss at most E = n - ceil(t n) of them.

First, sets are left out that can have no partner. In hash order a prefix of
E + 1 + G tokens is taken of every set; of a partner's prefix it must share
G + 1 at least, so a set whose prefix has fewer tokens that any other prefix
holds is out. Of the sets that stay all tokens are counted, and sets with more
than E tokens of their own are out.

Then the index. Tokens are ordered from rare to frequent. Rare ones form a
class of single tokens; frequent ones are dealt to G classes, of which sets
that link must share two tokens, and pairs are indexed. A class of pairs costs
one token, so prefixes are extended to E + 1 + G tokens and have

    coverage = rare + sum over classes (frequent in class - 1) > E,

with which some class shares as many tokens as it indexes. G follows the set's
size in levels of 1/t; a set is indexed at its own level and the next, so sets
that may link meet at one. About three tokens fall to a class, so the index is
linear in the prefix.

Identical sets are one node. Buckets are not expanded into pairs: each bucket's
smallest node is compared with the others, verified links merge components, and
nodes of one component need no comparison; after ROUNDS such rounds all nodes
of different components in a bucket that is still open are compared: as pairs
where a bucket has at most SMALL nodes, else in blocks. Nodes that large
buckets connect are sorted by size and cut into blocks of some BLOCK_TOKENS
tokens; blocks of compatible sizes meet, one matrix product gives the
intersections of all their sets, and only links that merge components leave the
task. So every link between different sets is either found or joins sets
already connected, and no group is expanded into its pairs.
Verification computes the exact intersection, after a bound on the prefixes.

Null and empty texts have the empty set and link with nothing: each is its own
component. With fewer words than a shingle has, the whole sequence is the only
one. Repeated rows and ties fall to the smallest key; rows with null keys take
part, and a component of only such rows has a null id. Other columns are not
carried. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plinth.llm.batches import slices, through, tidy
from plinth.llm.components import components
from plinth.llm.keys import integer_key
from plinth.llm.scratch import Scratch
from plinth.llm.words import Vocabulary, mix, shingle_hashes, words_of
from plinth.operators.relational import part_starts, sequenced

#: A token in more prefixes than this is frequent.
RARE = 16
ROUNDS = 3
SMALL, BLOCK_TOKENS = 32, 200_000
#: Pairs of blocks that one task multiplies.
MEETINGS = 8
#: Keys that are sent to every executor at most (8 bytes each); beyond it they are joined.
MOST_SENT = 2_000_000


class Threshold:
    """The bounds that follow from a similarity of num/den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def slack(self, n: int) -> int:
        return n - -(-self.num * n // self.den)

    def level(self, n: int) -> int:
        return int(math.log(n) / math.log(self.den / self.num) + 1e-9) if n else 0

    def classes(self, level: int) -> int:
        return max(1, self.slack(int((self.den / self.num) ** level)) // 2)

    def prefix(self, n: int, level: int) -> int:
        return min(n, self.slack(n) + 1 + self.classes(level))

    def least_shared(self, n: int) -> int:
        """Tokens of its stored prefix that a set shares at least with any partner's: the prefix that ends first misses E at most."""
        return max(1, min(self.prefix(n, self.level(n) + 1) - self.slack(n), 1 + self.classes(self.level(n))) if n > 2 else 1)


def text_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Each batch (key, text) with the shingle set of every row."""
    for b in slices(batches, 1000):
        vocabulary = Vocabulary()
        numbered = [vocabulary.number(words_of(t)) for t in b.column("text").to_pylist()]
        known = vocabulary.hashes()
        yield b, [shingle_hashes(known[x], n) for x in numbered]


def fingerprint(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def documents(docs: DataFrame, key: str, text: str, n: int, at: Threshold) -> DataFrame:
    """key, n, fp, prefix of every row."""
    rows = docs.select(integer_key(docs, key).alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in text_sets(batches, n):
            cut = [s[: at.prefix(len(s), at.level(len(s)) + 1)] for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary()), lists(cut)], names=["key", "n", "fp", "prefix"])

    return through(rows, run, "key long, n long, fp binary, prefix array<long>")


def survivors(nodes: DataFrame, scratch: Scratch, at: Threshold) -> DataFrame:
    """node, rep, fp of the sets whose prefixes share enough tokens with other prefixes."""
    tokens = nodes.where("n > 1").select("node", F.explode("prefix").alias("token"))
    shared = scratch.keep(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token"), "shared")
    counts = tokens.join(shared, "token").groupBy("node").agg(F.count(F.lit(1)).alias("m"))

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [m >= at.least_shared(n) for m, n in zip(b.column("m").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["node", "rep", "fp", "n"])

    left = scratch.keep(counts.join(nodes.select("node", "rep", "fp", "n"), "node").mapInArrow(tidy(enough), "node long, rep long, fp binary, n long"), "survivors")
    scratch.drop("shared")
    return left


def index(sets: DataFrame, scratch: Scratch, at: Threshold) -> DataFrame:
    """sig, node, n: single rare tokens and pairs of frequent ones, where at least two nodes have them."""
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    shared = scratch.keep(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared2")
    held = tokens.join(shared, "token").groupBy("node").agg(F.first("n").alias("n"), F.collect_list(F.struct("df", "token")).alias("tokens"))
    held = held.where(at.den * F.size("tokens") >= at.num * F.col("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes_out, sizes, sigs = [], [], []
            lists_ = b.column("tokens")
            flat, ends = lists_.flatten(), lists_.offsets.to_numpy() - lists_.offsets[0].as_py()
            dfs, toks = flat.field("df").to_numpy(), flat.field("token").to_numpy()
            for i, (node, n) in enumerate(zip(b.column("node").to_pylist(), b.column("n").to_pylist(), strict=True)):
                df, token = dfs[ends[i] : ends[i + 1]], toks[ends[i] : ends[i + 1]]
                order = np.lexsort((token, df))
                df, token = df[order], token[order]
                own = n - len(token)  # tokens that no other set has come first and cover one each
                level = at.level(n)
                reach = max(at.prefix(n, s) for s in (level, level + 1)) - own
                rare = token[:reach][df[:reach] <= RARE]
                found = [rare.view(np.uint64)]
                often = token[len(token[df <= RARE]) :].view(np.uint64)
                dealt = mix(often)
                for scheme in (level, level + 1):
                    size = at.prefix(n, scheme) - own - int((df <= RARE).sum())
                    if size < 2:
                        continue
                    groups = dealt[:size] % np.uint64(at.classes(scheme))
                    by = np.lexsort((often[:size], groups))
                    g, t = groups[by], often[:size][by]
                    far = 1
                    while far < size and (same := g[far:] == g[:-far]).any():  # all pairs inside each class
                        found.append(mix(mix(t[:-far][same] + np.uint64(scheme + 1)) + t[far:][same]))
                        far += 1
                made = np.concatenate(found)
                sigs.append(made)
                nodes_out.append(np.full(len(made), node, np.int64))
                sizes.append(np.full(len(made), n, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes_out)), pa.array(np.concatenate(sizes))], names=["sig", "node", "n"])

    found = scratch.keep(through(held, run, "sig long, node long, n long"), "signatures")
    scratch.drop("shared2")
    often = found.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("sig")
    kept = scratch.keep(found.join(often, "sig"), "index")
    scratch.drop("signatures")
    return kept


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, n: int, scratch: Scratch) -> DataFrame:
    """node, tokens of the wanted nodes (node, rep, fp), from the texts of their representatives alone."""
    reps = wanted.select("rep").distinct()
    rows = docs.select(integer_key(docs, key).alias("key"), F.col(f"`{text}`").alias("text"))
    few = wanted.count() <= MOST_SENT
    rows = rows.join(F.broadcast(reps) if few else reps, rows["key"].eqNullSafe(reps["rep"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in text_sets(batches, n):
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in sets], pa.binary()), lists(sets)], names=["fp", "tokens"])

    # a node is one fingerprint, so rows of a repeated key are found where the join has put them
    made = through(rows, run, "fp binary, tokens array<long>").join(wanted.select("fp", "node", "n"), "fp")
    return scratch.keep(made.dropDuplicates(["fp"]).select("node", "n", "tokens"), "sets")


def verified(pairs: DataFrame, prefixes: DataFrame, sets: DataFrame, at: Threshold) -> DataFrame:
    """The pairs (a, b) that link."""
    small = prefixes.select("node", "n", "prefix")
    p = pairs.join(small.toDF("a", "na", "pa"), "a").join(small.toDF("b", "nb", "pb"), "b")
    p = p.where((at.den * F.col("na") >= at.num * F.col("nb")) & (at.den * F.col("nb") >= at.num * F.col("na")))
    # one side's prefix lies within the other's reach: all but size - need of its tokens are then in the other prefix
    need = F.ceil(at.num * (F.col("na") + F.col("nb")) / (at.num + at.den))
    shared, short = F.size(F.array_intersect("pa", "pb")), F.least(F.size("pa") - F.col("na"), F.size("pb") - F.col("nb"))
    p = p.where(shared >= short + need).select("a", "b", "na", "nb")
    s = sets.select("node", "tokens")
    p = p.join(s.toDF("a", "ta"), "a").join(s.toDF("b", "tb"), "b").withColumn("i", F.size(F.array_intersect("ta", "tb")).cast("bigint"))
    return p.where(at.den * F.col("i") >= at.num * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def intersections(ta: list[np.ndarray], tb: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks, over the tokens that both blocks hold."""
    la, lb = (np.fromiter(map(len, t), np.int64, len(t)) for t in (ta, tb))
    a, b = np.concatenate(ta), np.concatenate(tb)
    common = np.intersect1d(a, b)
    out = np.zeros((len(ta), len(tb)), np.float32)
    sides = []
    for t, lengths in ((a, la), (b, lb)):
        owner = np.repeat(np.arange(len(lengths)), lengths)
        at = np.minimum(np.searchsorted(common, t), max(len(common) - 1, 0))
        hit = common[at] == t if len(common) else np.zeros(len(t), bool)
        sides.append((owner[hit], at[hit]))
    for low in range(0, len(common), 4096):
        parts = []
        for (owner, at), n in zip(sides, (len(ta), len(tb)), strict=True):
            m = np.zeros((n, min(4096, len(common) - low)), np.float32)
            inside = (at >= low) & (at < low + 4096)
            m[owner[inside], at[inside] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def merging(pairs: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Of links (a, b, label of a, label of b) those that join components."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for a, b, la, lb in pairs:
        x, y = top(la), top(lb)
        if x != y:
            up[x] = y
            out.append((a, b))
    return out


def block_links(open_: DataFrame, sets: DataFrame, scratch: Scratch, at: Threshold) -> DataFrame:
    """Links between different components of the nodes that these buckets (sig, node, n, label, a) connect."""
    groups = components(open_.where("node <> a").select("a", F.col("node").alias("b")).distinct(), scratch, "dense").toDF("node", "cluster")
    held = open_.select("node", "n", "label").distinct().join(groups, "node")
    # sums run over the whole order in range parts, so that a large cluster is no single task; a block is what a cluster has of one stretch of it
    rows = sequenced(held, [F.col("cluster"), F.col("n"), F.col("node")], "jaccard-order")
    starts = part_starts(rows.groupBy("_part").agg(F.sum("n").alias("_n")))
    inside = F.sum("n").over(Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = rows.withColumn("_sum", inside).join(F.broadcast(starts), "_part").withColumn("block", F.floor((F.col("_start") + F.col("_sum")) / BLOCK_TOKENS))
    held = scratch.keep(held.select("node", "n", "label", "cluster", "block"), "dense-nodes")
    data = held.join(sets.select("node", "tokens"), "node").groupBy("cluster", "block").agg(F.collect_list(F.struct("node", "label", "tokens")).alias("rows"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    data = scratch.keep(data, "dense-blocks")
    ranges = data.select("cluster", "block", "lo", "hi")
    met = ranges.select("cluster", "block", "hi").join(ranges.select("cluster", F.col("block").alias("block2"), F.col("lo").alias("lo2")), "cluster").where((F.col("block") <= F.col("block2")) & (at.num * F.col("lo2") <= at.den * F.col("hi"))).select("cluster", "block", "block2")
    met = scratch.keep(met, "dense-met")
    tasks = max(1, -(-met.count() // MEETINGS))
    rows = met.repartition(tasks).join(data.select("cluster", "block", F.col("rows").alias("rows1")), ["cluster", "block"]).join(data.select("cluster", F.col("block").alias("block2"), F.col("rows").alias("rows2")), ["cluster", "block2"])

    def columns(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        x = cell.values
        tokens = x.field("tokens")
        ends = tokens.offsets.to_numpy()
        flat = tokens.values.to_numpy()
        return x.field("node").to_numpy(), x.field("label").to_numpy(), [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (na, la, ta), (nb, lb, tb) = columns(b.column("rows1")[i]), columns(b.column("rows2")[i])
                both = intersections(ta, tb)
                sizes = np.fromiter(map(len, ta), np.int64)[:, None] + np.fromiter(map(len, tb), np.int64)
                hit = (at.den * both.astype(np.int64) >= at.num * (sizes - both.astype(np.int64))) & (la[:, None] != lb)
                x, y = np.nonzero(hit)
                found = merging(list(zip(na[x].tolist(), nb[y].tolist(), la[x].tolist(), lb[y].tolist(), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return through(rows.select("rows1", "rows2"), run, "a long, b long")


def join_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """key, n_shingles, component_id of every row."""
    at, scratch = Threshold(num, den), Scratch(docs.sparkSession, "jaccard", clear=True)
    made = scratch.keep(documents(docs, key, text, shingle, at), "documents")
    nodes = made.where("n > 0").groupBy("fp").agg(F.min("key").alias("rep"), F.min("n").alias("n"), F.first("prefix").alias("prefix"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = scratch.keep(made.select("key", "n", "fp"), "rows")
    scratch.drop("documents")
    sets = full_sets(docs, survivors(nodes, scratch, at), key, text, shingle, scratch)
    members = index(sets, scratch, at)
    wanted = scratch.keep(members.select("node").distinct(), "wanted")
    labels = scratch.keep(wanted.select("node", F.col("node").alias("label")), "labels")
    # of the long columns only what verification reads stays on disk
    few = wanted.count() <= MOST_SENT
    sets, prefixes = (scratch.keep(t.join(F.broadcast(wanted) if few else wanted, "node", "left_semi"), name) for t, name in ((sets, "indexed"), (nodes.select("node", "n", "prefix"), "prefixes")))
    nodes = scratch.keep(nodes.select("node", "rep", "fp"), "named")
    scratch.drop("sets", "nodes", "survivors")
    links = None
    for k in range(ROUNDS + 1):
        open_ = members.join(labels, "node")
        mixed = open_.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("a")).where("lo < hi")
        open_ = scratch.keep(open_.join(mixed.select("sig", "a"), "sig"), f"open{k}")
        if not open_.limit(1).count():
            break
        close = (at.den * F.col("n") >= at.num * F.col("bn")) & (at.den * F.col("bn") >= at.num * F.col("n"))
        if k < ROUNDS:
            heads = open_.where("node = a").select("sig", F.col("n").alias("bn"), F.col("label").alias("bl")).distinct()
            pairs = open_.join(heads, "sig").where(close & (F.col("label") != F.col("bl"))).select("a", F.col("node").alias("b"))
            members = open_.where("node <> a").select("sig", "node", "n")
        else:
            sizes = open_.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"))
            large = scratch.keep(sizes.where(F.col("_n") > SMALL).select("sig"), "large")
            few = open_.join(large, "sig", "left_anti").drop("a")
            other = few.select("sig", F.col("node").alias("b"), F.col("label").alias("bl"), F.col("n").alias("bn"))
            pairs = few.withColumnRenamed("node", "a").join(other, "sig").where(close & F.expr("a < b and label <> bl")).select("a", "b")
            if large.limit(1).count():
                dense = scratch.keep(block_links(open_.join(large, "sig"), sets, scratch, at), "dense")
                links = dense if links is None else links.unionByName(dense)
        found = scratch.keep(verified(scratch.keep(pairs.distinct(), f"pairs{k}"), prefixes, sets, at), f"links{k}")
        scratch.drop(f"pairs{k}", f"open{k}" if k == ROUNDS else "none")
        if found.limit(1).count():
            links = found if links is None else links.unionByName(found)
        elif k < ROUNDS or links is None:
            continue
        joined = components(links, scratch, f"components{k}")
        labels = scratch.keep(wanted.select("node").join(joined, "node", "left").select("node", F.coalesce("label", "node").alias("label")), f"labels{k}")
    ids = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = ids.groupBy("label").agg(F.min("rep").alias("component_id"))
    ids = scratch.keep(ids.join(least, "label").select("fp", "component_id"), "ids")
    joined = rows.select("key", "n", "fp").join(ids, "fp", "left")
    return joined.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"))
