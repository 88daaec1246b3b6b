"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to). Each pattern can be used several times over; the first pass over it is
free and each further pass costs more (convex repetition costs). A flow from
patterns to source quotas of least cost decides how many words each pattern
gives; then a seeded order of its documents turns that into whole copies.

Only totals reach the driver: one row per pattern, for the flow, which is
bounded by the number of patterns and not of documents. The documents of the
last, partial pass over a pattern are cut off at one point of their seeded
order, found through a histogram of ``BINS`` bins and an exact sum over the one
bin in which the cut lies. Whole documents are taken: those up to the cut, and
then, from the largest size to the smallest, as many beyond it as fit into the
words still missing. What is left is less than any document not taken, of those
with words. The sizes beyond the cut are counted, one row per size, and what is
taken of them is a few spans of whole sizes and a few sizes taken in part, as
each shortfall halves the words missing at least.

Null texts have size 0 and are taken 0 words. A null source is a source of its
own, the last. Repeated rows count each; rows equal in key and text share one
place in the order, and as many of them are taken as fit. An empty table gives an empty result. Other columns are not
carried by ``mix``; ``copies`` keeps them all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.llm.scratch import Scratch

WORDS = r"[^\x20\x09-\x0D]+"
BINS = 1 << 14
SEED = 17
WEIGHTS = (3, 1, 2)
SHARE, MOST_COPIES = 1.5, 2
#: Of each pattern: its first source's size and target, whole passes, words of the last one.
PER = pa.schema([("_p", pa.list_(pa.string())), ("source_size", pa.int64()), ("target", pa.float64()), ("passes", pa.int64()), ("rest", pa.int64())])
#: Of the sizes beyond a cut: all documents from lo to hi (n is null), or n of those of one size.
SPANS = "_p array<string>, spans array<struct<lo bigint, hi bigint, n bigint>>"


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Words for each source: weights repeat over the sources by code point, null last; what exceeds ``most`` times a source's size is shared anew."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / whole > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


class Flow:
    """Min-cost flow by successive shortest paths with potentials, on integers."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, room: int, cost: int) -> int:
        at = len(self.to)
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return at

    def run(self, source: int, sink: int) -> None:
        n = len(self.edges)
        height = [0] * n
        while True:
            far, via = [None] * n, [-1] * n
            far[source] = 0
            queue = [(0, source)]
            while queue:
                d, v = heapq.heappop(queue)
                if d > far[v]:
                    continue
                for e in self.edges[v]:
                    if self.room[e] > 0:
                        w, nd = self.to[e], d + self.cost[e] + height[v] - height[self.to[e]]
                        if far[w] is None or nd < far[w]:
                            far[w], via[w] = nd, e
                            heapq.heappush(queue, (nd, w))
            if far[sink] is None:
                return
            for v in range(n):
                if far[v] is not None:
                    height[v] += far[v]
            path, v = [], sink
            while v != source:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            step = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= step
                self.room[e ^ 1] += step


def route(patterns: dict[tuple, int], quotas: dict[str | None, float], most: int = MOST_COPIES) -> dict[tuple, int]:
    """Words that each pattern gives. patterns: sorted tuple of sources -> words. Pass k over a pattern costs k a word."""
    names, order = list(quotas), sorted(patterns, key=repr)
    flow = Flow(2 + len(order) + len(names))
    at = {s: 2 + len(order) + i for i, s in enumerate(names)}
    gives: dict[tuple, list[int]] = {}
    for i, p in enumerate(order):
        gives[p] = [flow.add(0, 2 + i, patterns[p], k) for k in range(most)]
        for s in p:
            flow.add(2 + i, at[s], most * patterns[p], 0)
    for s in names:
        flow.add(at[s], 1, round(quotas[s]), 0)
    flow.run(0, 1)
    return {p: sum(flow.room[e ^ 1] for e in es) for p, es in gives.items()}


def _prepared(docs: DataFrame, key: str, text: str, source: str, seed: int) -> list[Column]:
    """Size and place in the seeded order of each row."""
    t = F.col(f"`{text}`")
    size = F.coalesce(F.regexp_count(t, F.lit(WORDS)), F.lit(0)).cast("bigint")
    return [size.alias("_size"), F.xxhash64(F.lit(seed), F.col(f"`{key}`"), t).alias("_place"), F.sort_array(F.array_distinct(F.col(f"`{source}`")) if dict(docs.dtypes)[source].startswith("array") else F.array(F.col(f"`{source}`"))).alias("_pattern")]


def plan(sized: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per pattern: its sources' size and target, whole passes, and the cut of the last pass."""
    spark = sized.sparkSession
    bin_of = F.pmod("_place", F.lit(BINS)).cast("int")
    bins = scratch.keep(sized.groupBy("_pattern", bin_of.alias("_bin")).agg(F.sum("_size").alias("_n")), "bins")
    totals = {tuple(r[0]): r[1] for r in bins.groupBy("_pattern").agg(F.sum("_n")).collect()}
    sizes: dict[str | None, int] = {}
    for p, n in totals.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    wanted = targets(sizes, weights, share, most)
    given = route(totals, wanted, most)
    rows = [(list(p), sizes[p[0]] if p else 0, float(wanted[p[0]]) if p else 0.0, given[p] // n if n else 0, given[p] % n if n else 0) for p, n in totals.items()]
    # by Arrow: rows from a list would take Python workers of another kind, which stay beside those of later stages
    table = pa.Table.from_pylist([dict(zip(PER.names, r, strict=True)) for r in rows], schema=PER)
    per = spark.createDataFrame(table)
    # the bin in which the last pass ends
    before = F.sum("_n").over(Window.partitionBy("_pattern").orderBy("_bin")) - F.col("_n")
    cut = bins.withColumn("_before", before).join(F.broadcast(per), F.col("_pattern") == F.col("_p")).where((F.col("rest") > 0) & (F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("_n") > F.col("rest")))
    cut = cut.select("_p", F.col("_bin").alias("_cut_bin"), (F.col("rest") - F.col("_before")).alias("_room"))
    cut = scratch.keep(cut, "cut")
    inside = sized.join(F.broadcast(cut), (F.col("_pattern") == F.col("_p")) & (bin_of == F.col("_cut_bin")))
    order = Window.partitionBy("_p").orderBy("_place")
    places = inside.groupBy("_p", "_room", "_place").agg(F.sum("_size").alias("_size"))
    sums = places.withColumn("_room", F.col("_room") - F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_size") > F.col("_room"))
    stops = sums.groupBy("_p").agg(F.min(F.struct("_place", "_room")).alias("_at"))
    stops = cut.drop("_room").join(F.broadcast(stops), "_p", "left").select("_p", "_cut_bin", F.col("_at._place").alias("_stop"), F.coalesce("_at._room", F.lit(0)).alias("_room"))
    stops = scratch.keep(stops, "stops")
    # documents beyond the cut that fit into what it left
    beyond = (bin_of > F.col("_cut_bin")) | (bin_of == F.col("_cut_bin")) & (F.col("_place") >= F.col("_stop"))
    fits = sized.where("_size > 0").join(F.broadcast(stops), F.col("_pattern") == F.col("_p")).where(beyond & (F.col("_size") <= F.col("_room"))).select("_p", "_room", "_size", "_place")
    counts = fits.groupBy("_p", "_room", "_size").agg(F.count(F.lit(1)).alias("_n"))
    spans = scratch.keep(counts.groupBy("_p", "_room").agg(F.collect_list(F.struct("_size", "_n")).alias("_sizes")).mapInArrow(_spans, SPANS), "spans")
    each = spans.select("_p", F.explode("spans").alias("_s"))
    part = each.where("_s.n IS NOT NULL").select("_p", F.col("_s.lo").alias("_size"), F.col("_s.n").alias("_need"))
    # of a size taken in part the documents with the largest places, again by bins
    some = fits.join(F.broadcast(part), ["_p", "_size"]).withColumn("_high", F.shiftright("_place", 65 - BINS.bit_length()))
    ends = scratch.keep(_ends(some, "_high"), "ends")
    edges = scratch.keep(_ends(some.drop("_need").join(F.broadcast(ends.drop("_n")), ["_p", "_size", "_high"]), "_place"), "edges")
    whole = each.where("_s.n IS NULL").groupBy("_p").agg(F.collect_list(F.struct("_s.lo", "_s.hi")).alias("_whole"))
    edges = edges.groupBy("_p").agg(F.collect_list(F.struct(F.col("_size").alias("size"), F.col("_place").alias("place"), F.col("_need").alias("n"), (F.col("_need") == F.col("_n")).alias("all"))).alias("_edges"))
    return scratch.keep(per.join(F.broadcast(stops), "_p", "left").join(F.broadcast(whole), "_p", "left").join(F.broadcast(edges), "_p", "left"), "plan")


def _ends(rows: DataFrame, unit: str) -> DataFrame:
    """In which unit the row number ``_need`` of a size lies, from the largest unit down, and its number there."""
    n = rows.groupBy("_p", "_size", "_need", unit).agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_before", F.sum("_n").over(Window.partitionBy("_p", "_size").orderBy(F.desc(unit))) - F.col("_n"))
    return n.where((F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_n") >= F.col("_need"))).select("_p", "_size", unit, (F.col("_need") - F.col("_before")).alias("_need"), "_n")


def fill(room: int, sizes: dict[int, int]) -> list[tuple[int, int, int | None]]:
    """Spans (lo, hi, None) of sizes taken whole, and (size, size, n) where n are taken. sizes: documents of each size. From the largest size down, as many as fit."""
    out: list[tuple[int, int, int | None]] = []
    top = None
    for size in sorted(sizes, reverse=True):
        n = min(sizes[size], room // size)
        room -= n * size
        if n == sizes[size]:
            top, out = (size, [*out, (size, size, None)]) if top is None else (top, [*out[:-1], (size, top, None)])
            continue
        top = None
        if n:
            out.append((size, size, n))
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            found = fill(r["_room"], {x["_size"]: x["_n"] for x in r["_sizes"]})
            yield pa.RecordBatch.from_pylist([{"_p": r["_p"], "spans": [dict(zip(("lo", "hi", "n"), x, strict=True)) for x in found]}], schema=pa.schema([("_p", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("lo", "hi", "n")])))]))


def _copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Adds source_size, target and the number of whole copies."""
    bin_of = F.pmod("_place", F.lit(BINS)).cast("int")
    # one row per pattern: the driver held all of them for the flow
    rows = rows.join(F.broadcast(planned), F.col("_pattern").eqNullSafe(F.col("_p")), "left").withColumn("_nth", F.lit(1))
    if planned.where(F.exists("_edges", lambda e: ~e["all"])).limit(1).count():  # rows that share a place and don't all fit
        tied = F.coalesce(F.exists("_edges", lambda e: ~e["all"] & (e["size"] == F.col("_size")) & (e["place"] == F.col("_place"))), F.lit(False))
        rows = rows.where(~tied).unionByName(rows.where(tied).withColumn("_nth", F.row_number().over(Window.partitionBy("_pattern", "_place").orderBy("_size"))))
    whole = F.exists("_whole", lambda s: F.col("_size").between(s["lo"], s["hi"]))
    edge = F.exists("_edges", lambda e: (e["size"] == F.col("_size")) & ((F.col("_place") > e["place"]) | (F.col("_place") == e["place"]) & (F.col("_nth") <= e["n"])))
    inside = (F.col("rest") > 0) & ((bin_of < F.col("_cut_bin")) | (bin_of == F.col("_cut_bin")) & (F.col("_stop").isNull() | (F.col("_place") < F.col("_stop"))) | whole | edge)
    return rows.withColumn("_copies", F.col("passes") + F.coalesce(inside, F.lit(False)).cast("bigint"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """key, size, source_size, target, taken, copies. With several sources to a row, size and target are its first one's."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.keep(docs.select(F.col(f"`{key}`").alias("_key"), *_prepared(docs, key, text, source, seed)), "sized")
    out = _copies(sized, plan(sized, scratch, weights, share, most))
    return out.select(F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is taken."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = scratch.keep(docs.select(*_prepared(docs, key, text, source, seed)), "sized")
    planned = plan(sized, scratch, weights, share, most)
    rows = _copies(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *_prepared(docs, key, text, source, seed)), planned)
    return rows.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
