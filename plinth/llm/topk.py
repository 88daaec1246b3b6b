"""Exact top-k by inner product with pivot-table elimination.

Every vector's distances to the origin and to PIVOTS fixed pivots are computed
once and stored beside it. The greatest lower bound of a distance that such a
table allows in Euclidean space is not the largest difference of two distances
but what all of them say together: distances to the pivots fix a vector's place
in the space that the pivots span, and its height over that space. So the table
holds these (the coordinates, made from the distances, and the height), and for
a query and a candidate

    <q, x>  <=  <coordinates of q, coordinates of x> + height of q * height of x,

which is (|q|^2 + |x|^2 - bound^2) / 2 for that greatest lower bound. Candidates
are evaluated in the order of their bounds until the next bound is under the
k-th best score, which is exact; what is left is eliminated, whole blocks at
once where no bound reaches.

Layout: vectors are packed into blocks of at most BLOCK rows, and each block of
queries meets each block of candidates, in tiles of TILE x TILE blocks a task. A
task keeps a running top k for each query block it sees, so later blocks are cut
against the best so far, and it emits k rows a query; a final ranking merges
these. Pivots are chosen by farthest-first traversal from a sample of SAMPLE
vectors; any choice is exact.

Components become floor(64 x). Vectors so large that doubles would round their
products are packed apart as 64-bit integers, are no pivots and meet all others
without bounds; a component or score that is no long is an error. Vectors that
are null or hold a null or non-finite component take no part; nor do ids that
are null. Ids of another type than whole numbers are an error. Only vectors of
equal length meet. A query does not meet rows with its own id. Ties go to the
smaller id; repeated rows are each a query and each rank. An empty table gives
an empty result. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plinth.llm.keys import integer_key
from plinth.llm.scratch import Scratch

PIVOTS, SAMPLE, BLOCK = 56, 2048, 4096
QUERY_BLOCK = 512
FIRST = 64
SCALE = 64
TILE = 8
#: Squares of distances are exact in doubles while width x component**2 stays under this.
PLAIN = 2.0**51
#: A pivot that adds less than this share of the first one's length to the span is left out, so that rounding stays far under SLACK.
LEAST_NEW, SLACK = 1e-3, 1e-7
PACKED = "block string, width int, size int, ids binary, vectors binary, places binary"
HITS = "block string, place int, query_id long, vec_id long, score long"


def whole(vectors) -> np.ndarray:
    """Vectors of one length as integers."""
    x = np.floor(SCALE * np.asarray(vectors, np.float64))
    if (np.abs(x) >= 2.0**63).any():
        raise OverflowError("a component times 64 is no long")
    return x.astype(np.int64)


def usable(v: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def large(vectors: np.ndarray) -> np.ndarray:
    return vectors.shape[1] * (SCALE * np.abs(vectors).max(1, initial=0) + 1) ** 2 >= PLAIN


def products(y: np.ndarray, q: np.ndarray) -> np.ndarray:
    s = y @ q
    if s.dtype == object and any(abs(n) >= 2**63 for n in s):
        raise OverflowError("a score is no long")
    return s.astype(np.int64)


def choose_pivots(vectors: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Farthest-first: each next pivot is the vector farthest from all before it."""
    if not len(vectors):
        return vectors
    x = vectors.astype(np.float64)
    at = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < min(n, len(x)):
        at.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return vectors[at]


class Table:
    """The pivots, and how distances to them become places."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots.astype(np.float64)
        kept: list[np.ndarray] = []  # orthonormal directions
        for p in self.pivots:
            rest = p - sum(((p @ d) * d for d in kept), np.zeros_like(p))
            rest = rest - sum(((rest @ d) * d for d in kept), np.zeros_like(p))  # once more, against rounding
            size = np.sqrt(rest @ rest)
            if size > LEAST_NEW * max(1.0, np.sqrt(p @ p)):
                kept.append(rest / size)
        self.axes = np.array(kept).reshape(len(kept), self.pivots.shape[1] if self.pivots.ndim == 2 else 0)
        # the axes as combinations of pivots: coordinates follow from products with the pivots, and these from distances
        self.mix = np.linalg.lstsq(self.pivots.T, self.axes.T, rcond=None)[0] if len(kept) else np.zeros((len(self.pivots), 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the origin and to each pivot, exact on integers of this size."""
        x = x.astype(np.float64)
        norms = (x**2).sum(1)
        return np.concatenate([norms[:, None], norms[:, None] + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T], 1)

    def places(self, x: np.ndarray) -> np.ndarray:
        """Coordinates in the span of the pivots, and the height over it, rounded up. Vectors of another length have their length as height."""
        if x.shape[1] != self.axes.shape[1] or not len(self.axes):
            norms = (x.astype(np.float64) ** 2).sum(1)
            return np.sqrt(norms)[:, None] * (1 + SLACK)
        far = self.distances(x)
        products = (far[:, :1] + (self.pivots**2).sum(1) - far[:, 1:]) / 2
        at = products @ self.mix
        height = np.sqrt(np.maximum(far[:, 0] - (at**2).sum(1), 0) + SLACK * far[:, 0])
        return np.concatenate([at, height[:, None]], 1)


def pack(vectors: DataFrame, table: Table, size: int) -> DataFrame:
    """Rows (key, v) to blocks of one width each, with the places of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, bool], tuple[list[np.ndarray], list[np.ndarray]]] = {}

        def blocks(of: tuple[int, bool], least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, rows = (np.concatenate(x) for x in held.pop(of))
            at = 0
            while len(ids) - at >= least and at < len(ids):
                made += 1
                x, kind = whole(rows[at : at + size]), np.int64 if of[1] else np.int32
                yield pa.RecordBatch.from_pydict({"block": [f"{task}-{made}"], "width": pa.array([of[0]], pa.int32()), "size": pa.array([np.dtype(kind).itemsize], pa.int32()), "ids": [ids[at : at + size].tobytes()], "vectors": [x.astype(kind).tobytes()], "places": [table.places(x).tobytes()]})
                at += size
            if at < len(ids):
                held[of] = [ids[at:]], [rows[at:]]

        for b in batches:
            keys, lists = b.column("key").to_numpy(zero_copy_only=False), b.column("v")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            widths = np.diff(ends)
            for width in np.unique(widths).tolist():
                mine = np.flatnonzero(widths == width)
                x = flat[ends[mine][:, None] + np.arange(width)]
                big = large(x)
                for kind in (False, True):
                    some = mine[big == kind]
                    if len(some):
                        ids, rows = held.setdefault((width, kind), ([], []))
                        ids.append(keys[some])
                        rows.append(x[big == kind])
                        if sum(map(len, ids)) >= size:
                            yield from blocks((width, kind), size)
        for of in list(held):
            yield from blocks(of, 1)

    return vectors.mapInArrow(run, PACKED)


class Best:
    """Running top k of one query block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray, k: int):
        self.ids, self.x, self.places, self.k = ids, vectors, places, k
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        self.top: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        #: Pairs met and scores computed.
        self.met = self.evaluated = 0

    def meet(self, ids: np.ndarray, x: np.ndarray, places: np.ndarray) -> None:
        width, most = x.shape[1], [float(np.abs(a).max(initial=0)) for a in (self.x, x)]
        if width * max(most) ** 2 < PLAIN and places.shape[1] == self.places.shape[1]:
            lengths = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            bounds = self.places @ places.T + SLACK * self.lengths[:, None] * lengths + 0.5
            kind = np.float64
        else:
            bounds = np.full((len(self.ids), len(ids)), np.inf)
            kind = np.float64 if width * most[0] * most[1] < PLAIN else np.int64 if width * most[0] * most[1] < 2.0**62 else object
        bounds[self.ids[:, None] == ids[None, :]] = -np.inf
        y, q = x.astype(kind), self.x.astype(kind)
        highest = bounds.max(1, initial=-np.inf)
        self.met += bounds.size
        for i in range(len(self.ids)):
            b = bounds[i]
            scores, found = self.top[i]
            least = scores[-1] if len(scores) == self.k else -np.inf
            if highest[i] < least or highest[i] == -np.inf:
                continue
            rest = np.flatnonzero((b >= least) & (b > -np.inf))
            if len(rest) > FIRST:  # the best bounds first: they raise the least score
                part = rest[np.argpartition(-b[rest], FIRST)[:FIRST]]
                scores, found = self.evaluate(i, part, scores, found, y, q, ids)
                b[part] = -np.inf
                least = scores[-1] if len(scores) == self.k else -np.inf
                rest = rest[(b[rest] >= least) & (b[rest] > -np.inf)]
            rest = rest[np.argsort(-b[rest])]
            for at in range(0, len(rest), FIRST):
                part = rest[at : at + FIRST]
                if len(scores) == self.k and b[part[0]] < scores[-1]:
                    break
                scores, found = self.evaluate(i, part, scores, found, y, q, ids)
            self.top[i] = scores, found

    def evaluate(self, i: int, part: np.ndarray, scores: np.ndarray, found: np.ndarray, y: np.ndarray, q: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.evaluated += len(part)
        return self.cut(np.concatenate([scores, products(y[part], q[i])]), np.concatenate([found, ids[part]]))

    def cut(self, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.lexsort((ids, -scores))[: self.k]
        return scores[keep], ids[keep]

    def rows(self, block: str) -> pa.RecordBatch:
        places = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(s) for s, _ in self.top])
        scores, found = (np.concatenate([t[j] for t in self.top]) for j in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array([block] * len(places), pa.string()), pa.array(places), pa.array(self.ids[places]), pa.array(found), pa.array(scores)], names=["block", "place", "query_id", "vec_id", "score"])


def unpack(ids: bytes, vectors: bytes, places: bytes, width: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, f"<i{size}").reshape(len(i), width), np.frombuffer(places, np.float64).reshape(len(i), -1)


def tiles(queries: int, candidates: int, parallel: int) -> tuple[int, int]:
    """Partitions of both sides: tiles of TILE x TILE blocks, smaller while there are fewer of them than tasks that can run."""
    side = TILE
    while side > 1 and -(-queries // side) * -(-candidates // side) < 2 * parallel:
        side //= 2
    return max(1, -(-queries // side)), max(1, -(-candidates // side))


def top_k(vectors: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", queries: Column | None = None, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score for each row that ``queries`` selects (by default ids divisible by 20) against all rows."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(integer_key(vectors, key).alias("key"), v.alias("v")).where(F.col("key").isNotNull() & usable(F.col("v")))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()]
    sample = [x for x in sample if len(x) == len(sample[0]) and not large(np.array([x], np.float64))[0]]
    table = Table(choose_pivots(whole(sample), pivots) if sample else np.zeros((0, 0), np.int64))
    chosen = F.col("key") % 20 == 0 if queries is None else queries
    wanted = rows.where(chosen)
    asked = scratch.keep(pack(wanted.repartition(max(1, wanted.count() // (4 * QUERY_BLOCK))), table, QUERY_BLOCK), "queries")
    held = scratch.keep(pack(rows, table, BLOCK), "candidates")
    left = asked.select(*(F.col(c).alias(f"q_{c}") for c in asked.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, Best] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["q_width"] != r["width"]:
                    continue
                if r["q_block"] not in best:
                    if len(best) >= 32:
                        yield from (x.rows(q) for q, x in best.items())
                        best.clear()
                    best[r["q_block"]] = Best(*unpack(r["q_ids"], r["q_vectors"], r["q_places"], r["q_width"], r["q_size"]), k)
                best[r["q_block"]].meet(*unpack(r["ids"], r["vectors"], r["places"], r["width"], r["size"]))
        yield from (x.rows(q) for q, x in best.items())

    # blocks meet, not rows: queries x candidates / (QUERY_BLOCK * BLOCK) pairs
    across, down = tiles(asked.count(), held.count(), spark.sparkContext.defaultParallelism)
    pairs = left.repartition(across).crossJoin(held.repartition(down))
    hits = pairs.mapInArrow(run, HITS)
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
