"""Stupid-backoff language-model scores, computed relationally.

n-grams of all orders up to ``order`` are counted over all documents. The count
tables are partitioned by n-gram hash; the exploded n-grams of the documents
are joined to them bucket by bucket, and log scores are summed per document.

Layout: n-grams travel packed. A task explodes its documents in chunks of some
CHUNK tokens; of each chunk and hash bucket one row holds the distinct hashes
(sorted, as compressed differences) with their numbers. A bucket's group adds
these up to its part of the count table and answers each chunk with the counts
of what it asked for. A chunk's group looks its positions up and sums. A chunk
and a bucket have fixed sizes; the number of both grows with the input. A very
frequent n-gram is one entry of each chunk, so no key is hot.

S(w | u v) = c(uvw) / c(uv) if c(uvw) >= min_count, else alpha * S(w | v);
S(w) = c(w) / N. Words are runs of non-space bytes with A-Z lower-cased.
Counts include the document's own, which is why min_count is 2.

Null and empty texts have no words, log10 0 and a null score. Rows are scored
one by one, repeated rows and null keys included. Other columns are not
carried. An empty table gives an empty result. Input that is
not read from files as it is, and so may come in another order to a repeated
task, is kept first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plinth.llm.batches import slices, through
from plinth.llm.keys import integer_key
from plinth.llm.scratch import Scratch, steady
from plinth.llm.words import Vocabulary, ngram_hashes, words_of

CHUNK = 4_000_000
#: Bytes of text to a bucket: few, while the chunks' rows stay large; beyond MANY buckets, what a task can hold.
BUCKET_BYTES, MANY, LARGE_BUCKET = 4 << 20, 1 << 16, 64 << 20
PACKED = "group long, chunk string, part int, hashes binary, counts binary, sequence binary"
SCORED = "key long, n_words long, log10_prob double"


def squeeze(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    x = np.ascontiguousarray(x)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def expand(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def differences(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


class Grams:
    """Distinct n-grams of one order in a chunk, with their numbers or with, for each position, which of them ends there (-1: none)."""

    def __init__(self, hashes: np.ndarray, place: np.ndarray, n: int, positions: bool = False):
        there = place >= n - 1
        ending = ngram_hashes(hashes, n)[there]
        if positions:
            self.distinct, inverse = np.unique(ending, return_inverse=True)
            self.at = np.full(len(hashes), -1, np.int32)
            self.at[there] = inverse
        else:
            self.distinct, self.counts = np.unique(ending, return_counts=True)


def places(sizes: np.ndarray) -> np.ndarray:
    """Position of each token in its document."""
    starts = np.cumsum(sizes) - sizes
    return (np.arange(int(sizes.sum())) - np.repeat(starts, sizes)).astype(np.int32)


def bucket_count(size: int) -> int:
    """Buckets of each order for so many bytes of text. Their number has no ceiling, so what a task gets has one."""
    return max(min(MANY, size // 2 // BUCKET_BYTES), size // LARGE_BUCKET) + 1


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 3, alpha: float = 0.4, min_count: int = 2, chunk: int = CHUNK) -> DataFrame:
    """key, n_words, log10_prob (sum over the words), score (its mean)."""
    rows = steady(docs.select(integer_key(docs, key).alias("key"), F.col(f"`{text}`").alias("text")), Scratch(docs.sparkSession, "lmscore"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(4, bucket_count(size).bit_length())

    def explode(batches: Iterator[pa.RecordBatch], sequences: bool) -> Iterator[pa.RecordBatch]:
        """The chunks' sequences, or their requests."""
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        vocabulary = Vocabulary()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, parts, vocabulary
            tokens = np.concatenate(parts)
            sizes, known = np.fromiter(map(len, parts), np.int64, len(parts)), vocabulary.hashes()
            packed = pack(keys, sizes, known, tokens)
            # named by content: chunks that only one of the two passes makes fail the look-up
            name = hashlib.blake2b(packed, digest_size=16).hexdigest()
            keys, parts, vocabulary = [], [], Vocabulary()
            if sequences:
                yield rows_of([(0, name, -1, None, None, packed)])
                return
            del packed
            # order 0: the empty n-gram, whose count is the number of all tokens
            yield rows_of([(0, name, 0, squeeze(np.zeros(1, np.uint64)), squeeze(np.array([len(tokens)], np.uint64)), None)])
            place, hashes = places(sizes), known[tokens]
            for n in range(1, order + 1):
                g = Grams(hashes, place, n)
                borders = np.searchsorted(g.distinct, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist()
                out = []
                for b, (i, j) in enumerate(zip(borders, [*borders[1:], len(g.distinct)], strict=True)):
                    if j > i:
                        out.append(((n << bits) + b, name, (n << bits) + b, squeeze(differences(g.distinct[i:j])), squeeze(g.counts[i:j].astype(np.uint64)), None))
                for i in range(0, len(out), 256):
                    yield rows_of(out[i : i + 256])

        held = 0
        for b in slices(batches):
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                keys.append(k)
                parts.append(vocabulary.number(words_of(t)))
                held += len(parts[-1]) + 1
                if held >= chunk:
                    yield from flush()
                    held = 0
        if keys:
            yield from flush()

    def join(table: pa.Table) -> pa.Table:
        """A bucket's part of the count table, answered to each chunk."""
        asked = [np.cumsum(expand(h.as_py(), np.uint64), dtype=np.uint64) for h in table.column("hashes")]
        counts = np.concatenate([expand(c.as_py(), np.uint64) for c in table.column("counts")])
        _, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(inverse, weights=counts.astype(np.float64)).astype(np.uint64)
        answers, at = [], 0
        for a in asked:
            answers.append(squeeze(total[inverse[at : at + len(a)]]))
            at += len(a)
        none = pa.nulls(len(table), pa.binary())
        return pa.table([table.column("group"), table.column("chunk"), table.column("part"), none, pa.array(answers, pa.binary()), none], names=NAMES)

    def look_up(table: pa.Table) -> pa.Table:
        """The scores of a chunk's documents."""
        answers: dict[int, bytes] = {}
        sequences = []
        for part, c, s in zip(*(table.column(n).to_pylist() for n in ("part", "counts", "sequence")), strict=True):
            if part < 0:
                sequences.append(s)
            else:
                answers[part] = c
        if not sequences or not answers:
            raise RuntimeError("the documents came in another order when they were read again")
        count = {n: np.concatenate([expand(answers[p], np.uint64) for p in sorted(answers) if p >> bits == n]) for n in {p >> bits for p in answers}}
        return pa.concat_tables(scores(s, count) for s in sequences)  # more than one only where whole chunks repeat

    def scores(sequence: bytes, count: dict[int, np.ndarray]) -> pa.Table:
        keys, sizes, known, tokens = unpack(sequence)
        place, hashes = places(sizes), known[tokens]
        score = np.zeros(len(tokens))
        context = np.full(len(tokens), float(count[0][0]))
        for n in range(1, order + 1):
            g = Grams(hashes, place, n, positions=True)
            found = np.zeros(len(tokens))
            there = g.at >= 0
            if there.any():
                found[there] = count[n][g.at[there]]
            better = found >= (1 if n == 1 else min_count)
            score = np.where(better, np.log10(np.where(better, found / context, 1.0)), score + np.log10(alpha))
            if n > 1:  # a document's start has no such context and is not penalised for it
                score = np.where(there, score, before)
            before = score
            # the n-gram that ends one position earlier is the context of the next order
            context = np.where(place >= n, np.roll(found, 1), 1.0)
            context[context < 1] = 1.0
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.bincount(owner, weights=score, minlength=len(sizes))
        return pa.table([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums)], names=["key", "n_words", "log10_prob"])

    asked = through(rows, lambda batches: explode(batches, False), PACKED)
    answered = asked.groupBy("group").applyInArrow(join, PACKED)
    # sequences are made anew, which costs a second reading and spares them the way through the buckets
    held = through(rows, lambda batches: explode(batches, True), PACKED)
    scored = answered.unionByName(held).groupBy("chunk").applyInArrow(look_up, SCORED)
    return scored.select(F.col("key").alias(key), "n_words", "log10_prob", F.when(F.col("n_words") > 0, F.col("log10_prob") / F.col("n_words")).alias("score"))


NAMES = ["group", "chunk", "part", "hashes", "counts", "sequence"]
PACKED_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PACKED_TYPES, strict=True)], names=NAMES)


def pack(keys: list[int | None], sizes: np.ndarray, known: np.ndarray, tokens: np.ndarray) -> bytes:
    missing = np.array([k is None for k in keys], np.uint8)
    pieces = [squeeze(np.array([k or 0 for k in keys], np.int64)), squeeze(missing), squeeze(sizes), squeeze(known), squeeze(tokens)]
    return b"".join(len(p).to_bytes(8, "little") + p for p in pieces)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
    pieces, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        pieces.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    keys, missing, sizes, known, tokens = (expand(p, k) for p, k in zip(pieces, (np.int64, np.uint8, np.int64, np.uint64, np.int32), strict=True))
    return [None if m else k for k, m in zip(keys.tolist(), missing.tolist(), strict=True)], sizes, known, tokens
