"""SentencePiece models as weighted finite-state transducers.

A model file is compiled to three machines with explicit states and arcs:

* the normaliser, a sequential transducer over characters whose states are the
  start of a text, its body and, where runs of spaces are squeezed, a gap;
* the lexicon, a trie with an arc for each character and a piece at the states
  where one is complete (it reads right to left, so that what ends at a
  position is found from there);
* the byte fallback, which reads one character that is no piece and emits the
  pieces of its UTF-8 bytes.

An input is composed with the normaliser, and the result with the union of
lexicon and fallback; the encoding is the path of least weight in the tropical
semiring (weights add along a path, the least total wins).

Weights. In a unigram model an arc weighs minus its piece's score, the fallback
ten more than the worst piece. A BPE model has no additive scores; its encoding
is the one path on which every two neighbours are what BPE makes of their joint
text. So the lexicon is composed with a machine that has a state for each last
piece, and an arc of weight 0 to each piece that BPE leaves apart from it, of
infinity to any other. These arcs follow from the merge order, are made when
they are first asked for, and are remembered. In both kinds of model one state
for each position has a finite least weight to keep: a unigram model has one
state only, and of a BPE model exactly one piece ends the encoding of each
prefix. So the same search runs for both.

No piece holds a space mark after another character, so a text falls into
independent stretches (spaces or marks, then other characters), between which
the normaliser is in its body state; each distinct stretch is composed once and
remembered by its worker: two generations of MEMORY stretches, of which those
in use pass to the younger. Where workers share an executor with a heap that
earlier steps have filled, callers let them remember less.

Null texts encode to null ids; empty texts to none. Decoding inverts exactly
whatever the normaliser keeps. Rows are handled one by one; null keys and
repeated rows are rows like any other; other columns are not carried. Models
with a compiled character map, user-defined pieces or, in BPE, unused pieces
raise an error.
"""

from __future__ import annotations

import gc
import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plinth.llm.batches import BATCH_BYTES, bounded, slices, through

# Fixed values of the model format: field numbers and piece kinds
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2

MARK = "▁"
MEMORY = 200_000
#: Arcs between last pieces that a worker remembers at most.
ARCS = 300_000
INFINITY = math.inf


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
            at += n
        else:
            raise ValueError(f"wire type {kind} is not in use")


START, BODY, GAP = 0, 1, 2
#: Stands before a stretch that begins a text; no text holds it.
FIRST = "\ud800"


class Normaliser:
    """White-space rules and space marks. arcs: (state, is it a space) -> next state, what is written before the character, whether the character is copied."""

    def __init__(self, spec: dict[int, object]):
        if spec.get(2):
            raise ValueError("models with a compiled character map are not supported")
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.mark = mark = MARK if self.escape else " "
        begin = mark if self.prefix else ""
        self.arcs = {(START, False): (BODY, begin, True), (BODY, False): (BODY, "", True)}
        if self.squeeze:
            self.arcs |= {(START, True): (START, "", False), (BODY, True): (GAP, "", False), (GAP, True): (GAP, "", False), (GAP, False): (BODY, mark, True)}
        else:
            self.arcs |= {(START, True): (BODY, begin + mark, False), (BODY, True): (BODY, mark, False)}
        #: A body whose arcs all return to it writes each character as it is or by this map.
        self.map = None if self.squeeze else {32: mark}

    def compose(self, text: str, state: int = START) -> str:
        """What the machine writes as it reads a text from a state, which ends with the text or before a space. Where spaces are squeezed, marks at the end go too."""
        if state == BODY and self.map:
            return text.translate(self.map)
        out = []
        for c in text:
            state, before, copied = self.arcs[state, c == " "]
            out.append(before + c if copied else before)
        text = "".join(out)
        return text.rstrip(self.mark) if self.squeeze else text

    def keeps(self, text: str) -> bool:
        """Whether ``invert`` gives back what a text becomes: without squeezing, unless it holds marks of its own."""
        return self.invert(self.compose(text)) == text if self.squeeze else not self.escape or MARK not in text

    def invert(self, text: str) -> str:
        text = text.replace(MARK, " ") if self.escape else text
        return text[1:] if self.prefix and text.startswith(" ") else text


class Lexicon:
    """Trie of the pieces, read from their ends. A state is its arcs (character -> state) and the piece complete there, or -1."""

    def __init__(self, pieces: dict[str, int]):
        self.root: tuple[dict[str, tuple], int] = ({}, -1)
        self.states = 1
        for text, i in sorted(pieces.items(), key=lambda p: len(p[0])):  # a state is made before those beyond it
            arcs = self.root[0]
            for c in text[:0:-1]:
                if c not in arcs:
                    arcs[c] = ({}, -1)
                    self.states += 1
                arcs = arcs[c][0]
            self.states += text[0] not in arcs
            arcs[text[0]] = (arcs[text[0]][0] if text[0] in arcs else {}, i)


class Transducer:
    """The compiled model."""

    def __init__(self, model: bytes, memory: int = MEMORY, arcs: int = ARCS):
        self.memory, self.arcs = memory, arcs
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, object] = {}
        normaliser: dict[int, object] = {}
        for number, value in fields(model):
            if number == PIECE:
                p = dict(fields(value))
                self.pieces.append(p[1].decode())
                self.scores.append(p.get(2, 0.0))
                self.kinds.append(p.get(3, NORMAL))
            elif number == TRAINER:
                trainer = dict(fields(value))
            elif number == NORMALIZER:
                normaliser = dict(fields(value))
        self.bpe = trainer.get(3, UNIGRAM) == BPE
        if USER in self.kinds or self.bpe and UNUSED in self.kinds:
            raise ValueError("user-defined pieces, and unused ones in a BPE model, are not supported")
        self.normaliser = Normaliser(normaliser)
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.known = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.split = self.normaliser.escape and not any(MARK in p.lstrip(MARK) for p in self.known)
        spell = {BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: " ⁇ ".encode(), CONTROL: lambda p: b""}
        self.spelled = [spell.get(k, str.encode)(p) for p, k in zip(self.pieces, self.kinds, strict=True)]
        self._made: dict[str, tuple[str, str] | None] = {}
        self._apart: dict[int, float] = {}
        #: Ids of a stretch as 32-bit integers, the younger and the older generation; stretches that do not decode to their normal form.
        self._memory: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._lossy: set[str] = set()
        if self.bpe:  # only pieces that merges can make are ever emitted
            self.lexicon = Lexicon({p: i for p, i in self.known.items() if len(p) == 1 or self.halves(p)})
            if any(max(map(self.rank, h)) > self.rank(p) for p, h in self._made.items() if h):
                raise ValueError("a piece of this BPE model is merged before its parts are")
            self.weights, self.fallback = [0.0] * len(self.pieces), 0.0
        else:
            self.lexicon = Lexicon(self.known)
            self.weights = [-s for s in self.scores]
            self.fallback = 10.0 - min((self.scores[i] for i in self.known.values()), default=0.0)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_apart": {}, "_memory": {}, "_older": {}, "_lossy": set(), "_made": {}}

    # -- the machine of last pieces, for BPE models

    def rank(self, piece: str) -> float:
        """When a piece is merged: single characters are there from the start, then by falling score."""
        i = self.known.get(piece)
        return -INFINITY if len(piece) == 1 or i is None else -self.scores[i]

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one; None for single characters and for pieces no merge reaches."""
        if piece not in self._made:
            parts = self.merges(piece, stop=2)
            whole = len(parts) == 2 and self.merges(piece) == [piece]
            self._made[piece] = (parts[0], parts[1]) if whole else None
        return self._made[piece]

    def merges(self, text: str, stop: int = 1) -> list[str]:
        """BPE by its rules: of all neighbours the best-scored joint piece merges first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > stop:
            best, at = -INFINITY, -1
            for i in range(len(parts) - 1):
                joint = self.known.get(parts[i] + parts[i + 1])
                if joint is not None and self.scores[joint] > best:
                    best, at = self.scores[joint], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Undoes the merges on both sides of the border, latest first, and sees whether one across it would have come earlier."""
        limit, strict = INFINITY, True
        while True:
            across = self.known.get(left + right)
            if across is not None:
                r = -self.scores[across]
                if r < limit or r == limit and not strict:
                    return False
            lr, rr = self.rank(left), self.rank(right)
            if lr == rr == -INFINITY:
                return True
            if lr > rr:  # among equals the leftmost merges first: the left piece, when it is made at the same rank
                limit, strict, left = lr, True, self.halves(left)[1]
            else:
                limit, strict, right = rr, False, self.halves(right)[0]

    def name(self, arc: int) -> str:
        """What an arc reads: a piece, or by the fallback a character (negative numbers)."""
        return self.pieces[arc] if arc >= 0 else chr(~arc)

    def between(self, left: int, right: int) -> float:
        """Weight of the arc from one last piece to the next: 0 or infinity."""
        key = left << 24 | right + 2097152  # both fit: characters are over -2**21, pieces under 2**24 - 2**21
        found = self._apart.get(key)
        if found is None:
            if len(self._apart) >= self.arcs:
                self._apart.clear()
            found = self._apart[key] = 0.0 if self.apart(self.name(left), self.name(right)) else INFINITY
        return found

    # -- composition and shortest path

    def path(self, text: str, least: list[float] | None = None, last: list[int] | None = None) -> list[int]:
        """The least-weight path of a normalised text through lexicon and fallback, as piece ids.

        ``least`` and ``last`` have the weights and the last arcs of prefixes
        that are already composed, and get those of the others.
        """
        least, last = ([0.0], [0]) if least is None else (least, last)
        root, weights, between, known = self.lexicon.root[0], self.weights, self.between, self._apart.get
        bpe, bound = self.bpe, 0.0 if self.bpe else -INFINITY  # no BPE path weighs less than 0
        for end in range(len(least), len(text) + 1):
            best, arc, arcs, at = INFINITY, 0, root, end
            while at:
                at -= 1
                state = arcs.get(text[at])
                if state is None:
                    break
                arcs, p = state
                if p < 0:
                    continue
                w = least[at] + weights[p]
                if bpe and at:
                    gap = known(last[at] << 24 | p + 2097152)
                    w += between(last[at], p) if gap is None else gap
                    if w == INFINITY:
                        continue
                if w <= best:  # of equal paths the one whose last piece is longer
                    best, arc = w, p
                    if w <= bound:
                        break
            if best > bound and (text[end - 1] not in root or root[text[end - 1]][1] < 0):  # no piece reads this character alone
                c, w = ~ord(text[end - 1]), least[end - 1] + self.fallback
                if bpe and end > 1:
                    w += between(last[end - 1], c)
                if w < best:
                    best, arc = w, c
            if best == INFINITY:
                raise ValueError(f"no path through {text!r}")
            least.append(best)
            last.append(arc)
        found, at = [], len(text)
        while at:
            found.append(last[at])
            at -= 1 if last[at] < 0 else len(self.pieces[last[at]])
        out: list[int] = []
        for arc in reversed(found):
            if arc >= 0:
                out.append(arc)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(~arc).encode("utf-8", "replace")]
            elif out[-1:] != [self.unknown]:  # unknown neighbours are one
                out.append(self.unknown)
        return out

    STRETCH = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")

    def stretches(self, text: str) -> list[str]:
        """The stretches of a text as it is, the first one marked."""
        if not text:
            return []
        found = self.STRETCH.findall(text) if self.split else [text]
        found[0] = FIRST + found[0]
        return found

    def normal(self, stretch: str) -> str:
        return self.normaliser.compose(stretch[1:], START) if stretch[:1] == FIRST else self.normaliser.compose(stretch, BODY)

    def compose(self, stretches: set[str]) -> dict[str, bytes]:
        """The ids of each stretch. Those not remembered are composed in sorted order: what neighbours begin with in common is composed once."""
        memory, older = self._memory, self._older
        out, new = {}, []
        for s in stretches:
            found = memory.get(s)
            if found is None:
                found = older.get(s)
                if found is None:
                    new.append(s)
                    continue
                memory[s] = found
            out[s] = found
        before, least, last, spelled = "", [0.0], [0], self.spelled
        for s in sorted(new):
            text = self.normal(s)
            same, most = 0, min(len(before), len(text))
            while same < most and before[same] == text[same]:
                same += 1
            del least[same + 1 :], last[same + 1 :]
            ids = self.path(text, least, last)
            out[s] = memory[s] = array("i", ids).tobytes()
            if b"".join([spelled[i] for i in ids]) != text.encode("utf-8", "replace"):
                self._lossy.add(s)
            before = text
        if len(memory) >= self.memory:
            self._older, self._memory = memory, {}
            self._lossy &= memory.keys()
        return out

    def encode(self, text: str) -> list[int]:
        found = self.stretches(text)
        ids = self.compose(set(found))
        return np.frombuffer(b"".join([ids[s] for s in found]), "<i4").tolist()

    def returns(self, text: str, stretches: list[str]) -> bool:
        """Whether decoding gives the text back: every stretch decodes to its normal form, and the normaliser can be inverted on the text. The stretches have just been composed."""
        return self._lossy.isdisjoint(stretches) and self.normaliser.keeps(text)

    def decode(self, ids: list[int]) -> str:
        return self.normaliser.invert(b"".join([self.spelled[i] for i in ids]).decode("utf-8", "replace"))


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The model file, which is a parameter: read where the driver runs, else by Spark."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", verify: bool = True, keep_ids: bool = True, memory: int = MEMORY, arcs: int = ARCS, most: int = BATCH_BYTES) -> DataFrame:
    """key, n_pieces, n_bytes (pieces of the fallback), ids_crc (of the ids as little-endian 32-bit integers), round_trip, ids.

    ``round_trip`` says whether decoding gives the text back. The model goes to
    executors with the job: a few MB, whatever the data. A worker remembers two
    generations of ``memory`` stretches and ``arcs`` arcs, and takes texts of
    ``most`` bytes at once; results don't depend on these.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kinds = [("n_pieces", T.LongType(), pa.int64()), ("n_bytes", T.LongType(), pa.int64()), ("ids_crc", T.LongType(), pa.int64()), ("round_trip", T.BooleanType(), pa.bool_())]
    if keep_ids:
        kinds.append(("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *(T.StructField(n, t) for n, t, _ in kinds)])
    # a worker keeps the value of a broadcast from task to task, and with it what it has composed
    model = docs.sparkSession.sparkContext.broadcast(Transducer(model_bytes(docs.sparkSession, model_path), memory, arcs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        gc.disable()  # nothing here makes cycles, and its passes over the remembered stretches would cost much
        try:
            for b in bounded(batches, 1, most, rows=500):
                yield one(machine, b)
        finally:
            gc.enable()

    def one(machine: Transducer, b: pa.RecordBatch) -> pa.RecordBatch:
        fallback = np.array([k == BYTE for k in machine.kinds])
        texts = b.column("text").to_pylist()
        found = [None if t is None else machine.stretches(t) for t in texts]
        get = machine.compose(set().union(*[f for f in found if f])).__getitem__
        made, packed = [], []
        for t, f in zip(texts, found, strict=True):
            data = b"".join(map(get, f)) if f else b""
            ids = np.frombuffer(data, "<i4")
            packed.append(data)
            made.append((len(ids), int(fallback[ids].sum()), zlib.crc32(data), None if t is None or not verify else machine.returns(t, f), t is None))
        columns = [pa.array(c, k[2]) for c, k in zip(zip(*made, strict=True) if made else [[]] * 4, kinds[:4], strict=False)]
        if keep_ids:
            ends = pa.array(np.cumsum([0, *(m[0] for m in made)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), "<i4")))
            columns.append(pc.if_else(pa.array([m[4] for m in made], pa.bool_()), pa.scalar(None, lists.type), lists))
        return pa.RecordBatch.from_arrays([b.column("key"), *columns], names=schema.names)

    return through(rows, run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text; null ids give a null text."""
    model = encoded.sparkSession.sparkContext.broadcast(Transducer(model_bytes(encoded.sparkSession, model_path)))
    rows = encoded.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.value
        for b in slices(batches):
            texts = [None if x is None else machine.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string())], names=schema.names)

    return through(rows, run, schema).withColumnRenamed("key", key)
