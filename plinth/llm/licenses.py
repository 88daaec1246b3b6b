"""License scan: one Aho-Corasick pass finds notice phrases and identifier tags; a shunting-yard parser evaluates tagged expressions.

Texts are lower-cased in A-Z only; words are runs of ASCII letters and digits
and of all non-ASCII characters. A phrase counts wherever its words stand
consecutively. An ``SPDX-License-Identifier:`` tag is followed by an expression
of identifiers with AND, OR, WITH and parentheses, which is parsed to postfix
form and evaluated against a set of accepted licenses. It ends with its line or
where the next tag begins.

Null texts count as empty: no words, no labels, score 0. Rows are judged one
by one, so ties, repeats and other columns play no part; only ``key`` and the
text are read and the other input columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plinth.llm.batches import slices, through

# Phrase and label
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

TAG = "spdx license identifier"
ACCEPTED = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "cc-by-3.0", "bsl-1.0", "unlicense", "0bsd", "zlib"})

PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+(?::[A-Za-z0-9.+-]+)?")
TAG_LINE = re.compile(r"spdx-license-identifier\s*:[ \t]*((?:(?!spdx-license-identifier\s*:)[^\r\n])*)", re.IGNORECASE | re.ASCII)

#: Bytes that separate words become spaces, A-Z become a-z, all else stays.
FOLD = bytes((c | 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Expression:
    """A tagged expression: identifiers, exceptions, and whether accepted licenses satisfy it (None: not well formed)."""

    text: str
    identifiers: tuple[str, ...] = ()
    exceptions: tuple[str, ...] = ()
    accepted: bool | None = None


def postfix(text: str) -> list[str] | None:
    """Shunting-yard: operands in order, operators after their operands; None unless the expression is complete.

    The longest well-formed prefix counts, so that a comment's end after an
    expression does no harm.
    """
    out: list[str] = []
    stack: list[str] = []
    want_operand, depth, best = True, 0, None
    for token in TOKEN.findall(text):
        word = token.lower()
        if want_operand and (word == "(" or word not in PRECEDENCE and word != ")"):
            if word == "(":
                stack.append(word)
                depth += 1
            else:
                out.append(word)
                want_operand = False
        elif not want_operand and word in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            want_operand = True
        elif not want_operand and word == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            break
        if not want_operand and not depth:
            best = out + stack[::-1]
    return best


def evaluate(text: str, accepted: frozenset[str] = ACCEPTED) -> Expression:
    """OR needs one side, AND both; WITH keeps its license's verdict, as an exception only adds permissions."""
    steps = postfix(text)
    if not steps:
        return Expression(text)
    stack: list[tuple[bool, str | None]] = []
    names: list[str] = []
    exceptions: list[str] = []
    for s in steps:
        if s not in PRECEDENCE:
            names.append(s)
            stack.append((s in accepted, s))
            continue
        (right, exception), (left, name) = stack.pop(), stack.pop()
        if s == "with":
            if exception is None or name is None:
                return Expression(text)
            names.remove(exception)
            exceptions.append(exception)
            stack.append((left, None))
        else:
            stack.append((left and right if s == "and" else left or right, None))
    return Expression(text, tuple(dict.fromkeys(names)), tuple(dict.fromkeys(exceptions)), stack[0][0])


class Scanner:
    def __init__(self, base: dict[str, str] = BASE, more: dict[str, str] = MORE, accepted: frozenset[str] = ACCEPTED):
        self.accepted, self.base_labels = accepted, set(base.values())
        self.automaton = ahocorasick.Automaton()
        phrases = {p: (p in base, base.get(p) or more.get(p)) for p in [*more, *base]} | {TAG: (False, None)}
        for phrase, (is_base, label) in phrases.items():
            spelled = f" {phrase} ".encode().decode("latin-1")
            self.automaton.add_word(spelled, (len(spelled), is_base, label))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, labels, score, spans of words, expressions."""
        raw = (text or "").encode("utf-8", "replace")
        words = raw.translate(FOLD).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0, [], []
        line = f" {b' '.join(words).decode('latin-1')} "
        base_at, base_labels, labels, spans, tagged = [], set(), set(), [], False
        at = word = 0
        found = sorted((end - size + 1, size, is_base, label) for end, (size, is_base, label) in self.automaton.iter(line))
        for start, size, is_base, label in found:
            word += line.count(" ", at, start)
            at = start
            if label is None:
                tagged = True
                continue
            labels.add(label)
            spans.append((word, word + line.count(" ", start + 1, start + size), label))
            if is_base:
                base_at.append(word)
                base_labels.add(label)
        expressions = [evaluate(m, self.accepted) for m in TAG_LINE.findall(text)] if tagged else []
        for e in expressions:
            labels.update(e.identifiers)
        marks = len(spans) + 2 * sum(e.accepted is not None for e in expressions)
        first, last = (min(base_at), max(base_at)) if base_at else (None, None)
        return len(words), len(base_at), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 - 0.5**marks, spans, expressions


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("label", T.StringType())]))),
        T.StructField("expressions", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("identifiers", T.ArrayType(T.StringType())), T.StructField("exceptions", T.ArrayType(T.StringType())), T.StructField("accepted", T.BooleanType())]))),
    ]
)
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))
EXPRESSIONS = pa.list_(pa.struct([("text", pa.string()), ("identifiers", pa.list_(pa.string())), ("exceptions", pa.list_(pa.string())), ("accepted", pa.bool_())]))
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, more: dict[str, str] = MORE, accepted: frozenset[str] = ACCEPTED) -> DataFrame:
    """One row per input row: key and what the scan found. No shuffle; a task holds one Arrow batch."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *FOUND.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, more, accepted)
        for b in slices(batches):
            found = list(zip(*(scanner.scan(t) for t in b.column("text").to_pylist()), strict=True)) if b.num_rows else [[]] * 9
            spans = pa.array([[{"start": s, "stop": e, "label": n} for s, e, n in x] for x in found[7]], SPANS)
            expressions = pa.array([[{"text": e.text, "identifiers": list(e.identifiers), "exceptions": list(e.exceptions), "accepted": e.accepted} for e in x] for x in found[8]], EXPRESSIONS)
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, t) for c, t in zip(found[:7], TYPES, strict=True)), spans, expressions], names=schema.names)

    return through(rows, run, schema).withColumnRenamed("key", key)
