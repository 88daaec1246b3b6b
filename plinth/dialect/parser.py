"""Tokens and recursive-descent parser of the dialect.

Keywords are whole words in any case; text that is no token, and anything
after the end of the query, is an error.
"""

from __future__ import annotations

import re

from plinth.dialect.nodes import Aggregate, Comparison, Item, JoinClause, JoinQuery, Literal, Name, OrderKey, Select
from plinth.errors import ParseError

AGGREGATES = ("count", "sum", "avg", "min", "max")
KEYWORDS = {"select", "from", "where", "group", "by", "having", "order", "limit", "inner", "join", "on", "and", "as", "asc", "desc"}
TOKEN = re.compile(r"""\s*(?:(?P<text>'[^']*'|"[^"]*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<word>[A-Za-z_][A-Za-z_0-9]*)|(?P<op><>|!=|<=|>=|[=<>])|(?P<mark>[(),*]))""")
OPERATORS = {"!=": "<>"}


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected input at {at}: {text[at : at + 20]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "word" and value.lower() in KEYWORDS:
            kind, value = "key", value.lower()
        out.append((kind, value))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def take(self, *want: str) -> bool:
        """Consume these keywords or marks if they all come next."""
        if all(self.peek(i)[0] in ("key", "mark", "op") and self.peek(i)[1] == w for i, w in enumerate(want)):
            self.at += len(want)
            return True
        return False

    def expect(self, *want: str) -> None:
        if not self.take(*want):
            raise ParseError(f"expected {' '.join(want).upper()}, found {self.peek()[1] or 'the end'!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "word":
            raise ParseError(f"expected a name, found {value or 'the end'!r}")
        self.at += 1
        return value

    def listed(self, one) -> tuple:
        out = [one()]
        while self.take(","):
            out.append(one())
        return tuple(out)

    def aggregate(self) -> Aggregate | None:
        kind, value = self.peek()
        if kind == "word" and value.lower() in AGGREGATES and self.peek(1) == ("mark", "("):
            self.at += 2
            arg = "*" if self.take("*") else self.name()
            self.expect(")")
            return Aggregate(value.lower(), arg)
        return None

    def item(self) -> Item:
        if self.take("*"):
            return Item(Name("*"))
        expr = self.aggregate() or Name(self.name())
        return Item(expr, self.name() if self.take("as") else None)

    def operand(self, aggregates: bool) -> Name | Literal | Aggregate:
        if aggregates and (found := self.aggregate()):
            return found
        kind, value = self.peek()
        if kind == "text":
            self.at += 1
            return Literal(value[1:-1])
        if kind == "number":
            self.at += 1
            return Literal(float(value) if "." in value else int(value))
        return Name(self.name())

    def conjunction(self, aggregates: bool = False) -> tuple[Comparison, ...]:
        out = []
        while not out or self.take("and"):
            left = self.operand(aggregates)
            kind, op = self.peek()
            if kind != "op":
                raise ParseError(f"expected a comparison, found {op or 'the end'!r}")
            self.at += 1
            out.append(Comparison(OPERATORS.get(op, op), left, self.operand(aggregates)))
        return tuple(out)

    def key(self) -> OrderKey:
        column = self.name()
        return OrderKey(column, self.take("desc") or (self.take("asc") and False))

    def limit(self) -> int:
        kind, value = self.peek()
        if kind != "number" or not value.isdigit():
            raise ParseError(f"LIMIT needs a non-negative integer, found {value!r}")
        self.at += 1
        return int(value)

    def join(self) -> JoinClause | None:
        start = self.at
        self.take("inner")
        if not self.take("join"):
            self.at = start
            return None
        table = self.name()
        self.expect("on")
        left = self.name()
        self.expect("=")
        return JoinClause(table, left, self.name())

    def select(self) -> Select:
        self.expect("select")
        items = self.listed(self.item)
        self.expect("from")
        table, joins = self.name(), []
        while (start := self.at) is not None and (found := self.join()):
            if self.peek() == ("key", "select"):  # the form that joins two whole selects
                self.at = start
                break
            joins.append(found)
        return Select(
            items,
            table,
            tuple(joins),
            self.conjunction() if self.take("where") else (),
            self.listed(self.name) if self.take("group", "by") else (),
            self.conjunction(aggregates=True) if self.take("having") else (),
            self.listed(self.key) if self.take("order", "by") else (),
            self.limit() if self.take("limit") else None,
        )

    def query(self) -> Select | JoinQuery:
        out: Select | JoinQuery = self.select()
        if found := self.join():
            out = JoinQuery(out, self.select(), found.left_key, found.right_key)
        if self.peek()[0] != "end":
            raise ParseError(f"unexpected {self.peek()[1]!r} after the query")
        return out


def parse(text: str) -> Select | JoinQuery:
    return _Parser(text).query()
