"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Name:
    text: str


@dataclass(frozen=True)
class Literal:
    value: int | float | str


@dataclass(frozen=True)
class Aggregate:
    fn: str
    arg: str  # "*" or a column

    @property
    def default_name(self) -> str:
        return f"{self.fn}_{self.arg}"


@dataclass(frozen=True)
class Comparison:
    op: str
    left: Name | Literal | Aggregate
    right: Name | Literal | Aggregate


@dataclass(frozen=True)
class Item:
    expr: Name | Aggregate
    alias: str | None = None


@dataclass(frozen=True)
class OrderKey:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class JoinClause:
    table: str
    left_key: str
    right_key: str


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    table: str
    joins: tuple[JoinClause, ...] = ()
    where: tuple[Comparison, ...] = ()
    group_by: tuple[str, ...] = ()
    having: tuple[Comparison, ...] = ()
    order_by: tuple[OrderKey, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class JoinQuery:
    """Two complete selects joined on one key each."""

    left: Select
    right: Select
    left_key: str
    right_key: str
