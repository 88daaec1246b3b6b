"""Syntax tree to DataFrame plan.

WHERE always filters before grouping and joining; Catalyst pushes it to the
scan. NULLs sort first in both directions, SUM is a DOUBLE that is 0.0 for an
all-NULL group, a bare column in a grouped query is its MAX, and join keys
match null-safely within one type family.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plinth.config import EngineConfig
from plinth.dialect.nodes import Aggregate, Comparison, JoinQuery, Literal, Name, Select
from plinth.errors import PlanError
from plinth.operators import aggregates, joins, sorting
from plinth.types import family

COMPARE = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


class Translator:
    def __init__(self, table: Callable[[str], DataFrame], config: EngineConfig | None = None):
        self.table, self.config = table, config or EngineConfig()

    def plan(self, query: Select | JoinQuery) -> DataFrame:
        if isinstance(query, JoinQuery):
            return joins.hash_join(self.plan(query.left), self.plan(query.right), query.left_key, query.right_key, strategy=self.config.join_strategy)
        return self._select(query)

    def _column(self, df: DataFrame, name: str) -> Column:
        if name not in df.columns:
            raise PlanError(f"no column {name!r}; there are {', '.join(df.columns)}")
        return df[f"`{name}`"]

    def _operand(self, df: DataFrame, x: Name | Literal | Aggregate) -> tuple[Column, str]:
        if isinstance(x, Literal):
            return F.lit(x.value), "string" if isinstance(x.value, str) else "number"
        name = x.default_name if isinstance(x, Aggregate) else x.text
        return self._column(df, name), family(df.schema[name].dataType)

    def _predicate(self, df: DataFrame, parts: tuple[Comparison, ...]) -> Column:
        out = []
        for p in parts:
            (left, lf), (right, rf) = self._operand(df, p.left), self._operand(df, p.right)
            if lf != rf:
                raise PlanError(f"cannot compare {lf} with {rf}")
            out.append(COMPARE[p.op](left, right))
        return functools.reduce(operator.and_, out)

    def _select(self, q: Select) -> DataFrame:
        df = self.table(q.table)
        for j in q.joins:
            df = joins.hash_join(df, self.table(j.table), *self._sides(df, j), strategy=self.config.join_strategy, merge_names=True)
        if q.where:
            df = df.where(self._predicate(df, q.where))
        stars = [i for i in q.items if isinstance(i.expr, Name) and i.expr.text == "*"]
        grouped = bool(q.group_by) or any(isinstance(i.expr, Aggregate) for i in q.items) or bool(q.having)
        if grouped and stars:
            raise PlanError("* cannot be grouped")
        if grouped:
            df, shown = self._grouped(df, q)
        else:
            shown = []
            for i in q.items:
                shown += [(c, c) for c in df.columns] if i in stars else [(i.expr.text, i.alias or i.expr.text)]
            for name, _ in shown:
                self._column(df, name)
        return self._finish(df, q, shown)

    def _sides(self, df: DataFrame, j) -> tuple[str, str]:
        """ON may name the keys in either order."""
        right = self.table(j.table).columns
        if j.left_key in df.columns and j.right_key in right:
            return j.left_key, j.right_key
        if j.right_key in df.columns and j.left_key in right:
            return j.right_key, j.left_key
        raise PlanError(f"no join keys {j.left_key!r}, {j.right_key!r}")

    def _grouped(self, df: DataFrame, q: Select) -> tuple[DataFrame, list[tuple[str, str]]]:
        made: dict[str, Column] = {}
        shown: list[tuple[str, str]] = []
        for i in q.items:
            if isinstance(i.expr, Aggregate):
                name = i.alias or i.expr.default_name
                made[name] = self._aggregate(df, i.expr)
                shown.append((name, name))
            elif i.expr.text in q.group_by:
                shown.append((i.expr.text, i.alias or i.expr.text))
            else:
                name = i.alias or i.expr.text
                made[name] = F.max(self._column(df, i.expr.text))
                shown.append((name, name))
        for p in q.having:
            for x in (p.left, p.right):
                if isinstance(x, Aggregate):
                    made.setdefault(x.default_name, self._aggregate(df, x))
        for k in q.group_by:
            self._column(df, k)
        out = aggregates.group(df, list(q.group_by), made)
        if q.having:
            out = out.where(self._predicate(out, q.having))
        return out, shown

    def _aggregate(self, df: DataFrame, a: Aggregate) -> Column:
        if a.arg == "*":
            return aggregates.over_star(a.fn)
        self._column(df, a.arg)
        return aggregates.build(a.fn, a.arg, df.schema[a.arg].dataType, count_includes_nulls=self.config.count_includes_nulls)

    def _finish(self, df: DataFrame, q: Select, shown: list[tuple[str, str]]) -> DataFrame:
        if q.order_by:
            by_alias = {alias: name for name, alias in shown}
            keys = []
            for k in q.order_by:
                name = k.column if k.column in df.columns else by_alias.get(k.column, k.column)
                self._column(df, name)
                text = isinstance(df.schema[name].dataType, T.StringType)
                keys.append((name, k.descending and not (text and self.config.compat_string_desc)))
            df = sorting.order(df, keys)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*(F.col(f"`{n}`").alias(a) for n, a in shown))
