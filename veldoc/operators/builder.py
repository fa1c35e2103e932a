"""A fluent builder of filters and find options."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from veldoc.operators.find import find

#: Operators of the builder and of filters.
OPERATORS = {"eq": "$eq", "=": "$eq", "ne": "$ne", "!=": "$ne", "gt": "$gt", ">": "$gt", "gte": "$gte", ">=": "$gte", "lt": "$lt", "<": "$lt", "lte": "$lte", "<=": "$lte", "in": "$in", "nin": "$nin", "regex": "$regex", "startsWith": "$startsWith", "endsWith": "$endsWith", "contains": "$contains", "exists": "$exists", "type": "$type", "all": "$all", "size": "$size", "elemMatch": "$elemMatch", "mod": "$mod"}


class Query:
    """`where`, `and_`: all must hold; `or_` begins an alternative; `not_` negates a condition. Each call returns a new query."""

    def __init__(self, df: DataFrame, groups: tuple = ((),), options: dict | None = None):
        self.df, self.groups, self.options = df, groups, options or {}

    def _with(self, condition: dict) -> Query:
        return Query(self.df, (*self.groups[:-1], (*self.groups[-1], condition)), self.options)

    def _set(self, **options: Any) -> Query:
        return Query(self.df, self.groups, self.options | options)

    def where(self, field: str, op: str, value: Any) -> Query:
        return self._with({field: {OPERATORS[op]: value}})

    and_ = where

    def or_(self, field: str, op: str, value: Any) -> Query:
        return Query(self.df, (*self.groups, ()), self.options).where(field, op, value)

    def not_(self, field: str, op: str, value: Any) -> Query:
        return self._with({field: {"$not": {OPERATORS[op]: value}}})

    def where_all(self, field: str, values: list) -> Query:
        return self.where(field, "all", values)

    def where_elem_match(self, field: str, spec: dict) -> Query:
        return self.where(field, "elemMatch", spec)

    def where_size(self, field: str, size: int) -> Query:
        return self.where(field, "size", size)

    def where_mod(self, field: str, divisor: int, rest: int) -> Query:
        return self.where(field, "mod", [divisor, rest])

    def order_by(self, field: str, direction: str = "asc") -> Query:
        return self._set(sort=self.options.get("sort", {}) | {field: -1 if direction == "desc" else 1})

    def limit(self, n: int) -> Query:
        return self._set(limit=n)

    def offset(self, n: int) -> Query:
        return self._set(skip=n)

    def select(self, *fields: str) -> Query:
        return self._set(project={f: 1 for f in fields})

    def filter(self) -> dict:
        made = [g[0] if len(g) == 1 else {"$and": list(g)} for g in self.groups if g]
        return {} if not made else made[0] if len(made) == 1 else {"$or": made}

    def find(self) -> DataFrame:
        return find(self.df, self.filter(), **self.options)
