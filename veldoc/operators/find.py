"""Finding documents: filter, sort, cursor, skip, limit, projection; and counting them."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, functions as F

from veldoc.operators.filters import alive, any_of, where
from veldoc.operators.pipeline import sort as sorted_by


@dataclass
class Page:
    items: DataFrame
    has_more: bool
    next_cursor: Any
    total: int


def projected(df: DataFrame, spec: Mapping[str, Any] | None) -> DataFrame:
    """The columns that are 1; or all but those that are 0."""
    if not spec:
        return df
    wanted = [k for k, v in spec.items() if v]
    return df.select(*wanted) if wanted else df.drop(*spec)


def find(df: DataFrame, spec: Mapping[str, Any] | None = None, sort: Mapping[str, Any] | None = None, skip: int = 0, limit: int | None = None, project: Mapping[str, Any] | None = None, include_deleted: bool = False, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """Documents by filter. With a sort and a limit Spark keeps the best rows of each partition and merges them."""
    out = where(alive(df, include_deleted), spec or {}, renamed=renamed)
    out = sorted_by(out, sort, "find") if sort else out
    out = out.offset(skip) if skip else out
    out = out.limit(limit) if limit is not None else out
    return projected(out, project)


def get_many(df: DataFrame, ids: Sequence[Any], key: str) -> DataFrame:
    """Documents in the order of `ids`, with nulls for those that don't exist."""
    asked = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(ids)], ["position", "asked"])
    return asked.join(df, asked["asked"] == df[key], "left").orderBy("position")


def exists(df: DataFrame, spec: Mapping[str, Any]) -> bool:
    return not where(df, spec).limit(1).isEmpty()


def after(df: DataFrame, keys: Sequence[tuple[str, bool]], last: Mapping[str, Any]) -> DataFrame:
    """Rows behind the row `last` in the order of `keys` (name, descending), in which nulls are last: the keyset page.
    The predicate is on columns, so nothing before the page is sorted or skipped."""
    parts = []
    for i, (name, down) in enumerate(keys):
        same = [F.col(k).eqNullSafe(F.lit(last[k])) for k, _ in keys[:i]]
        if last[name] is None:
            continue  # nothing comes behind null
        beyond = F.col(name).isNull() | ((F.col(name) < F.lit(last[name])) if down else (F.col(name) > F.lit(last[name])))
        parts.append(functools.reduce(operator.and_, same, beyond))
    return df.where(any_of(parts))


def page(df: DataFrame, spec: Mapping[str, Any], sort: Mapping[str, Any], key: str, limit: int, cursor: Any = None) -> Page:
    """A page behind the document of id `cursor`; an unknown cursor gives an empty one. `key` breaks ties."""
    found = where(df, spec)
    keys = [(k, v in (-1, "desc")) for k, v in sort.items()] + ([(key, False)] if key not in sort else [])
    rest = found
    if cursor is not None:
        last = found.where(F.col(key) == F.lit(cursor)).select(*[k for k, _ in keys]).limit(1).collect()
        rest = after(found, keys, last[0].asDict()) if last else found.where(F.lit(False))
    order = dict(sort) | ({key: 1} if key not in sort else {})
    top = sorted_by(rest, order, "find").limit(limit + 1)
    ids = [r[0] for r in top.select(key).collect()]
    return Page(top.limit(limit), len(ids) > limit, ids[limit - 1] if len(ids) > limit else None, found.count())
