"""Materialized views: definition, aggregation, full and incremental refresh, rewriting of queries, staleness."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veldoc.functions.expressions import date_part
from veldoc.operators.filters import matches, where
from veldoc.operators.pipeline import run as run_pipeline, sort as sort_by

#: After GRACE a view is stale, a warning comes WARN before; so many changes make it stale at once.
GRACE, WARN, CHANGES = timedelta(minutes=15), timedelta(minutes=5), 10_000
#: A rewrite must spare this share of the rows read.
LEAST_SAVING = 0.2
MERGEABLE = ("$sum", "$count", "$min", "$max", "$avg")


class ViewError(ValueError):
    """A view that can't be made as defined."""


@dataclass
class View:
    """`source` table; filter; fields unnested, expanded (joined) and computed; group and aggregates; having, sort, limit;
    or a pipeline instead."""

    name: str
    source: str
    filter: Mapping[str, Any] = field(default_factory=dict)
    group: Mapping[str, Any] = field(default_factory=dict)
    aggregates: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    having: Mapping[str, Any] = field(default_factory=dict)
    sort: Mapping[str, int] = field(default_factory=dict)
    limit: int | None = None
    select: Sequence[str] = ()
    unnest: str | None = None
    expand: Mapping[str, tuple[str, str, str]] = field(default_factory=dict)  # prefix: (table, key, foreign key)
    pipeline: Sequence[Mapping[str, Any]] = ()


def validate(views: Sequence[View], tables: Sequence[str]) -> list[str]:
    """Names of the views in an order in which each comes after its sources; an error for an unknown source or a cycle."""
    known, rest, out = set(tables), {v.name: v for v in views}, []
    if len(rest) < len(views):
        raise ViewError("two views of one name")
    while rest:
        ready = [n for n, v in rest.items() if v.source in known]
        if not ready:
            raise ViewError(f"unknown source or cycle: {', '.join(sorted(rest))}")
        out += ready
        known |= set(ready)
        rest = {n: v for n, v in rest.items() if n not in known}
    return out


def group_key(df: DataFrame, spec: Any) -> Column:
    """A field, a part of a date or a numeric bucket (as text, `other` outside)."""
    if isinstance(spec, str):
        return F.col(spec.lstrip("$"))
    if "$dateField" in spec:
        return date_part(F.col(spec["$dateField"]), spec["$datePart"])
    c, bounds, label = F.col(spec["$bucket"]), spec["$boundaries"], None
    for low, high in zip(bounds, bounds[1:]):
        test = (c >= low) & (c < high)
        label = F.when(test, f"{low}-{high}") if label is None else label.when(test, f"{low}-{high}")
    return label.otherwise(spec.get("$default", "other"))


def aggregate(df: DataFrame, spec: Mapping[str, Any], order: str | None = None) -> Column:
    """Aggregates of views skip nulls; without a value the average, least and greatest are null, the sum is 0."""
    (name, v), = spec.items()
    if isinstance(v, Mapping) and "$cond" in v:
        test, yes, no = v["$cond"]
        c = F.when(F.coalesce(matches(df, test), F.lit(False)), F.col(yes[1:]) if isinstance(yes, str) else F.lit(yes)).otherwise(F.col(no[1:]) if isinstance(no, str) else F.lit(no))
    else:
        c = F.col(v.lstrip("$")) if isinstance(v, str) and v != "*" else F.lit(v)
    if name == "$count":
        return F.count("*") if v == "*" else F.count(c)
    if name == "$sum":
        return F.count("*") * F.lit(v) if not isinstance(v, (str, Mapping)) else F.coalesce(F.sum(c), F.lit(0))
    simple = {"$avg": F.avg, "$min": F.min, "$max": F.max, "$stdDev": F.stddev_pop, "$stdDevSamp": F.stddev_samp}
    if name in simple:
        return simple[name](c)
    if name in ("$first", "$last"):
        return (F.min_by if name == "$first" else F.max_by)(F.struct(c.alias("x")), F.col(order) if order else c)["x"]
    raise ViewError(f"unknown aggregate {name}")


def evaluate(view: View, tables: Mapping[str, DataFrame], source: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """The rows of a view."""
    df = tables[view.source] if source is None else source
    df = where(df, view.filter)
    for prefix, (table, key, foreign) in view.expand.items():
        other = tables[table]
        df = df.join(other.select(*[F.col(c).alias(f"{prefix}_{c}") for c in other.columns]), F.col(key) == F.col(f"{prefix}_{foreign}"), "left")
    if view.unnest:
        df = df.withColumn(view.unnest, F.explode(view.unnest))
    if view.pipeline:
        return run_pipeline(df, view.pipeline, tables, order)
    if view.aggregates:
        keys = [group_key(df, k).alias(n) for n, k in view.group.items()]
        aggs = [aggregate(df, a, order).alias(n) for n, a in view.aggregates.items()]
        df = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    df = where(df, view.having)
    df = sort_by(df, view.sort, "view") if view.sort else df
    df = df.limit(view.limit) if view.limit is not None else df
    return df.select(*view.select) if view.select else df


def partials(view: View, df: DataFrame) -> DataFrame:
    """Mergeable state of a view's groups: an average is kept as sum and count."""
    df = where(df, view.filter)
    aggs = []
    for n, a in view.aggregates.items():
        (name, v), = a.items()
        if name not in MERGEABLE:
            raise ViewError(f"{name} can't be merged")
        if name == "$avg":
            aggs += [F.sum(v.lstrip("$")).cast("double").alias(f"{n}__sum"), F.count(v.lstrip("$")).alias(f"{n}__count")]
        else:
            aggs.append(aggregate(df, a).alias(n))
    return df.groupBy(*[group_key(df, k).alias(n) for n, k in view.group.items()]).agg(*aggs)


def merge(view: View, *states: DataFrame) -> DataFrame:
    """One state of several: counts and sums add up, extremes are compared."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    aggs = []
    for n, a in view.aggregates.items():
        name = next(iter(a))
        if name == "$avg":
            aggs += [F.sum(f"{n}__sum").alias(f"{n}__sum"), F.sum(f"{n}__count").alias(f"{n}__count")]
        else:
            aggs.append({"$min": F.min, "$max": F.max}.get(name, F.sum)(n).alias(n))
    return both.groupBy(*view.group).agg(*aggs)


def finished(view: View, state: DataFrame) -> DataFrame:
    out = [F.try_divide(F.col(f"{n}__sum"), F.col(f"{n}__count")).alias(n) if "$avg" in a else F.col(n) for n, a in view.aggregates.items()]
    return where(state.select(*view.group, *out), view.having)


def incremental(view: View, state: DataFrame, added: DataFrame) -> DataFrame:
    """The state after rows were added: only these are aggregated."""
    return merge(view, state, partials(view, added))


def can_refresh_incrementally(view: View) -> bool:
    return bool(view.aggregates) and not view.pipeline and not view.expand and all(next(iter(a)) in MERGEABLE for a in view.aggregates.values())


def refresh(df: DataFrame, path: str) -> str:
    """Writes a view beside its former version and then points to it: readers never see half of it. The pointer is a
    row in a table, so any file system will do. Returns the path of the new version."""
    spark = df.sparkSession
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/current")
    return version


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(spark.read.parquet(f"{path}/current").orderBy(F.desc("at")).first()["version"])


def covers(view: View, query: View) -> bool:
    """Whether a query can be answered from a view: same source and filter, coarser or equal groups, aggregates that can
    be rolled up."""
    if view.source != query.source or dict(view.filter) != dict(query.filter) or view.limit is not None or view.having or view.pipeline or query.pipeline:
        return False
    held = {repr(a) for a in view.aggregates.values()}
    return all(n in view.group and view.group[n] == k for n, k in query.group.items()) and all(repr(a) in held and next(iter(a)) in ("$sum", "$count", "$min", "$max") for a in query.aggregates.values())


def rewritten(query: View, view: View, stored: DataFrame) -> DataFrame:
    """The query's rows from the view's."""
    names = {repr(a): n for n, a in view.aggregates.items()}
    aggs = []
    for n, a in query.aggregates.items():
        kind = next(iter(a))
        aggs.append({"$min": F.min, "$max": F.max}.get(kind, F.sum)(names[repr(a)]).alias(n))
    return where(stored.groupBy(*query.group).agg(*aggs), query.having)


def plan(query: View, views: Mapping[str, tuple[View, int, str]], source_rows: int) -> str | None:
    """The view to answer from: it covers the query, isn't invalid and spares enough rows; the smallest of several."""
    fit = [(rows, name) for name, (v, rows, state) in views.items() if state != "invalid" and covers(v, query) and rows <= (1 - LEAST_SAVING) * source_rows]
    return min(fit)[1] if fit else None


def staleness(refreshed: datetime | None, now: datetime, changes: int = 0) -> str:
    """invalid: never made; stale: beyond the grace or with too many changes; warning: soon so; else fresh."""
    if refreshed is None:
        return "invalid"
    age = now - refreshed
    return "stale" if age > GRACE or changes >= CHANGES else "warning" if age > GRACE - WARN else "fresh"


def staleness_of(refreshed: Column, now: Column, changes: Column, grace: timedelta = GRACE, warn: timedelta = WARN, most: int = CHANGES) -> Column:
    """`staleness` of many views at once, as a column; times of type timestamp."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(refreshed.cast("timestamp"))
    limit, soon = (int(x.total_seconds() * 1e6) for x in (grace, grace - warn))
    state = F.when((age > limit) | (changes >= most), "stale").when(age > soon, "warning").otherwise("fresh")
    return F.when(refreshed.isNull(), "invalid").otherwise(state)


def refreshed(view: View, state: DataFrame, base: DataFrame, created: DataFrame, others: int) -> DataFrame:
    """The state of a view after changes: from the rows created alone if there was no other change and all aggregates
    merge, from the whole table otherwise."""
    return incremental(view, state, created) if not others and can_refresh_incrementally(view) else partials(view, base.unionByName(created))
