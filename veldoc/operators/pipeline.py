"""Aggregation pipelines: a list of stages applied to a DataFrame in turn, all of them lazily.

A DataFrame has no order of its own. What depends on the order of rows ($first, $last, $push) takes it from `order`, a
column that tells rows apart; without it the order is that of the values themselves, so that results are stable.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veldoc.functions.expressions import Expressions
from veldoc.operators.filters import Fields, matches


def _fields(df: DataFrame) -> Fields:
    return Fields(df.schema, F.col)


def null_order(name: str, descending: bool, dialect: str) -> Column:
    """A sort key. Dialects: find (nulls last), pipeline (nulls first ascending, last descending), view (the reverse)."""
    c = F.col(name)
    if dialect == "find":
        return c.desc_nulls_last() if descending else c.asc_nulls_last()
    if dialect == "pipeline":
        return c.desc_nulls_last() if descending else c.asc_nulls_first()
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def sort(df: DataFrame, keys: Mapping[str, int | str], dialect: str = "find") -> DataFrame:
    return df.orderBy(*[null_order(k, v in (-1, "desc"), dialect) for k, v in keys.items()])


def _is_number(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.NumericType)


def accumulator(df: DataFrame, spec: Any, order: str | None) -> Column:
    """The aggregate of a `$group`."""
    e = Expressions(_fields(df))
    (name, value), = spec.items()
    computed = isinstance(value, Mapping) and bool(value)
    c, kind = (e(value), T.DoubleType()) if computed else e.ref(value)
    known = computed or (isinstance(value, str) and value.startswith("$"))
    place = F.col(order) if order else c
    if name == "$sum":
        if not known:
            return F.count("*") * F.lit(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else F.lit(0)
        return F.coalesce(F.sum(c), F.lit(0).cast("double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "long")) if _is_number(kind) else F.lit(0)
    if name == "$avg":  # over all rows, those without a number too
        return F.sum(F.coalesce(c.cast("double"), F.lit(0.0))) / F.count("*") if _is_number(kind) else F.lit(0.0)
    if name in ("$min", "$max"):
        return (F.min if name == "$min" else F.max)(c) if _is_number(kind) else F.lit(None).cast("double")
    if name in ("$first", "$last"):
        return (F.min_by if name == "$first" else F.max_by)(F.struct(c.alias("x")), place)["x"]
    if name == "$push":
        rows = F.array_sort(F.collect_list(F.struct(place.alias("o"), c.alias("x"))))
        return F.transform(rows, lambda r: r["x"])
    if name == "$addToSet":
        return F.transform(F.array_sort(F.collect_set(F.struct(c.alias("x")))), lambda r: r["x"])
    if name == "$count":
        return F.count("*")
    raise ValueError(f"unknown accumulator {name}")


def group(df: DataFrame, spec: Mapping[str, Any], order: str | None = None) -> DataFrame:
    """`$group`: `_id` is a field, a struct of fields, or a constant; a group for each value, null ones together. No
    rows make no groups."""
    e, key = Expressions(_fields(df)), spec.get("_id")
    aggs = [accumulator(df, s, order).alias(n) for n, s in spec.items() if n != "_id"]
    if isinstance(key, Mapping):
        names = [f"_key_{i}" for i in range(len(key))]
        out = df.groupBy(*[e(v).alias(n) for n, v in zip(names, key.values())]).agg(*(aggs or [F.count("*").alias("_rows")]))
        out = out.select(F.struct(*[F.col(n).alias(k) for n, k in zip(names, key)]).alias("_id"), *[n for n in spec if n != "_id"])
        return out
    if isinstance(key, str) and key.startswith("$"):
        return df.groupBy(e(key).alias("_id")).agg(*aggs) if aggs else df.select(e(key).alias("_id")).distinct()
    out = df.groupBy(F.lit(key).alias("_id"))
    return out.agg(*aggs) if aggs else df.select(F.lit(key).alias("_id")).distinct()


def project(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """`$project`: the fields that are 1, with computed ones; or all but those that are 0."""
    e = Expressions(_fields(df))
    if all(v == 0 and not isinstance(v, Mapping) for v in spec.values()):
        return df.drop(*spec)
    out = []
    for name, v in spec.items():
        if v is True or v == 1:
            c, _ = _fields(df).get(name)
            out.append(c.alias(name.split(".")[-1]))
        elif isinstance(v, Mapping):
            out.append(e(v).alias(name))
    return df.select(*out)


def add_fields(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    e = Expressions(_fields(df))
    return df.withColumns({n: e(v) for n, v in spec.items()})


def unwind(df: DataFrame, spec: str | Mapping[str, Any]) -> DataFrame:
    """`$unwind`: a row for each element; rows without any stay, with null, if asked for. The index counts from 0."""
    spec = {"path": spec} if isinstance(spec, str) else spec
    path, index, outer = spec["path"].lstrip("$"), spec.get("includeArrayIndex"), spec.get("preserveNullAndEmptyArrays", False)
    names = df.columns
    explode = F.posexplode_outer if outer else F.posexplode
    out = df.select(*[F.col(f"`{c}`") for c in names if c != path], explode(F.col(path)).alias("_at", path))
    out = out.withColumnRenamed("_at", index) if index else out.drop("_at")
    return out.select(*[F.col(f"`{c}`") for c in names], *([index] if index else []))


def lookup(df: DataFrame, spec: Mapping[str, Any], collections: Mapping[str, DataFrame]) -> DataFrame:
    """`$lookup`: the rows of another collection that agree, as an array, empty where there are none."""
    other = collections[spec["from"]]
    key, name = f"_key_{spec['as']}", spec["as"]
    right = other.groupBy(F.col(spec["foreignField"]).alias(key)).agg(F.array_sort(F.collect_list(F.struct("*"))).alias(name))
    out = df.drop(name).join(right, F.col(spec["localField"]).eqNullSafe(F.col(key)), "left").drop(key)
    return out.withColumn(name, F.coalesce(name, F.array().cast(right.schema[name].dataType)))


def bucket(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """`$bucket`: rows by [bound, next bound); others go to `default`, or are dropped without one. `_id` is a string."""
    e = Expressions(_fields(df))
    c, bounds = e(spec["groupBy"]), spec["boundaries"]
    label = None
    for low, high in zip(bounds, bounds[1:]):
        test = (c >= low) & (c < high)
        label = F.when(test, str(low)) if label is None else label.when(test, str(low))
    label = label.otherwise(str(spec["default"])) if "default" in spec else label
    out = df.withColumn("_id", label)
    out = out if "default" in spec else out.where(F.col("_id").isNotNull())
    return out.groupBy("_id").agg(*[accumulator(df, s, None).alias(n) for n, s in spec.get("output", {"count": {"$sum": 1}}).items()])


def facet(df: DataFrame, spec: Mapping[str, Sequence[Mapping]], **options: Any) -> DataFrame:
    """`$facet`: one row, of each sub-pipeline's rows as a sorted array. Facets are reports: small after aggregation."""
    parts = [run(df, p, **options).agg(F.array_sort(F.collect_list(F.struct("*"))).alias(n)).withColumn("_one", F.lit(1)) for n, p in spec.items()]
    return functools.reduce(lambda a, b: a.join(b, "_one"), parts).drop("_one")


def run(df: DataFrame, stages: Sequence[Mapping[str, Any]], collections: Mapping[str, DataFrame] | None = None, order: str | None = None, seed: int | None = None) -> DataFrame:
    """Applies the stages of a pipeline in turn."""
    for stage in stages:
        (name, v), = stage.items()
        if name == "$match":
            df = df.where(matches(df, v)) if v else df
        elif name == "$group":
            df = group(df, v, order)
        elif name == "$sort":
            df = sort(df, v, "pipeline")
        elif name == "$limit":
            df = df.limit(v)
        elif name == "$skip":
            df = df.offset(v)
        elif name == "$project":
            df = project(df, v)
        elif name in ("$addFields", "$set"):
            df = add_fields(df, v)
        elif name == "$unset":
            df = df.drop(*([v] if isinstance(v, str) else v))
        elif name == "$unwind":
            df = unwind(df, v)
        elif name == "$lookup":
            df = lookup(df, v, collections or {})
        elif name == "$count":
            df = df.agg(F.count("*").alias(v))
        elif name == "$replaceRoot":
            root = v["newRoot"]
            df = df.select(f"{root[1:]}.*") if isinstance(root, str) else df.select(Expressions(_fields(df))(root).alias("_root")).select("_root.*")
        elif name == "$sample":
            df = df.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(v["size"])
        elif name == "$bucket":
            df = bucket(df, v)
        elif name == "$facet":
            df = facet(df, v, collections=collections, order=order, seed=seed)
        else:
            raise ValueError(f"unknown stage {name}")
    return df


def explain(df: DataFrame, stages: Sequence[Mapping[str, Any]], **options: Any) -> list[tuple[str, int]]:
    """Rows after each stage. Every prefix of the pipeline is run for its count."""
    out = []
    for i in range(len(stages)):
        out.append((next(iter(stages[i])), run(df, stages[: i + 1], **options).count()))
    return out
