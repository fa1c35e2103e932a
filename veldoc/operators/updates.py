"""Update operators as projections, and the writes built on them. Rows that the filter doesn't match stay as they are."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veldoc.operators.filters import Compiler, Fields, has, literal, matches, truth

#: The order in which operators apply.
ORDER = ["$set", "$unset", "$inc", "$mul", "$min", "$max", "$push", "$pull", "$pullAll", "$addToSet", "$pop", "$rename", "$currentDate", "$setOnInsert", "$bit"]


class UpdateError(ValueError):
    """An update that no row could take."""


def validate(update: Mapping[str, Any]) -> None:
    """Operators must exist, and no field may be changed by two of them."""
    seen: dict[str, str] = {}
    for op, fields in update.items():
        if op not in ORDER:
            raise UpdateError(f"unknown update operator {op}")
        for f in fields:
            if f in seen:
                raise UpdateError(f"{f} is changed by {seen[f]} and {op}")
            seen[f] = op


def _array(c: Column, kind: T.DataType) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _push(c: Column, kind: T.ArrayType, v: Any) -> Column:
    spec = v if isinstance(v, Mapping) and "$each" in v else {"$each": [v]}
    new = F.array(*[literal(x) for x in spec["$each"]]).cast(kind) if spec["$each"] else F.array().cast(kind)
    old = _array(c, kind)
    if "$position" in spec:
        at = spec["$position"]
        at = F.greatest(F.lit(0), F.size(old) + at) if at < 0 else F.least(F.lit(at), F.size(old))
        out = F.concat(F.slice(old, F.lit(1), at), new, F.slice(old, at + 1, F.size(old)))
    else:
        out = F.concat(old, new)
    if "$sort" in spec:
        order = spec["$sort"]
        if isinstance(order, Mapping):
            (key, way), = order.items()
            less = lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)
            out = F.array_sort(out, less if way == 1 else lambda a, b: -less(a, b))
        else:
            out = F.sort_array(out, asc=order == 1)
    if "$slice" in spec:
        n = spec["$slice"]
        out = F.slice(out, F.lit(1), F.lit(n)) if n >= 0 else F.slice(out, F.greatest(F.size(out) + n + 1, F.lit(1)), F.lit(-n))
    return out


def _change(df: DataFrame, op: str, field: str, v: Any, clock: Column | None) -> Column:
    c, kind = Fields(df.schema, F.col).get(field)
    if op in ("$set", "$setOnInsert"):
        return literal(v)
    if op == "$unset":
        return F.lit(None).cast(kind)
    if op in ("$inc", "$mul"):
        if not isinstance(kind, (T.NumericType, T.NullType)):
            raise UpdateError(f"{op} on {field}, which is no number")
        old = F.coalesce(c, F.lit(0))
        return old + F.lit(v) if op == "$inc" else old * F.lit(v)
    if op == "$min":
        return F.when(c.isNull() | (F.lit(v) < c), F.lit(v)).otherwise(c)
    if op == "$max":
        return F.greatest(c, F.lit(v))
    if op == "$push":
        return _push(c, kind, v)
    if op == "$pull":
        test = (lambda x: truth(Compiler(Fields(kind.elementType, x)).element(x, kind.elementType, v))) if isinstance(v, Mapping) else (lambda x: x.eqNullSafe(literal(v)))
        return F.filter(c, lambda x: ~test(x))
    if op == "$pullAll":
        return F.filter(c, lambda x: ~_any_equal(x, v))
    if op == "$addToSet":
        out = _array(c, kind)
        for x in v["$each"] if isinstance(v, Mapping) and "$each" in v else [v]:
            out = F.when(has(out, x), out).otherwise(F.concat(out, F.array(literal(x)).cast(kind)))
        return out
    if op == "$pop":
        return F.when(F.size(c) > 0, F.slice(c, F.lit(2), F.size(c)) if v == -1 else F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c)
    if op == "$currentDate":
        now = clock if clock is not None else F.current_timestamp()
        return F.unix_millis(now) if isinstance(v, Mapping) and v.get("$type") == "timestamp" else now
    if op == "$bit":
        (name, n), = v.items()
        old = F.coalesce(c.cast("int"), F.lit(0))
        return {"and": old.bitwiseAND, "or": old.bitwiseOR, "xor": old.bitwiseXOR}[name](F.lit(n))
    raise UpdateError(op)


def _any_equal(x: Column, values: list) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | x.eqNullSafe(literal(v))
    return out


def _put(df: DataFrame, field: str, value: Column, hit: Column) -> DataFrame:
    root, _, rest = field.partition(".")
    if rest:
        return df.withColumn(root, F.when(hit, F.col(root).withField(rest, value)).otherwise(F.col(root)))
    old = F.col(f"`{root}`") if root in df.columns else F.lit(None)
    return df.withColumn(root, F.when(hit, value).otherwise(old))


def update(df: DataFrame, spec: Mapping[str, Any], change: Mapping[str, Any], clock: Column | None = None, inserting: bool = False) -> DataFrame:
    """Applies an update to the rows that a filter matches. The filter is judged before any change."""
    validate(change)
    out = df.withColumn("_hit", truth(matches(df, spec)) if spec else F.lit(True))
    for op in [o for o in ORDER if o in change]:
        if op == "$setOnInsert" and not inserting:
            continue
        for field, v in change[op].items():
            if op == "$rename":
                if field in out.columns:
                    out = _put(out, v, F.col(field), F.col("_hit"))
                    out = _put(out, field, F.lit(None).cast(out.schema[field].dataType), F.col("_hit"))
            else:
                out = _put(out, field, _change(out, op, field, v, clock), F.col("_hit"))
    if "version" in df.columns and "version" not in {f for o in change.values() for f in o}:
        out = _put(out, "version", F.col("version") + 1, F.col("_hit"))
    return out.drop("_hit")


def update_expected(df: DataFrame, spec: Mapping[str, Any], change: Mapping[str, Any], version: int) -> DataFrame:
    """An update that takes only rows of the version that the caller has seen."""
    return update(df, {"$and": [spec, {"version": version}]}, change)


def create(df: DataFrame, new: DataFrame, defaults: Mapping[str, Any] | None = None, clock: Column | None = None, actor: str | None = None) -> DataFrame:
    """Adds rows: defaults where a field is null or missing, audit fields and version 1 where the table has them."""
    for name, v in (defaults or {}).items():
        new = new.withColumn(name, F.coalesce(F.col(name), F.lit(v)) if name in new.columns else F.lit(v))
    now = clock if clock is not None else F.current_timestamp()
    for name, value in (("createdAt", now), ("updatedAt", now), ("createdBy", F.lit(actor)), ("updatedBy", F.lit(actor)), ("version", F.lit(1))):
        if name in df.columns and name not in new.columns:
            new = new.withColumn(name, value.cast(df.schema[name].dataType))
    return df.unionByName(new, allowMissingColumns=True)


def delete(df: DataFrame, spec: Mapping[str, Any], hard: bool = False, clock: Column | None = None) -> DataFrame:
    """Marks the rows as deleted, or leaves them out."""
    hit = truth(matches(df, spec))
    if hard:
        return df.where(~hit)
    now = clock if clock is not None else F.current_timestamp()
    old = F.col("deletedAt") if "deletedAt" in df.columns else F.lit(None).cast("timestamp")
    return df.withColumn("deletedAt", F.when(hit, F.coalesce(old, now.cast("timestamp"))).otherwise(old))


def restore(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    return df.withColumn("deletedAt", F.when(~truth(matches(df, spec)), F.col("deletedAt")))


def upsert(df: DataFrame, new: DataFrame, key: str, on_insert: Mapping[str, Any] | None = None) -> DataFrame:
    """Rows of `new` replace those of their key, or are added; `on_insert` sets fields of added rows only."""
    a, b = df.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    adds, changes = F.col(f"a.{key}").isNull(), F.col(f"b.{key}").isNotNull()
    out = []
    for c in df.columns:
        value = F.when(changes, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in new.columns else F.col(f"a.{c}")
        value = F.when(adds, F.lit(on_insert[c])).otherwise(value) if on_insert and c in on_insert else value
        out.append(value.alias(c))
    return joined.select(*out)


def violations(df: DataFrame, rules: Mapping[str, Mapping[str, Any]], key: str) -> DataFrame:
    """(key, field, rule) for each broken rule: required, enum, pattern, min, max, minLength, maxLength, unique."""
    checks = []
    for field, rule in rules.items():
        c = F.col(field)
        tests = {"required": c.isNull(), "enum": c.isNotNull() & ~c.isin(rule.get("enum", [])), "pattern": ~c.rlike(rule.get("pattern", "")), "min": c < F.lit(rule.get("min")), "max": c > F.lit(rule.get("max")), "minLength": F.length(c) < F.lit(rule.get("minLength")), "maxLength": F.length(c) > F.lit(rule.get("maxLength"))}
        checks += [F.when(truth(tests[r]), F.struct(F.lit(field).alias("field"), F.lit(r).alias("rule"))) for r in rule if r in tests and rule[r] is not False]
    out = df.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*checks))).alias("v")).select("key", "v.*") if checks else None
    for field in [f for f, r in rules.items() if r.get("unique")]:
        twice = df.where(F.col(field).isNotNull()).groupBy(field).count().where("count > 1").select(field)
        more = df.join(twice, field, "left_semi").select(F.col(key).alias("key"), F.lit(field).alias("field"), F.lit("unique").alias("rule"))
        out = more if out is None else out.union(more)
    return out


def validated(df: DataFrame, rules: Mapping[str, Mapping[str, Any]], key: str, mode: str = "strict") -> DataFrame:
    """strict: raises if a rule is broken; permissive: leaves broken rows out; warn: keeps all."""
    if mode == "warn":
        return df
    broken = violations(df, rules, key)
    if mode == "permissive":
        return df.join(broken.select(F.col("key").alias(key)).distinct(), key, "left_anti")
    first = broken.limit(1).collect()
    if first:
        raise UpdateError(f"{first[0]['field']} of {first[0]['key']} breaks {first[0]['rule']}")
    return df
