"""Document filters as columns.

A filter is a dict of fields and operators. Predicates are two-valued: a negation is true where the field is null. A
bare comparison is left as it is at the top of a `where`, where null counts as false and the predicate still reaches
the Parquet scan; it is made two-valued only under a negation or as a value.
"""

from __future__ import annotations

import functools
import operator
import re
import warnings
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Operators that an index answers, not the row: they restrict nothing here.
INDEXED = ("$text", "$vector", "$geo")
_NAMES = {"null": T.NullType, "boolean": T.BooleanType, "string": T.StringType, "array": T.ArrayType, "date": (T.DateType, T.TimestampType, T.TimestampNTZType), "number": T.NumericType, "object": (T.StructType, T.MapType)}


class FilterError(ValueError):
    """A filter that has no meaning, as an operand of the wrong kind or a pattern that can't be run."""


def truth(p: Column) -> Column:
    """`p` with null as false."""
    return F.coalesce(p, F.lit(False))


def all_of(parts: Sequence[Column]) -> Column:
    return functools.reduce(operator.and_, parts) if parts else F.lit(True)


def any_of(parts: Sequence[Column]) -> Column:
    return functools.reduce(operator.or_, parts) if parts else F.lit(False)


def literal(value: Any) -> Column:
    if isinstance(value, Mapping):
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return F.array(*[literal(v) for v in value])
    return F.lit(value)


class Fields:
    """Finds the column and type of a dotted path; a number in it is an index into an array."""

    def __init__(self, schema: T.DataType, root: Callable[[str], Column] | Column, renamed: Mapping[str, str] | None = None):
        self.schema, self.root, self.renamed = schema, root, dict(renamed or {})

    def get(self, path: str) -> tuple[Column, T.DataType | None]:
        path = self.renamed.get(path, path)
        column = kind = None
        if callable(self.root) and isinstance(self.schema, T.StructType) and path in self.schema.names:
            return self.root(f"`{path}`"), self.schema[path].dataType
        for i, step in enumerate(path.split(".")):
            if i == 0:
                if not isinstance(self.schema, T.StructType) or step not in self.schema.names:
                    return F.lit(None), T.NullType()
                column = self.root(f"`{step}`") if callable(self.root) else self.root[step]
                kind = self.schema[step].dataType
            elif isinstance(kind, T.ArrayType) and step.isdigit():
                column, kind = F.get(column, F.lit(int(step))), kind.elementType
            elif isinstance(kind, T.StructType) and step in kind.names:
                column, kind = column[step], kind[step].dataType
            elif isinstance(kind, T.MapType):
                column, kind = F.try_element_at(column, F.lit(step)), kind.valueType
            elif isinstance(kind, T.VariantType):
                rest = ".".join(path.split(".")[i:])
                return F.try_variant_get(column, "$." + rest, "string"), T.StringType()
            else:
                return F.lit(None), T.NullType()
        return column, kind


def _is_operators(value: Any) -> bool:
    return isinstance(value, Mapping) and bool(value) and all(str(k).startswith("$") for k in value)


def equal(c: Column, value: Any) -> Column:
    return c.isNull() if value is None else c.eqNullSafe(literal(value)) if isinstance(value, (Mapping, list, tuple)) else c == F.lit(value)


def has(c: Column, value: Any) -> Column:
    """Whether an array holds a value."""
    return F.exists(c, lambda x: x.eqNullSafe(literal(value)))


def _one_of(c: Column, values: Any) -> Column:
    if not isinstance(values, (list, tuple)):
        return F.lit(False)
    known = [v for v in values if v is not None]
    plain = [v for v in known if not isinstance(v, (Mapping, list, tuple))]
    parts = ([c.isin(plain)] if plain else []) + [equal(c, v) for v in known if isinstance(v, (Mapping, list, tuple))]
    if len(known) < len(values):
        parts.append(c.isNull())
    return any_of(parts)


def pattern_of(pattern: str, options: str = "") -> str:
    """A pattern for `rlike`; refuses nested unbounded repeats, which can take time without end."""
    if re.search(r"\((?:[^()\\]|\\.)*[+*](?:[^()\\]|\\.)*\)[+*{]", pattern):
        raise FilterError(f"pattern of nested repeats: {pattern}")
    flags = "".join(x for x in options if x in "imsx")
    return f"(?{flags}){pattern}" if flags else pattern


class Compiler:
    """Compiles filters for one schema. `unknown`: what to do with operators that don't exist (ignore, warn, error)."""

    def __init__(self, fields: Fields, unknown: str = "ignore"):
        self.fields, self.unknown = fields, unknown

    def __call__(self, spec: Mapping[str, Any]) -> Column:
        parts = []
        for key, value in spec.items():
            if key == "$and":
                parts.append(all_of([self(s) for s in value]))
            elif key == "$or":
                parts.append(any_of([self(s) for s in value]))
            elif key == "$not":
                parts.append(~truth(self(value)))
            elif key == "$nor":
                parts.append(~any_of([truth(self(s)) for s in value]))
            elif key == "$expr":
                parts.append(self.compare_fields(value))
            elif key == "$comment" or key in INDEXED:
                continue
            elif key.startswith("$") and key not in self.fields.renamed and key not in getattr(self.fields.schema, "names", ()):
                self._unknown(key)
            else:
                parts.append(self.condition(*self.fields.get(key), value))
        return all_of(parts)

    def _unknown(self, name: str) -> None:
        if self.unknown == "error":
            raise FilterError(f"unknown operator {name}")
        if self.unknown == "warn":
            warnings.warn(f"unknown operator {name}", stacklevel=3)

    def condition(self, c: Column, kind: T.DataType | None, value: Any) -> Column:
        if not _is_operators(value):
            return equal(c, value)
        parts = []
        for name, operand in value.items():
            if name == "$options":
                continue
            if name == "$regex" and "$options" in value:
                parts.append(self.operator(c, kind, name, (operand, value["$options"])))
            else:
                parts.append(self.operator(c, kind, name, operand))
        return all_of([p for p in parts if p is not None])

    def operator(self, c: Column, kind: T.DataType | None, name: str, v: Any) -> Column | None:
        text = isinstance(kind, T.StringType) or kind is None
        if name == "$eq":
            return equal(c, v)
        if name == "$ne":
            return c.isNotNull() if v is None else ~c.eqNullSafe(literal(v))
        if name in ("$gt", "$gte", "$lt", "$lte"):
            if v is None:
                return F.lit(False)
            p = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}[name](c, F.lit(v))
            return p & ~F.isnan(c) if isinstance(kind, (T.DoubleType, T.FloatType)) and name in ("$gt", "$gte") else p
        if name == "$in":
            return _one_of(c, v)
        if name == "$nin":
            return ~truth(_one_of(c, v)) if isinstance(v, (list, tuple)) else F.lit(False)
        if name == "$mod":
            divisor, rest = v
            return F.lit(False) if divisor == 0 else c % F.lit(divisor) == F.lit(rest)
        if name == "$regex":
            pattern, options = v if isinstance(v, tuple) else (v, "")
            return c.rlike(pattern_of(pattern, options)) if text else F.lit(False)
        if name == "$startsWith":
            return c.startswith(v) if text else F.lit(False)
        if name == "$endsWith":
            return c.endswith(v) if text else F.lit(False)
        if name == "$contains":
            return c.contains(v) if text else F.lit(False)
        if name == "$all":
            if not isinstance(kind, T.ArrayType):
                return F.lit(False)
            return all_of([has(c, w) for w in v]) & c.isNotNull()
        if name == "$elemMatch":
            return F.exists(c, lambda x: truth(self.element(x, kind.elementType, v))) if isinstance(kind, T.ArrayType) else F.lit(False)
        if name == "$size":
            return F.size(c) == F.lit(v) if isinstance(kind, T.ArrayType) else F.lit(False)
        if name == "$exists":
            return c.isNotNull() if v else c.isNull()
        if name == "$type":
            if v not in _NAMES:
                return F.lit(False)
            return c.isNull() if v == "null" else c.isNotNull() if isinstance(kind, _NAMES[v]) else F.lit(False)
        if name == "$not":
            return ~truth(self.condition(c, kind, v))
        self._unknown(name)
        return None

    def element(self, x: Column, kind: T.DataType, spec: Any) -> Column:
        """A filter on the element of an array: operators on it, or a filter on its fields."""
        if _is_operators(spec) and not {"$and", "$or", "$nor"} & set(spec):
            return self.condition(x, kind, spec)
        if isinstance(spec, Mapping):
            return Compiler(Fields(kind, x), self.unknown)(spec) if isinstance(kind, T.StructType) else self._scalar(x, kind, spec)
        return equal(x, spec)

    def _scalar(self, x: Column, kind: T.DataType, spec: Mapping[str, Any]) -> Column:
        parts = []
        for key, value in spec.items():
            if key in ("$and", "$or", "$nor"):
                inner = [truth(self.element(x, kind, s)) for s in value]
                parts.append(all_of(inner) if key == "$and" else any_of(inner) if key == "$or" else ~any_of(inner))
            else:
                parts.append(self.condition(x, kind, {key: value}))
        return all_of(parts)

    def _side(self, value: Any) -> Column:
        return self.fields.get(value[1:])[0] if isinstance(value, str) and value.startswith("$") else F.lit(value)

    def compare_fields(self, spec: Mapping[str, Any]) -> Column:
        """`$expr`: fields against fields or values; null orders before all else here."""
        parts = []
        for name, (a, b) in spec.items():
            if name not in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
                return F.lit(False)
            parts.append(null_first_compare(self._side(a), self._side(b), name))
        return all_of(parts)


def null_first_compare(x: Column, y: Column, name: str) -> Column:
    """A two-valued comparison in which null equals null and is less than any value."""
    same, less = x.eqNullSafe(y), truth(x < y) | (x.isNull() & y.isNotNull())
    return {"$eq": same, "$ne": ~same, "$lt": less, "$lte": less | same, "$gt": ~(less | same), "$gte": ~less}[name]


def matches(df: DataFrame, spec: Mapping[str, Any], unknown: str = "ignore", renamed: Mapping[str, str] | None = None) -> Column:
    """The filter as a column of `df`. `renamed`: columns that system fields such as $id stand for."""
    return Compiler(Fields(df.schema, F.col, renamed), unknown)(spec)


def where(df: DataFrame, spec: Mapping[str, Any], unknown: str = "ignore", renamed: Mapping[str, str] | None = None) -> DataFrame:
    return df.where(matches(df, spec, unknown, renamed)) if spec else df


def strict_where(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """The engine's dialect: equality never converts, so a value of another kind than the field matches nothing."""
    kinds = {T.StringType: str, T.BooleanType: bool, T.NumericType: (int, float)}

    def fits(path: str, value: Any) -> bool:
        kind = Fields(df.schema, F.col).get(path)[1]
        want = next((py for k, py in kinds.items() if isinstance(kind, k)), object)
        return value is None or (isinstance(value, want) and not (want == (int, float) and isinstance(value, bool)))

    def clean(s: Mapping[str, Any]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for k, v in s.items():
            if k in ("$and", "$or", "$nor"):
                out[k] = [clean(x) for x in v]
            elif k == "$not":
                out[k] = clean(v)
            elif not isinstance(v, Mapping):
                out[k] = v if fits(k, v) else {"$in": []}
            else:
                out[k] = {o: ([w for w in x if fits(k, w)] if o in ("$in", "$nin") else x) if o != "$eq" or fits(k, x) else x for o, x in v.items() if o != "$eq" or fits(k, x)} or {"$in": []}
        return out

    return where(df, clean(spec), "error")


def alive(df: DataFrame, include_deleted: bool = False, column: str = "deletedAt") -> DataFrame:
    """Rows that are not deleted softly."""
    return df if include_deleted or column not in df.columns else df.where(F.col(column).isNull())
