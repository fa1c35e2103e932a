"""Expressions of pipelines as columns: field references, literals and operators."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from veldoc.operators.filters import Fields, null_first_compare


class Expressions:
    """Compiles expressions for one schema."""

    def __init__(self, fields: Fields):
        self.fields = fields

    def ref(self, value: Any) -> tuple[Column, T.DataType | None]:
        if isinstance(value, str) and value.startswith("$"):
            return self.fields.get(value[1:])
        return F.lit(value), None

    def __call__(self, value: Any) -> Column:
        if isinstance(value, Mapping):
            if len(value) == 1 and (name := next(iter(value))).startswith("$"):
                return self.operator(name, value[name])
            return F.struct(*[self(v).alias(k) for k, v in value.items()])
        if isinstance(value, (list, tuple)):
            return F.array(*[self(v) for v in value])
        return self.ref(value)[0]

    def number(self, value: Any) -> Column:
        """A number, 0 for null or for what isn't one."""
        c, kind = self.ref(value) if not isinstance(value, Mapping) else (self(value), None)
        if isinstance(value, bool) or (isinstance(value, str) and not value.startswith("$")):
            return F.lit(0.0)
        if isinstance(kind, (T.StringType, T.BooleanType, T.ArrayType, T.StructType, T.MapType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(0.0)
        return F.coalesce(c.cast("double"), F.lit(0.0))

    def truthy(self, value: Any) -> Column:
        """As a condition: null, false, 0, NaN and the empty string are false."""
        c, kind = (self(value), None) if isinstance(value, Mapping) else self.ref(value)
        if isinstance(value, Mapping) or isinstance(kind, T.BooleanType) or isinstance(value, bool):
            return F.coalesce(c, F.lit(False))
        if isinstance(kind, T.StringType):
            return c.isNotNull() & (c != "")
        if isinstance(kind, T.NumericType):
            return c.isNotNull() & (c != 0) & ~F.isnan(c.cast("double"))
        return c.isNotNull()

    def operator(self, name: str, v: Any) -> Column:
        if name == "$literal":
            return F.lit(v)
        if name == "$strLenCP":
            c, kind = self.ref(v) if not isinstance(v, Mapping) else (self(v), T.StringType())
            return F.coalesce(F.length(c), F.lit(0)) if kind is None or isinstance(kind, T.StringType) else F.lit(0)
        if name == "$concat":
            return F.concat_ws("", *[self(x).cast("string") for x in v])
        if name in ("$toUpper", "$toLower"):
            c, kind = self.ref(v) if not isinstance(v, Mapping) else (self(v), T.StringType())
            return (F.upper if name == "$toUpper" else F.lower)(c) if kind is None or isinstance(kind, T.StringType) else c
        if name in ("$gt", "$gte", "$lt", "$lte", "$eq", "$ne"):
            return null_first_compare(self(v[0]), self(v[1]), name)
        if name in ("$add", "$subtract", "$multiply"):
            op = {"$add": operator.add, "$subtract": operator.sub, "$multiply": operator.mul}[name]
            return functools.reduce(op, [self.number(x) for x in v])
        if name == "$divide":
            return F.try_divide(self.number(v[0]), self.number(v[1]))
        if name == "$cond":
            test, yes, no = v if isinstance(v, (list, tuple)) else (v["if"], v["then"], v["else"])
            return F.when(self.truthy(test), self(yes)).otherwise(self(no))
        if name == "$ifNull":
            return F.coalesce(*[self(x) for x in v])
        raise ValueError(f"unknown expression {name}")


def date_part(ts: Column, part: str) -> Column:
    """A part of a time in UTC: year, month (1-12), day, hour, minute, dayOfWeek (0 is Sunday), week (ISO)."""
    parts: dict[str, Callable[[Column], Column]] = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "dayOfWeek": lambda c: F.dayofweek(c) - 1, "week": F.weekofyear}
    return parts[part](ts)


def time_bucket(ts: Column, unit: str) -> Column:
    """Start of the minute, hour, day, week (from Sunday) or month."""
    return F.date_trunc("day", ts) - F.make_dt_interval(F.dayofweek(ts) - 1) if unit == "week" else F.date_trunc(unit, ts)


def time_bucket_end(ts: Column, unit: str) -> Column:
    step = {"minute": "interval 1 minute", "hour": "interval 1 hour", "day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[unit]
    return time_bucket(ts, unit) + F.expr(step)


def status_category(status: Column) -> Column:
    out = F.when(status < 200, "1xx")
    for top, name in ((300, "2xx"), (400, "3xx"), (500, "4xx")):
        out = out.when(status < top, name)
    return out.otherwise("5xx")


#: Patterns of error messages and their classes, the first that matches holds.
ERROR_PATTERNS = [
    ("(?i)timeout|timed out", "timeout"),
    ("(?i)rate.?limit|too many requests", "rate_limit"),
    ("(?i)unauthorized|authentication|invalid token", "auth"),
    ("(?i)forbidden|permission", "permission"),
    ("(?i)not found|404", "not_found"),
    ("(?i)validation|invalid|malformed", "validation"),
    ("(?i)network|connection|econn", "network"),
    ("(?i)memory|heap", "memory"),
    ("(?i)database|sql|query", "database"),
    ("(?i)parse|syntax", "parse"),
    ("(?i)conflict|version", "conflict"),
    ("(?i)quota|limit exceeded", "quota"),
]


def error_class(message: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    out = F.when(message.isNull(), "unknown")
    for pattern, name in patterns or ERROR_PATTERNS:
        out = out.when(message.rlike(pattern), name)
    return out.otherwise("unknown")


def severity(status: Column) -> Column:
    return F.when(status >= 500, "critical").when(status >= 400, "error").when(status >= 300, "warning").otherwise("info")


def content_type(text: Column) -> Column:
    """json, html, code, markdown or text, by the first test that a text passes."""
    trimmed = F.trim(text)
    return (
        F.when(trimmed.rlike(r"^[\[{]") & F.try_parse_json(trimmed).isNotNull(), "json")
        .when(trimmed.rlike(r"(?i)^<(!doctype|html|head|body|div)\b"), "html")
        .when(trimmed.rlike(r"(?m)^(import |from \w+ import |def |class |function |const |let |public |#include)"), "code")
        .when(trimmed.rlike(r"(?m)^(#{1,6} |[-*] |> |```|\d+\. )"), "markdown")
        .otherwise("text")
    )


def code_language(text: Column) -> Column:
    return (
        F.when(text.rlike(r"(?m)^\s*(def \w+\(|import \w+$|from \w+ import )"), "python")
        .when(text.rlike(r"\binterface \w+ \{|: (string|number|boolean)\b"), "typescript")
        .when(text.rlike(r"\b(const|let|var) \w+ =|=>|\bfunction\b"), "javascript")
        .when(text.rlike(r"\bpublic (static |final )*(class|void)\b"), "java")
        .when(text.rlike(r"\bfunc \w+\(|\bpackage main\b"), "go")
        .when(text.rlike(r"\bfn \w+\(|\blet mut\b"), "rust")
        .when(text.rlike(r"(?i)\bselect\b.+\bfrom\b"), "sql")
        .otherwise("unknown")
    )


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def djb2(text: Column) -> Column:
    """The 32-bit rolling hash h * 33 + c over code points, as an unsigned number."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: F.pmod(h * 33 + c, F.lit(1 << 32)))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's code points, as an unsigned number."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * 16777619, F.lit(1 << 32)))


def typed_value(text: Column) -> Column:
    """What kind of value a text holds: null, boolean, integer, number, date, json or string."""
    t = F.trim(text)
    return (
        F.when(t.isNull() | (t == "") | (F.lower(t) == "null"), "null")
        .when(F.lower(t).isin("true", "false"), "boolean")
        .when(t.rlike(r"^-?\d+$"), "integer")
        .when(t.rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), "number")
        .when(t.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$"), "date")
        .when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), "json")
        .otherwise("string")
    )
