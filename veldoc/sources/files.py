"""Tables as files: Parquet, JSON lines, CSV, extended JSON; versions of a table; writing and compacting."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from veldoc.operators.filters import alive, where


def read_parquet(spark: SparkSession, path: str, spec: Mapping[str, Any] | None = None, columns: Sequence[str] = (), skip: int = 0, limit: int | None = None, include_deleted: bool = True) -> DataFrame:
    """Filter and columns reach the scan."""
    df = where(alive(spark.read.parquet(path), include_deleted), spec or {})
    df = df.select(*columns) if columns else df
    df = df.offset(skip) if skip else df
    return df.limit(limit) if limit is not None else df


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, infer: bool = True) -> DataFrame:
    return spark.read.csv(path, sep=delimiter, header=header, inferSchema=infer, escape='"', multiLine=True)


def read_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return spark.read.json(path, multiLine=not lines)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", codec: str | None = None, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Writes a table; sorted files let later scans skip row groups."""
    df = df.sortWithinPartitions(*sort_by) if sort_by else df
    w = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    w = w.option("escape", '"').option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False) if kind == "csv" else w
    (w.option("compression", codec) if codec else w).format(kind).save(path)


def compact(spark: SparkSession, path: str, target: str, rows: int) -> None:
    """Rewrites a table in files of about so many rows."""
    df = spark.read.parquet(path)
    df.repartition(max(1, -(-df.count() // rows))).write.parquet(target)


def commit(df: DataFrame, path: str, operation: str = "append") -> int:
    """Adds a version to a table of versions: data in a folder of its own, then a row in the log. `append` builds on the
    version before, `overwrite` doesn't. One writer at a time."""
    spark = df.sparkSession
    number = head(spark, path) + 1
    data = f"{path}/data/{uuid.uuid4().hex}"
    df.write.parquet(data)
    spark.createDataFrame([(number, operation, data)], "version long, operation string, data string").coalesce(1).write.mode("append").parquet(f"{path}/log")
    return number


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("version long, operation string, data string").parquet(f"{path}/log")
    except AnalysisException:
        return None  # the table has no version yet


def head(spark: SparkSession, path: str) -> int:
    log = _log(spark, path)
    return (log.agg(F.max("version")).first()[0] or 0) if log is not None else 0


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the last one if none is given."""
    rows = _log(spark, path).where(F.col("version") <= (version or head(spark, path))).orderBy("version").collect()
    first = max((i for i, r in enumerate(rows) if r["operation"] == "overwrite"), default=0)
    return spark.read.option("mergeSchema", True).parquet(*[r["data"] for r in rows[first:]])


def migrate(spark: SparkSession, source: str, target: str, kind: str = "parquet") -> None:
    """Copies the last version of a table into one of another kind."""
    read_version(spark, source).write.format(kind).save(target)


#: Wrappers of extended JSON and the type of each.
WRAPPERS = {"$oid": "string", "$numberLong": "bigint", "$numberInt": "int", "$numberDouble": "double", "$numberDecimal": "decimal(38,18)", "$uuid": "string"}


def plain(c: Column, kind: T.DataType) -> Column:
    """A value of extended JSON without its wrappers."""
    if isinstance(kind, T.StructType):
        names = kind.names
        if len(names) == 1 and names[0] in WRAPPERS:
            return c[names[0]].cast(WRAPPERS[names[0]])
        if names == ["$date"]:
            inner = kind["$date"].dataType
            return F.timestamp_millis(c["$date"]["$numberLong"].cast("long")) if isinstance(inner, T.StructType) else F.timestamp_millis(c["$date"]) if isinstance(inner, T.LongType) else F.to_timestamp(c["$date"])
        if "$binary" in names:
            inner = kind["$binary"].dataType
            return F.unbase64(c["$binary"]["base64"] if isinstance(inner, T.StructType) else c["$binary"])
        if "$regex" in names:
            return c["$regex"]
        return F.when(c.isNotNull(), F.struct(*[plain(c[n], kind[n].dataType).alias(n) for n in names]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: plain(x, kind.elementType))
    return c


def read_extended_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    df = read_json(spark, path, lines)
    return df.select(*[plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


#: Types of the schema language.
TYPES = {"string": "string", "text": "string", "markdown": "string", "email": "string", "url": "string", "uuid": "string", "json": "string", "date": "string", "int": "int", "number": "double", "float": "double", "double": "double", "boolean": "boolean", "datetime": "timestamp", "timestamp": "timestamp", "binary": "binary"}


def schema_of(spec: Mapping[str, str]) -> T.StructType:
    """A schema from declarations such as `string!`, `int?`, `decimal(10,2)`, `vector(64)`, `enum(a,b)[]`."""
    import re

    fields = []
    for name, text in spec.items():
        text = text.split("=")[0].strip()
        required, text = "!" in text, re.sub(r"[!?#].*$", "", text).strip()
        many, text = text.endswith("[]"), text.removesuffix("[]")
        base = text.split("(")[0]
        kind = "array<float>" if base == "vector" else text if base == "decimal" else "decimal(18,2)" if text == "decimal" else "string" if base in ("varchar", "char", "enum") or text.startswith(("->", "<-", "~>", "<~")) else TYPES[base]
        kind = T.DataType.fromDDL(kind)
        fields.append(T.StructField(name, T.ArrayType(kind) if many else kind, not required))
    return T.StructType(fields)
