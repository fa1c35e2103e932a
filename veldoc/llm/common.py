"""What the operators of this subpackage share: words as columns, keys of texts,
tables cut off from their lineage, and joins whose broadcast side is counted first."""

from __future__ import annotations

import functools
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: A word is a run of digits, ASCII letters and characters beyond ASCII; this is what stands between words.
GAP_PATTERN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. `lower` does just that where a text is ASCII, and is much
    the faster of the two there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none. (To split takes a tenth of the time of to extract.)"""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), GAP_PATTERN), "")


def text_key(text: Column) -> Column:
    """Tells the texts under one id apart; null and empty texts have the same key."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sha_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A temporary one is set only where the session has none and all runs on this
    machine; on a cluster its absence is an error, as executors wouldn't see the driver's folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        found = tempfile.mkdtemp(prefix="veldoc-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables that this process has stored.
_STORED: list[str] = []
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again: all that came of them is stored itself."""
    for t in tables:
        path = _PATHS.pop(t)
        _STORED.remove(path)
        _delete(t.sparkSession, path)


def stored(df: DataFrame, name: str = "part") -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it back: the lineage ends here,
    and an executor that is lost later costs none of the work before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STORED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that were stored so far. Results that are still to be computed from them must be written first."""
    while _STORED:
        _delete(spark, _STORED.pop())


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage, which is how Spark learns that shuffle files of stored tables serve no more.
    It deletes them then; else they'd lie on the executors' disks until the driver's memory happens to be full."""
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Makes the batches that go to Python workers small in bytes, so that very long texts don't fill their memory;
    ten thousand rows, Spark's bound, could be of any size. A session that has set the bytes itself keeps its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, size)


#: Rows and bytes that a broadcast side may have.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000


def _width(field: T.StructField) -> Column:
    """About how many bytes a column takes in a row."""
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{field.name}`").alias("x")))), F.lit(0)) + 16
    return F.lit(8)


def counted(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its rows and bytes are shown to be few, and as it is otherwise, so that the join then
    shuffles. Count only what is stored: the count reads it once more."""
    width = functools.reduce(lambda a, b: a + b, map(_width, df.schema.fields))
    rows, size = df.limit(limit + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if rows <= limit and (size or 0) <= most else df
