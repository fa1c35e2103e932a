"""Stream views: windows, watermarks, late rows, sinks and subscriptions on Structured Streaming. The same view can be
evaluated over a static table, which is how its results are checked."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from veldoc.operators.filters import where

TRANSFORMS = ("passthrough", "count", "sum", "avg", "min", "max", "first", "last")


class StreamError(ValueError):
    """A stream view that can't be run as defined."""


@dataclass
class Window:
    """tumbling, sliding (with slide) or session (with gap) in words of Spark intervals; global without any."""

    kind: str = "global"
    size: str = ""
    slide: str = ""
    offset: str = ""


@dataclass
class StreamView:
    name: str
    ts: str = "ts"
    filter: Mapping[str, Any] = field(default_factory=dict)
    types: Sequence[str] = ()
    type_col: str = "event_type"
    start: str | None = None  # earliest if None, else a time
    transform: str = "count"
    value: str | None = None
    keys: Sequence[str] = ()
    window: Window = field(default_factory=Window)
    lateness: str | None = None
    late: str = "drop"  # drop, update or side


def _seconds(spark: SparkSession, text: str) -> float:
    return float(spark.range(1).select(F.expr(f"(unix_micros(timestamp'2000-01-01' + interval {text}) - unix_micros(timestamp'2000-01-01')) / 1e6").alias("s")).first()["s"])


def validate(view: StreamView, spark: SparkSession | None = None) -> list[str]:
    """What is wrong with a definition."""
    out = []
    if not view.name:
        out.append("no name")
    if view.transform not in TRANSFORMS:
        out.append(f"unknown transform {view.transform}")
    if view.transform in ("sum", "avg", "min", "max", "first", "last") and not view.value:
        out.append(f"{view.transform} needs a field")
    if view.window.kind not in ("tumbling", "sliding", "session", "global"):
        out.append(f"unknown window {view.window.kind}")
    if view.window.kind in ("tumbling", "sliding", "session") and not view.window.size:
        out.append("window without size")
    if view.window.kind == "sliding" and not view.window.slide:
        out.append("sliding window without slide")
    if spark and view.window.kind == "sliding" and view.window.slide and _seconds(spark, view.window.slide) > _seconds(spark, view.window.size):
        out.append("slide beyond size")
    if view.late not in ("drop", "update", "side"):
        out.append(f"unknown late policy {view.late}")
    if view.late == "side" and not view.lateness:
        out.append("side output needs a lateness")
    return out


def window_of(view: StreamView) -> Column | None:
    w, ts = view.window, F.col(view.ts)
    if w.kind == "tumbling":
        return F.window(ts, w.size, w.size, w.offset) if w.offset else F.window(ts, w.size)
    if w.kind == "sliding":
        return F.window(ts, w.size, w.slide, w.offset) if w.offset else F.window(ts, w.size, w.slide)
    return F.session_window(ts, w.size) if w.kind == "session" else None


def selected(view: StreamView, df: DataFrame) -> DataFrame:
    """The rows of a source that a view takes; times become instants, as watermarks want them."""
    out = df.withColumn(view.ts, F.col(view.ts).cast("timestamp"))
    out = out.where(F.col(view.type_col).isin(list(view.types))) if view.types else out
    out = out.where(F.col(view.ts) >= F.lit(view.start).cast("timestamp")) if view.start else out
    return where(out, view.filter)


def evaluated(view: StreamView, df: DataFrame) -> DataFrame:
    """The view's rows over a table or a stream."""
    problems = validate(view)
    if problems:
        raise StreamError("; ".join(problems))
    out = selected(view, df)
    if out.isStreaming and view.lateness and view.late != "update":
        out = out.withWatermark(view.ts, view.lateness)
    if view.transform == "passthrough":
        return out
    v = F.col(view.value) if view.value else None
    agg = {"count": lambda: F.count("*"), "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "min": lambda: F.min(v), "max": lambda: F.max(v), "first": lambda: F.min_by(v, F.col(view.ts)), "last": lambda: F.max_by(v, F.col(view.ts))}[view.transform]().alias("value")
    w = window_of(view)
    if w is None:
        return out.groupBy(*view.keys).agg(agg) if view.keys else out.groupBy().agg(agg)
    return out.groupBy(w.alias("w"), *view.keys).agg(agg).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *view.keys, "value")


def run(view: StreamView, source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", now: bool = True) -> StreamingQuery:
    """Starts a view whose batches go to `sink`; `now`: reads what there is and ends. The checkpoint lets it go on after
    a stop, so a paused view is a stopped one."""
    writer = evaluated(view, source).writeStream.outputMode(mode if view.transform != "passthrough" else "append").foreachBatch(sink).option("checkpointLocation", checkpoint).queryName(view.name)
    return (writer.trigger(availableNow=True) if now else writer).start()


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch in a folder of its own, so a batch that is run again replaces itself."""
    return lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch:09d}")


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """What an upsert sink shows: of each key the row of the last batch."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in keys and c != "batch"]
    top = df.groupBy(*keys).agg(F.max(F.struct("batch", F.struct(*rest).alias("row"))).alias("top"))
    return top.select(*keys, "top.row.*")


def split_late(df: DataFrame, ts: str, newest: Column, lateness: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late) of a batch: late rows are older than the newest time seen less the lateness."""
    edge = newest - F.expr(f"interval {lateness}")
    return df.where(F.col(ts) >= edge), df.where(F.col(ts) < edge)


def side_output(view: StreamView, path: str, late_path: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends late rows elsewhere. The newest time seen stands in a table beside the late rows, so it is
    there after a restart."""

    def sink(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df = df.persist()
        seen = [r["newest"] for r in (spark.read.parquet(f"{late_path}/newest").collect() if batch else [])]
        own = df.agg(F.max(view.ts)).first()[0]
        newest = max([x for x in [*seen, own] if x is not None], default=None)
        if newest is not None:
            on_time, late = split_late(df, view.ts, F.lit(max(seen, default=own)), view.lateness or "0 seconds")
            on_time.write.mode("overwrite").parquet(f"{path}/batch={batch:09d}")
            late.write.mode("overwrite").parquet(f"{late_path}/rows/batch={batch:09d}")
            spark.createDataFrame([(newest,)], "newest timestamp").coalesce(1).write.mode("append").parquet(f"{late_path}/newest")
        df.unpersist()

    return sink


def subscription(df: DataFrame, spec: Mapping[str, Any] | None = None, ops: Sequence[str] = (), after: tuple | None = None, op_col: str = "event_type", order: tuple[str, str] = ("ts", "event_id")) -> DataFrame:
    """Changes that a subscriber asked for, behind the position that it has reached."""
    out = where(df, spec or {})
    out = out.where(F.col(op_col).isin(list(ops))) if ops else out
    if after is not None:
        ts, key = order
        out = out.where((F.col(ts) > F.lit(after[0])) | ((F.col(ts) == F.lit(after[0])) & (F.col(key) > F.lit(after[1]))))
    return out


def ingest(source: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Takes a stream into a table batch by batch."""
    sink = append_to(path)
    return source.writeStream.foreachBatch(lambda df, n: sink(transform(df) if transform else df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain(view: Any, source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a materialized view's mergeable state up to date with a stream: each batch writes the state before it, with
    its own partial aggregates merged in, as a table of its number. A batch that is run again writes the same."""
    from veldoc.operators.views import merge, partials

    def sink(df: DataFrame, batch: int) -> None:
        new = partials(view, df)
        state = merge(view, df.sparkSession.read.parquet(f"{path}/state-{batch - 1}"), new) if batch else new
        state.write.mode("overwrite").parquet(f"{path}/state-{batch}")

    return source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Schemas of the predefined stream collections.
COLLECTIONS = {
    "AIRequests": "requestId string, model string, provider string, promptTokens long, completionTokens long, latencyMs double, status string, timestamp timestamp",
    "Generations": "id string, requestId string, contentType string, content string, language string, timestamp timestamp",
    "TailEvents": "id string, level string, message string, script string, status int, timestamp timestamp",
    "EvalRuns": "runId string, suite string, model string, startedAt timestamp, finishedAt timestamp",
    "EvalScores": "runId string, scorer string, score double, timestamp timestamp",
}
