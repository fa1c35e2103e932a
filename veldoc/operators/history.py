"""Event-sourced state: as-of reads, history, diffs, replay, compaction, change rows; and merges of branches.

An event log has columns id, ts, target, op (CREATE, UPDATE, DELETE), after and others. Its order is (ts, id).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest(events: DataFrame, by: Sequence[str] = ("target",), order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """The last event of each target, by an aggregate that is combined before it is shuffled."""
    rest = [c for c in events.columns if c not in by]
    top = events.groupBy(*by).agg(F.max(F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row"))).alias("_top"))
    return top.select(*by, "_top._row.*")


def as_of(events: DataFrame, at: Column, include_deleted: bool = False) -> DataFrame:
    """The state at a time: of each target what the last event up to then left; deleted ones are left out."""
    out = latest(events.where(F.col("ts") <= at))
    return out if include_deleted else out.where(F.col("op") != "DELETE")


def history(events: DataFrame, target: object = None, since: Column | None = None, until: Column | None = None, ops: Sequence[str] | None = None, actor: str | None = None, after: tuple | None = None, limit: int = 1000) -> DataFrame:
    """Events of a target, or of all: after `since`, up to `until`; `after`: (ts, id) of the last event of the page before."""
    out = events
    if target is not None:
        out = out.where(F.col("target") == F.lit(target))
    if since is not None:
        out = out.where(F.col("ts") > since)
    if until is not None:
        out = out.where(F.col("ts") <= until)
    if ops:
        out = out.where(F.col("op").isin(list(ops)))
    if actor is not None:
        out = out.where(F.col("actor") == actor)
    if after is not None:
        out = out.where((F.col("ts") > F.lit(after[0])) | ((F.col("ts") == F.lit(after[0])) & (F.col("id") > F.lit(after[1]))))
    return out.orderBy("ts", "id").limit(limit)


def numbered(events: DataFrame) -> DataFrame:
    """Events with the version that each makes."""
    return events.withColumn("version", F.row_number().over(W.partitionBy("target").orderBy("ts", "id")))


def at_version(events: DataFrame, version: int) -> DataFrame:
    return numbered(events).where(F.col("version") == version)


def diff(events: DataFrame, t1: Column, t2: Column, fields: Sequence[str]) -> DataFrame:
    """(target, field, kind, old, new) between two times: added, removed or changed fields, as strings."""
    old, new = (as_of(events, t).select("target", *[F.col(f).cast("string").alias(f) for f in fields]).withColumn("_there", F.lit(True)) for t in (t1, t2))
    both = old.alias("o").join(new.alias("n"), F.col("o.target") == F.col("n.target"), "full_outer")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("old"), F.col(f"n.{f}").alias("new")) for f in fields]))
    rows = both.select(F.coalesce("o.target", "n.target").alias("target"), F.col("o._there").alias("was"), F.col("n._there").alias("is"), pairs.alias("x"))
    rows = rows.select("target", "was", "is", "x.*").where(~F.col("old").eqNullSafe(F.col("new")) | F.col("was").isNull() | F.col("is").isNull())
    kind = F.when(F.col("was").isNull() | F.col("old").isNull(), "added").when(F.col("is").isNull() | F.col("new").isNull(), "removed").otherwise("changed")
    return rows.select("target", "field", kind.alias("kind"), "old", "new").where(F.coalesce("old", "new").isNotNull())


def revert(events: DataFrame, target: object, at: Column, now: Column, new_id: Column) -> DataFrame:
    """The log with an UPDATE that restores a target's state at a time."""
    then = as_of(events, at).where(F.col("target") == F.lit(target)).withColumns({"ts": now, "op": F.lit("UPDATE"), "id": new_id})
    return events.unionByName(then.select(events.columns))


def replay(events: DataFrame, field: str = "after") -> DataFrame:
    """Each event with the state before it and after it."""
    order = W.partitionBy("target").orderBy("ts", "id")
    return numbered(events).withColumn("before_state", F.lag(field).over(order)).withColumn("state", F.when(F.col("op") != "DELETE", F.col(field)))


def snapshot(events: DataFrame, at: Column) -> DataFrame:
    """State to replay from: the latest event of each target, deletions too."""
    return as_of(events, at, include_deleted=True)


def from_snapshot(base: DataFrame, events: DataFrame, taken: Column, at: Column) -> DataFrame:
    newer = events.where((F.col("ts") > taken) & (F.col("ts") <= at))
    return latest(base.unionByName(newer.select(base.columns))).where(F.col("op") != "DELETE")


def compact(events: DataFrame) -> DataFrame:
    """The present state of all targets."""
    return latest(events).where(F.col("op") != "DELETE")


def retain(events: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): events from the cutoff on, and those before."""
    return events.where(F.col("ts") >= cutoff), events.where(F.col("ts") < cutoff)


def change_rows(events: DataFrame) -> DataFrame:
    """Change rows: an insert or delete each, two for an update (its image before and after)."""
    order = W.partitionBy("target").orderBy("ts", "id")
    before = F.lag("after").over(order)
    rows = events.withColumn("_before", before)
    kinds = F.when(F.col("op") == "CREATE", F.array(F.struct(F.lit("insert").alias("change"), F.col("after").alias("image")))).when(F.col("op") == "DELETE", F.array(F.struct(F.lit("delete").alias("change"), F.col("_before").alias("image")))).otherwise(F.array(F.struct(F.lit("update_preimage").alias("change"), F.col("_before").alias("image")), F.struct(F.lit("update_postimage").alias("change"), F.col("after").alias("image"))))
    return rows.select("id", "ts", "target", F.explode(kinds).alias("x")).select("id", "ts", "target", "x.*")


def merge_layers(base: DataFrame, overlay: DataFrame, key: str = "id", version: str = "v", op: str = "op") -> DataFrame:
    """Of each key the row of highest version, the overlay's if both have it; deleted rows go."""
    both = base.withColumn("_layer", F.lit(0)).unionByName(overlay.withColumn("_layer", F.lit(1)))
    return latest(both, (key,), (version, "_layer")).drop("_layer").where(F.col(op) != "d")


def conflicts(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(target, kind, ...) where both branches changed a target: create_create, delete_update or concurrent_update with
    different results."""
    a, b = latest(ours).alias("a"), latest(theirs).alias("b")
    both = a.join(b, F.col("a.target") == F.col("b.target"))
    kind = F.when((F.col("a.op") == "DELETE") & (F.col("b.op") == "DELETE"), None).when((F.col("a.op") == "DELETE") | (F.col("b.op") == "DELETE"), "delete_update").when(~F.col("a.after").eqNullSafe(F.col("b.after")), F.when((F.col("a.op") == "CREATE") & (F.col("b.op") == "CREATE"), "create_create").otherwise("concurrent_update"))
    out = both.select(F.col("a.target").alias("target"), kind.alias("kind"), F.col("a.ts").alias("our_ts"), F.col("b.ts").alias("their_ts"), F.col("a.after").alias("ours"), F.col("b.after").alias("theirs"), F.col("a.op").alias("our_op"), F.col("b.op").alias("their_op"))
    return out.where("kind is not null")


def resolve(found: DataFrame, how: str = "latest") -> DataFrame:
    """Each conflict with what it becomes: ours, theirs or the later one (ours on a tie); manual leaves null."""
    pick = {"ours": F.lit(True), "theirs": F.lit(False), "latest": F.col("our_ts") >= F.col("their_ts")}
    if how == "manual":
        return found.withColumns({"resolved": F.lit(None).cast("string"), "side": F.lit(None).cast("string")})
    ours = pick[how]
    return found.withColumns({"resolved": F.when(ours, F.col("ours")).otherwise(F.col("theirs")), "side": F.when(ours, "ours").otherwise("theirs")})


def merge_branches(ours: DataFrame, theirs: DataFrame, how: str = "latest") -> DataFrame:
    """State after both branches: each target's latest event, conflicts resolved as told."""
    made = resolve(conflicts(ours, theirs), how).select(F.col("target").alias("_t"), F.col("side"))
    a, b = latest(ours).withColumn("_side", F.lit("ours")), latest(theirs).withColumn("_side", F.lit("theirs"))
    both = a.unionByName(b)
    out = both.join(made, both["target"] == made["_t"], "left")
    out = out.where(F.col("side").isNull() | (F.col("side") == F.col("_side")))
    return latest(out.drop("_t", "side", "_side"))


def commute(deltas: DataFrame, sums: Sequence[str] = (), sets: Sequence[str] = (), key: str = "target") -> DataFrame:
    """Operations of both branches that commute: increments add up, sets unite."""
    aggs = [F.sum(c).alias(c) for c in sums] + [F.array_sort(F.collect_set(c)).alias(c) for c in sets]
    return deltas.groupBy(key).agg(*aggs)


def schema_diff(old: Mapping[str, str], new: Mapping[str, str]) -> list[tuple[str, str, bool]]:
    """(field, change, breaking) between two schemas of name and type. A field that goes or changes its type breaks."""
    wider = {("int", "bigint"), ("int", "double"), ("bigint", "double"), ("float", "double")}
    out = [(f, "removed", True) for f in old if f not in new] + [(f, "added", False) for f in new if f not in old]
    return sorted(out + [(f, "changed", (old[f], new[f]) not in wider) for f in old if f in new and old[f] != new[f]])
