"""Updates, history, sources, streams, views and SQL over the given tables."""

from __future__ import annotations

import uuid
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veldoc.operators import graph as G, history as H, statistics as ST, updates as U, views as V
from veldoc.operators.filters import where
from veldoc.sources import files
from veldoc.sources.tables import table
from veldoc.sources.workspace import scratch
from veldoc.streaming import views as S


def _part(s, d):
    """Parts with the words of their name, the size null where divisible by 7."""
    return table(s, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size"), F.split("p_name", " ").alias("words"), F.struct(F.col("p_type").alias("type"), F.col("p_retailprice").alias("price")).alias("info"))


_PART = "(SELECT p_partkey, p_brand, CASE WHEN p_size % 7 <> 0 THEN p_size END AS size, string_split(p_name, ' ') AS words, p_type AS type, p_retailprice AS price FROM part)"
_HIT = "p_partkey % 2 = 0"
_SPEC = {"p_partkey": {"$mod": [2, 0]}}


def _upd(change, sql, column="size"):
    def run(s, d):
        c = F.col(column)
        out = U.update(_part(s, d), _SPEC, change)
        return out.select("p_partkey", (F.concat_ws("|", c) if out.schema[column].dataType.typeName() == "array" else c).alias("v"))

    was = "array_to_string(words, '|')" if column == "words" else column
    return run, f"SELECT p_partkey, CASE WHEN {_HIT} THEN {sql} ELSE {was} END AS v FROM {_PART}"


_w = "array_to_string({}, '|')"
QUERIES = {
    "upd_01_set": _upd({"$set": {"size": 99}}, "99"),
    "upd_01_set_nested": (lambda s, d: U.update(_part(s, d), _SPEC, {"$set": {"info.type": "new"}}).select("p_partkey", F.col("info.type").alias("v")), f"SELECT p_partkey, CASE WHEN {_HIT} THEN 'new' ELSE type END AS v FROM {_PART}"),
    "upd_02_unset": _upd({"$unset": {"size": ""}}, "NULL"),
    "upd_03_inc": _upd({"$inc": {"size": 5}}, "coalesce(size, 0) + 5"),
    "upd_04_mul": _upd({"$mul": {"size": 3}}, "coalesce(size, 0) * 3"),
    "upd_05_min": _upd({"$min": {"size": 20}}, "least(coalesce(size, 20), 20)"),
    "upd_06_max": _upd({"$max": {"size": 20}}, "greatest(coalesce(size, 20), 20)"),
    "upd_07_push": _upd({"$push": {"words": "last"}}, _w.format("list_append(words, 'last')"), "words"),
    "upd_07_push_sorted": _upd({"$push": {"words": {"$each": ["aa", "zz"], "$sort": 1, "$slice": 3}}}, _w.format("list_sort(list_concat(words, ['aa', 'zz']))[1:3]"), "words"),
    "upd_07_push_position": _upd({"$push": {"words": {"$each": ["first"], "$position": 0}}}, _w.format("list_prepend('first', words)"), "words"),
    "upd_08_pull": _upd({"$pull": {"words": {"$startsWith": "s"}}}, _w.format("list_filter(words, lambda w: NOT starts_with(w, 's'))"), "words"),
    "upd_09_pull_all": _upd({"$pullAll": {"words": ["red", "small"]}}, _w.format("list_filter(words, lambda w: w NOT IN ('red', 'small'))"), "words"),
    "upd_10_add_to_set": _upd({"$addToSet": {"words": {"$each": ["red", "new"]}}}, _w.format("list_concat(list_concat(words, CASE WHEN list_contains(words, 'red') THEN [] ELSE ['red'] END), CASE WHEN list_contains(words, 'new') THEN [] ELSE ['new'] END)"), "words"),
    "upd_11_pop": _upd({"$pop": {"words": 1}}, _w.format("words[1:len(words) - 1]"), "words"),
    "upd_11_pop_first": _upd({"$pop": {"words": -1}}, _w.format("words[2:]"), "words"),
    "upd_12_rename": (lambda s, d: U.update(_part(s, d), {}, {"$rename": {"size": "extent"}}).select("p_partkey", "size", "extent"), f"SELECT p_partkey, CAST(NULL AS INTEGER) AS size, size AS extent FROM {_PART}"),
    "upd_13_current_date": (lambda s, d: U.update(_part(s, d).withColumn("at", F.lit(None).cast("long")), _SPEC, {"$currentDate": {"at": {"$type": "timestamp"}}}, clock=F.lit("2024-01-01 00:00:00").cast("timestamp")).select("p_partkey", "at"), f"SELECT p_partkey, CASE WHEN {_HIT} THEN 1704067200000 END AS at FROM {_PART}"),
    "upd_14_set_on_insert": (lambda s, d: U.upsert(table(s, d, "nation"), table(s, d, "nation").where("n_nationkey < 3").select((F.col("n_nationkey") + 24).alias("n_nationkey"), F.upper("n_name").alias("n_name"), "n_regionkey"), "n_nationkey", {"n_regionkey": -1}), "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 24 UNION ALL SELECT n_nationkey + 24, upper(n_name), CASE WHEN n_nationkey = 0 THEN n_regionkey ELSE -1 END FROM nation WHERE n_nationkey < 3"),
    "upd_15_bit": _upd({"$bit": {"size": {"xor": 12}}}, "xor(coalesce(size, 0), 12)"),
    "upd_17_unlink": (lambda s, d: G.unlink(table(s, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")), sources=table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("src"))), "SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderstatus <> 'F'"),
    "mut_01_create": (lambda s, d: U.create(table(s, d, "nation").withColumn("version", F.lit(1)), s.range(100, 103).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name")), {"n_regionkey": 0}), "SELECT n_nationkey, n_name, n_regionkey, 1 AS version FROM nation UNION ALL SELECT CAST(i AS INTEGER), 'N' || i, 0, 1 FROM (SELECT unnest(range(100, 103)) AS i)"),
    "mut_02_expected_version": (lambda s, d: U.update_expected(table(s, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 3).cast("int").alias("version")), {"c_acctbal": {"$gt": 0}}, {"$set": {"c_acctbal": 0.0}}, 1), "SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_custkey % 3 = 1 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CAST(CASE WHEN c_acctbal > 0 AND c_custkey % 3 = 1 THEN 2 ELSE c_custkey % 3 END AS INTEGER) AS version FROM customer"),
    "mut_03_delete": (lambda s, d: U.delete(table(s, d, "customer"), {"c_acctbal": {"$lt": 0}}, hard=True).select("c_custkey"), "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0)"),
    "mut_03_soft_delete": (lambda s, d: U.delete(table(s, d, "customer"), {"c_acctbal": {"$lt": 0}}, clock=F.lit("2024-01-01").cast("timestamp")).select("c_custkey", F.col("deletedAt").isNotNull().alias("gone")), "SELECT c_custkey, c_acctbal < 0 AS gone FROM customer"),
    "mut_03_restore": (lambda s, d: U.restore(U.delete(table(s, d, "customer"), {"c_acctbal": {"$lt": 0}}), {"c_custkey": {"$lt": 500}}).where("deletedAt is not null").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND c_custkey >= 500"),
    "mut_04_upsert": (lambda s, d: U.upsert(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), table(s, d, "supplier").where("s_suppkey < 5").select((F.col("s_suppkey") * 2).alias("s_suppkey"), F.lit(0.0).alias("s_acctbal")), "s_suppkey"), "SELECT s_suppkey, CASE WHEN s_suppkey IN (SELECT s_suppkey * 2 FROM supplier WHERE s_suppkey < 5) THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier"),
    "mut_07_validation": (lambda s, d: U.violations(_part(s, d), {"size": {"required": True, "max": 45}, "p_brand": {"enum": ["Brand#11", "Brand#12"], "pattern": "^Brand#[0-9]+$"}}, "p_partkey"), f"SELECT p_partkey AS key, 'size' AS field, 'required' AS rule FROM {_PART} WHERE size IS NULL UNION ALL SELECT p_partkey, 'size', 'max' FROM {_PART} WHERE size > 45 UNION ALL SELECT p_partkey, 'p_brand', 'enum' FROM {_PART} WHERE p_brand NOT IN ('Brand#11', 'Brand#12') UNION ALL SELECT p_partkey, 'p_brand', 'pattern' FROM {_PART} WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]+$')"),
    "mut_08_unique": (lambda s, d: U.violations(table(s, d, "supplier"), {"s_nationkey": {"unique": True}}, "s_suppkey"), "SELECT s_suppkey AS key, 's_nationkey' AS field, 'unique' AS rule FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)"),
}


def _log(s, d):
    """The events as an event log: a user is the target; a signup creates, an error deletes, the rest updates."""
    op = F.when(F.col("event_type") == "signup", "CREATE").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return table(s, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("target"), op.alias("op"), F.when(op != "DELETE", F.col("props")).alias("after"), "value")


_LOG = "(SELECT event_id AS id, ts, user_id AS target, CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op, CASE WHEN event_type <> 'error' THEN props END AS after, value FROM events)"
_LAST = f"(SELECT * FROM {_LOG} WHERE ts <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) = 1)"


def _t(text):
    return F.lit(text).cast("timestamp_ntz")


def _two(s, d):
    log = _log(s, d)
    return log.where("id % 2 = 0"), log.where("id % 2 = 1")


_BR = "(SELECT * FROM {} WHERE id % 2 = {} QUALIFY row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) = 1)"
_A, _B = _BR.format(_LOG, 0), _BR.format(_LOG, 1)
_CONF = f"(SELECT a.target, CASE WHEN a.op = 'DELETE' AND b.op = 'DELETE' THEN NULL WHEN a.op = 'DELETE' OR b.op = 'DELETE' THEN 'delete_update' WHEN a.after IS DISTINCT FROM b.after THEN CASE WHEN a.op = 'CREATE' AND b.op = 'CREATE' THEN 'create_create' ELSE 'concurrent_update' END END AS kind, a.ts >= b.ts AS ours FROM {_A} a JOIN {_B} b ON a.target = b.target)"

QUERIES |= {
    "tt_01_as_of": (lambda s, d: H.as_of(_log(s, d), _t("2024-01-15")).select("target", "id", "op"), f"SELECT target, id, op FROM {_LAST} WHERE op <> 'DELETE'"),
    "tt_02_history": (lambda s, d: H.history(_log(s, d), 3, _t("2024-01-05"), _t("2024-01-20"), ["UPDATE", "CREATE"]).select("id", "op"), f"SELECT id, op FROM {_LOG} WHERE target = 3 AND ts > TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND op IN ('UPDATE', 'CREATE') ORDER BY ts, id LIMIT 1000"),
    "tt_03_at_version": (lambda s, d: H.at_version(_log(s, d), 5).select("target", "id"), f"SELECT target, id FROM {_LOG} QUALIFY row_number() OVER (PARTITION BY target ORDER BY ts, id) = 5"),
    "tt_04_diff": (lambda s, d: H.diff(_log(s, d), _t("2024-01-10"), _t("2024-01-20"), ["after"]).select("target", "field", "kind"), f"SELECT coalesce(o.target, n.target) AS target, 'after' AS field, CASE WHEN o.after IS NULL THEN 'added' WHEN n.after IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM (SELECT * FROM {_LOG} WHERE ts <= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) = 1 AND op <> 'DELETE') o FULL JOIN (SELECT * FROM {_LOG} WHERE ts <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) = 1 AND op <> 'DELETE') n ON o.target = n.target WHERE o.after IS DISTINCT FROM n.after"),
    "tt_05_revert": (lambda s, d: H.latest(H.revert(_log(s, d), 3, _t("2024-01-15"), _t("2025-01-01"), F.lit(10**9).cast("long"))).where("target = 3").select("target", "id", "after"), f"SELECT target, 1000000000 AS id, after FROM {_LAST} WHERE target = 3 AND op <> 'DELETE' UNION ALL SELECT target, id, after FROM {_LOG} WHERE target = 3 AND NOT EXISTS (SELECT 1 FROM {_LAST} WHERE target = 3 AND op <> 'DELETE') QUALIFY row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) = 1"),
    "tt_06_replay": (lambda s, d: H.replay(_log(s, d)).select("id", F.col("version").cast("long").alias("version"), "before_state"), f"SELECT id, row_number() OVER (PARTITION BY target ORDER BY ts, id) AS version, lag(after) OVER (PARTITION BY target ORDER BY ts, id) AS before_state FROM {_LOG}"),
    "tt_07_snapshot": (lambda s, d: H.from_snapshot(H.snapshot(_log(s, d), _t("2024-01-10")), _log(s, d), _t("2024-01-10"), _t("2024-01-15")).select("target", "id"), f"SELECT target, id FROM {_LAST} WHERE op <> 'DELETE'"),
    "tt_08_compaction": (lambda s, d: H.compact(_log(s, d)).select("target", "id"), f"SELECT target, id FROM (SELECT * FROM {_LOG} QUALIFY row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) = 1) WHERE op <> 'DELETE'"),
    "tt_09_retention": (lambda s, d: H.retain(_log(s, d), _t("2024-01-20"))[0].select("id"), f"SELECT id FROM {_LOG} WHERE ts >= TIMESTAMP '2024-01-20'"),
    "tt_10_change_rows": (lambda s, d: H.change_rows(_log(s, d)).select("id", "change", "image"), f"WITH b AS (SELECT *, lag(after) OVER (PARTITION BY target ORDER BY ts, id) AS before FROM {_LOG}) SELECT id, CASE op WHEN 'CREATE' THEN 'insert' WHEN 'DELETE' THEN 'delete' ELSE 'update_postimage' END AS change, CASE WHEN op = 'DELETE' THEN before ELSE after END AS image FROM b UNION ALL SELECT id, 'update_preimage', before FROM b WHERE op = 'UPDATE'"),
    "syn_01_conflicts": (lambda s, d: H.conflicts(*_two(s, d)).select("target", "kind"), f"SELECT target, kind FROM {_CONF} WHERE kind IS NOT NULL"),
    "syn_02_resolution": (lambda s, d: H.resolve(H.conflicts(*_two(s, d)), "latest").select("target", "side"), f"SELECT target, CASE WHEN ours THEN 'ours' ELSE 'theirs' END AS side FROM {_CONF} WHERE kind IS NOT NULL"),
    "syn_03_commuting": (lambda s, d: H.commute(table(s, d, "events").select(F.col("user_id").alias("target"), F.col("event_id").alias("n"), "event_type"), ["n"], ["event_type"]).select("target", "n", F.concat_ws("|", "event_type").alias("types")), "SELECT user_id AS target, CAST(sum(event_id) AS BIGINT) AS n, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS types FROM events GROUP BY 1"),
    "syn_04_merge_branches": (lambda s, d: H.merge_branches(*_two(s, d), "latest").select("target", "id"), f"SELECT target, id FROM {_LOG} QUALIFY row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) = 1"),
}


def _written(kind, read, frame, **options):
    """Writes a table of the session's shared folder in a format and reads it back."""

    def run(s, d):
        path = f"{scratch(s)}/{kind}-{uuid.uuid4().hex}"
        files.write(frame(s, d), path, kind, **options)
        return read(s, path)

    return run


def _wrapped(s, d):
    """Orders as extended JSON, read back without the wrappers."""
    path = f"{scratch(s)}/ext-{uuid.uuid4().hex}"
    df = table(s, d, "orders")
    wrap = F.to_json(F.struct(F.struct(F.format_string("%024d", "o_orderkey").alias("$oid")).alias("_id"), F.struct(F.col("o_custkey").cast("string").alias("$numberLong")).alias("customer"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("$date")).alias("at"), "o_orderstatus"))
    df.select(wrap.alias("value")).write.text(path)
    return files.read_extended_json(s, path).select("_id", "customer", F.unix_timestamp("at").alias("at"), "o_orderstatus")


def _versions(s, d):
    path = f"{scratch(s)}/versions-{uuid.uuid4().hex}"
    df = table(s, d, "nation")
    files.commit(df.where("n_nationkey < 10"), path)
    files.commit(df.where("n_nationkey between 10 and 14"), path)
    files.commit(df.where("n_nationkey >= 20"), path, "overwrite")
    return files.read_version(s, path, 2).withColumn("v", F.lit(2)).union(files.read_version(s, path).withColumn("v", F.lit(3)))


def _stream(view, mode="complete"):
    """A view over a stream that reads the events' file once and ends; its rows are those of the last batch of each key."""

    def run(s, d):
        base = f"{scratch(s)}/stream-{uuid.uuid4().hex}"
        table(s, d, "events").repartition(4).write.parquet(f"{base}/in")
        source = s.readStream.schema(table(s, d, "events").schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
        S.run(view, source, S.append_to(f"{base}/out"), f"{base}/checkpoint", mode).awaitTermination()
        keys = [*(["start", "end"] if view.window.kind != "global" else []), *view.keys]
        out = S.latest_rows(s, f"{base}/out", keys) if keys else s.read.parquet(f"{base}/out").orderBy(F.desc("batch")).limit(1).drop("batch")
        return out

    return run


def _sec(df):
    return df.withColumns({c: F.unix_timestamp(c) for c in ("start", "end")})


_tumbling = S.StreamView("tumbling", window=S.Window("tumbling", "1 day"), keys=["event_type"], transform="count", lateness="30 days")
_sliding = S.StreamView("sliding", window=S.Window("sliding", "2 days", "1 day"), transform="max", value="value")
_session = S.StreamView("sessions", window=S.Window("session", "6 hours"), keys=["user_id"], transform="count")
_global = S.StreamView("totals", keys=["event_type"], transform="count", types=["click", "view"])


def _stored_view(s, d):
    path = f"{scratch(s)}/view-{uuid.uuid4().hex}"
    view = V.View("v", "orders", group={"status": "$o_orderstatus"}, aggregates={"n": {"$count": "*"}})
    tables = {"orders": table(s, d, "orders")}
    V.refresh(V.evaluate(view, tables).where("n < 0"), path)
    V.refresh(V.evaluate(view, tables), path)
    return V.read(s, path)


def _rewritten(s, d):
    fine = V.View("fine", "orders", group={"status": "$o_orderstatus", "priority": "$o_orderpriority"}, aggregates={"n": {"$count": "*"}, "most": {"$max": "$o_totalprice"}})
    asked = V.View("asked", "orders", group={"status": "$o_orderstatus"}, aggregates={"orders": {"$count": "*"}, "top": {"$max": "$o_totalprice"}})
    stored = V.evaluate(fine, {"orders": table(s, d, "orders")})
    name = V.plan(asked, {"fine": (fine, 15, "fresh")}, 10_000)
    return V.rewritten(asked, {"fine": fine}[name], stored)


def _sql(query, **args):
    def run(s, d):
        for name in ("orders", "customer", "lineitem", "nation"):
            table(s, d, name).createOrReplaceTempView(f"veldoc_{name}")
        return s.sql(query, args=args) if args else s.sql(query)

    return run


@F.pandas_udf(StringType())
def _label(kind: pd.Series, event: pd.Series) -> pd.Series:
    return kind.str.upper() + ":" + event.astype(str)


def _callbacks(s, d):
    """A callback on the first event of each user: an aggregate finds the event, so no user's events meet in one frame."""
    first = table(s, d, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("e"))
    return first.select("user_id", "e.event_id", _label("e.event_type", "e.event_id").alias("label"))


_SEL = "SELECT c_custkey, c_name FROM {}customer WHERE (c_mktsegment = 'BUILDING' OR c_nationkey IN (1, 2)) AND c_acctbal >= {} AND c_name LIKE '%1%' ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 2"
_AGG = "SELECT n_name, count(*) AS n, max(c_acctbal) AS top FROM {0}customer JOIN {0}nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 3"

QUERIES |= {
    "src_01_parquet": (lambda s, d: files.read_parquet(s, f"{d}/part.parquet", {"p_size": {"$gt": 40}}, ["p_partkey", "p_size"]), "SELECT p_partkey, p_size FROM part WHERE p_size > 40"),
    "src_05_query_scan": (lambda s, d: files.read_parquet(s, f"{d}/orders.parquet", {"o_orderstatus": "P"}, ["o_orderkey"]), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "src_06_scan_aggregates": (lambda s, d: where(table(s, d, "orders"), {"o_orderstatus": "F"}).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 6).alias("mean")), "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_orderstatus = 'F'"),
    "src_04_file_metadata": (lambda s, d: table(s, d, "orders").select("_metadata.file_name").groupBy("file_name").agg(F.count("*").alias("n")), "SELECT 'orders.parquet' AS file_name, count(*) AS n FROM orders"),
    "src_07_json_lines": (_written("json", lambda s, p: files.read_json(s, p).select("n_nationkey", "n_name"), lambda s, d: table(s, d, "nation")), "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"),
    "src_08_csv": (_written("csv", lambda s, p: s.read.csv(p, schema="p_partkey long, p_name string, p_retailprice double", escape='"', ignoreTrailingWhiteSpace=False), lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit('"'), "p_name", F.lit('", ')).alias("p_name"), "p_retailprice")), "SELECT p_partkey, '\"' || p_name || '\", ' AS p_name, p_retailprice FROM part"),
    "src_10_extended_json": (_wrapped, "SELECT lpad(CAST(o_orderkey AS VARCHAR), 24, '0') AS _id, o_custkey AS customer, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS at, o_orderstatus FROM orders"),
    "src_12_table_versions": (_versions, "SELECT *, 2 AS v FROM nation WHERE n_nationkey < 15 UNION ALL SELECT *, 3 AS v FROM nation WHERE n_nationkey >= 20"),
    "src_14_write_partitioned": (_written("parquet", lambda s, p: s.read.parquet(p).where("o_orderstatus = 'P'").select("o_orderkey"), lambda s, d: table(s, d, "orders"), partition_by=["o_orderstatus"], codec="zstd"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "src_16_export_json": (lambda s, d: table(s, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("line")), "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS line FROM nation"),
    "src_17_prometheus": (lambda s, d: ST.prometheus(table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "events_total", ["event_type"], "n"), "SELECT 'events_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type"),
    "src_21_event_range": (lambda s, d: _log(s, d).where((F.col("ts") >= _t("2024-01-10")) & (F.col("ts") < _t("2024-01-12"))).select("id"), f"SELECT id FROM {_LOG} WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'"),
    "str_01_tumbling": (lambda s, d: _sec(S.evaluated(_tumbling, table(s, d, "events"))), "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 86400 AS \"end\", event_type, count(*) AS value FROM events GROUP BY ALL"),
    "str_01_tumbling_stream": (lambda s, d: _sec(_stream(_tumbling, "update")(s, d)), "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, CAST(epoch(date_trunc('day', ts)) AS BIGINT) + 86400 AS \"end\", event_type, count(*) AS value FROM events GROUP BY ALL"),
    "str_02_sliding": (lambda s, d: _sec(S.evaluated(_sliding, table(s, d, "events"))), "SELECT start, start + 172800 AS \"end\", max(value) AS value FROM (SELECT value, CAST(epoch(date_trunc('day', ts)) AS BIGINT) - 86400 * k AS start FROM events, (SELECT unnest(range(0, 2)) AS k)) GROUP BY start"),
    "str_03_session": (lambda s, d: S.evaluated(_session, table(s, d, "events")).select(F.unix_timestamp("start").alias("start"), "user_id", "value"), "SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS start, user_id, count(*) AS value FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session"),
    "str_04_global_stream": (_stream(_global), "SELECT event_type, count(*) AS value FROM events WHERE event_type IN ('click', 'view') GROUP BY 1"),
    "str_05_source_filter": (lambda s, d: S.selected(S.StreamView("v", types=["click"], start="2024-01-20", filter={"value": {"$gt": 10}}), table(s, d, "events")).select("event_id"), "SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-20' AND value > 10"),
    "str_09_late_rows": (lambda s, d: S.split_late(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.lit("2024-01-30").cast("timestamp"), "10 days")[1].select("event_id"), "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20'"),
    "sub_01_subscription": (lambda s, d: S.subscription(table(s, d, "events"), {"user_id": {"$lt": 5}}, ["click", "error"], (datetime(2024, 1, 15), 0)).select("event_id"), "SELECT event_id FROM events WHERE user_id < 5 AND event_type IN ('click', 'error') AND (ts > TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id > 0))"),
    "mv_02_full_refresh": (_stored_view, "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1"),
    "mv_08_rewrite": (_rewritten, "SELECT o_orderstatus AS status, count(*) AS orders, max(o_totalprice) AS top FROM orders GROUP BY 1"),
    "sql_01_select": (_sql(_SEL.format("veldoc_", 100)), _SEL.format("", 100)),
    "sql_02_parameters": (_sql("SELECT o_orderkey FROM veldoc_orders WHERE o_orderstatus = :status AND o_totalprice BETWEEN :low AND 200000 AND o_orderpriority ILIKE '%urgent%'", status="F", low=50000), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 50000 AND 200000 AND o_orderpriority ILIKE '%urgent%'"),
    "sql_03_join_group": (_sql(_AGG.format("veldoc_")), _AGG.format("")),
    "sql_04_update": (lambda s, d: U.update(table(s, d, "customer").select("c_custkey", "c_mktsegment"), {"c_custkey": {"$lt": 100}}, {"$set": {"c_mktsegment": "NONE"}}), "SELECT c_custkey, CASE WHEN c_custkey < 100 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "udf_01_callbacks": (_callbacks, "SELECT user_id, event_id, upper(event_type) || ':' || event_id AS label FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"),
}
