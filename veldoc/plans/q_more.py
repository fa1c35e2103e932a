"""Further queries: sources, indexes inside find, refreshes and sinks."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Window as W, functions as F

from veldoc.functions import geo, vectors
from veldoc.operators import faceted, find as fnd, fulltext, graph as G, history as H, pipeline as P, quantise, statistics as ST, updates as U, views as V
from veldoc.operators.filters import where
from veldoc.plans.q_documents import _LOG, _log, _sql, _stream, _versions
from veldoc.plans.q_search import _GEO, _HAV, _bm25, _geo, _ix, _knn, _query_vector
from veldoc.sources import files
from veldoc.sources.tables import table
from veldoc.sources.workspace import scratch
from veldoc.streaming import views as S

_view = V.View("v", "orders", group={"status": "$o_orderstatus"}, aggregates={"n": {"$count": "*"}, "total": {"$sum": "$o_totalprice"}, "mean": {"$avg": "$o_totalprice"}})
_VIEW = "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1"


def _rounded(df):
    return df.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


def _base(s, name):
    return f"{scratch(s)}/{name}-{uuid.uuid4().hex}"


def _json_import(s, d):
    base = _base(s, "json")
    table(s, d, "customer").select(F.to_json(F.struct("c_custkey", "c_name", F.array("c_mktsegment").alias("tags"))).alias("value")).write.text(base)
    return files.read_json(s, base).select("c_custkey", F.element_at("tags", 1).alias("tag"))


def _typed(s, d):
    base = _base(s, "typed")
    schema = files.schema_of({"n_nationkey": "int!", "n_name": "string", "n_regionkey": "double"})
    files.write(table(s, d, "nation").select(*[F.col(f.name).cast(f.dataType) for f in schema]), base)
    return s.read.schema(schema).parquet(base)


def _codecs(s, d):
    out = None
    for codec in ("snappy", "gzip", "zstd", "lz4"):
        base = _base(s, codec)
        files.write(table(s, d, "supplier").select("s_suppkey"), base, codec=codec)
        one = s.read.parquet(base).agg(F.lit(codec).alias("codec"), F.sum("s_suppkey").alias("total"))
        out = one if out is None else out.union(one)
    return out


def _ingested(s, d):
    base = _base(s, "ingest")
    table(s, d, "events").repartition(3).write.parquet(f"{base}/in")
    source = s.readStream.schema(table(s, d, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    S.ingest(source, f"{base}/out", f"{base}/checkpoint", lambda df: df.where("value > 50").select("event_id", "value")).awaitTermination()
    return s.read.parquet(f"{base}/out").select("event_id")


def _migrated(s, d):
    base = _base(s, "migrate")
    files.commit(table(s, d, "region"), base)
    files.migrate(s, base, f"{base}-orc", "orc")
    return s.read.orc(f"{base}-orc")


def _maintained(s, d):
    base = _base(s, "maintain")
    table(s, d, "orders").repartition(3).write.parquet(f"{base}/in")
    source = s.readStream.schema(table(s, d, "orders").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    q = S.maintain(_view, source, f"{base}/state", f"{base}/checkpoint")
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    return _rounded(V.finished(_view, s.read.parquet(f"{base}/state/state-{last}")))


def _progress(s, d):
    """What a stream view that was stopped and started again has read, by run."""
    base, view = _base(s, "progress"), S.StreamView("p", transform="passthrough")
    events = table(s, d, "events")
    runs = []
    for n, part in enumerate((events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"))):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
        source = s.readStream.schema(events.schema).parquet(f"{base}/in")
        q = S.run(view, source, S.append_to(f"{base}/out"), f"{base}/checkpoint", "append")
        q.awaitTermination()
        runs.append((n, sum(p["numInputRows"] for p in q.recentProgress)))
    return s.createDataFrame(runs, "run int, read long")


def _late(s, d):
    """A watermark over three batches in the order of time: nothing comes late, so all windows are whole."""
    view = S.StreamView("w", window=S.Window("tumbling", "1 day"), transform="sum", value="value", lateness="60 days")
    return _stream(view, "update")(s, d).select(F.date_format("start", "yyyy-MM-dd").alias("day"), F.round("value", 4).alias("value"))


def _transforms(s, d):
    out = None
    for how in ("count", "sum", "avg", "min", "max", "first", "last"):
        one = S.evaluated(S.StreamView("t", transform=how, value=None if how == "count" else "value", keys=["event_type"]), table(s, d, "events"))
        one = one.select("event_type", F.lit(how).alias("how"), F.round(F.col("value").cast("double"), 4).alias("value"))
        out = one if out is None else out.union(one)
    return out


def _linked(s, d):
    edges = table(s, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return G.link(edges, s.range(1, 20).select(F.col("id").alias("src"), F.col("id").alias("dst")), table(s, d, "customer"), "c_custkey")


def _bulk(s, d):
    df = table(s, d, "supplier").select("s_suppkey", "s_acctbal")
    df = U.create(df, s.range(900, 903).select(F.col("id").alias("s_suppkey")), {"s_acctbal": 1.0})
    df = U.update(df, {"s_suppkey": {"$lt": 10}}, {"$mul": {"s_acctbal": 2.0}})
    return U.delete(df, {"s_suppkey": {"$mod": [3, 0]}}, hard=True)


def _quantised(s, d):
    df = table(s, d, "embeddings")
    books = quantise.codebooks(df, 8, 16)
    return quantise.search(quantise.encoded(df, books), books, _query_vector(s, d), 10).select("vec_id", "distance")


def _hybrid(s, d):
    words = fulltext.search(_ix(s, d), "thing", 30).select("doc", "score")
    near = vectors.top_k(table(s, d, "embeddings"), _query_vector(s, d), 30).select(F.col("vec_id").alias("doc"), "score")
    return faceted.fused(words, near).orderBy(F.desc("score"), "doc").limit(10).select("doc", F.round("score", 8).alias("score"))


def _strategies(s, d):
    """How to search under filters of growing share, label <= most: one row for each, counted in one pass and a window
    over the labels, which are few."""
    counts = table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    below = F.sum("n").over(W.orderBy("label"))
    return counts.select(F.col("label").alias("most"), vectors.strategy_of(below, F.sum("n").over(W.partitionBy(F.lit(1))), 10).alias("how"))


def _former(s, d):
    """A search in the former form of vector filters."""
    spec = vectors.normalised_search({"$near": _query_vector(s, d), "$k": 7, "$field": "embedding", "$minScore": 0.1})
    out = vectors.top_k(table(s, d, "embeddings"), spec["query"], spec["topK"], vector=spec["field"])
    return out.where(F.col("score") >= spec["minScore"]).select("vec_id", F.round("score", 6).alias("score"))


def _states(s, d):
    """Each user's events as a view that a `view` event has refreshed: its changes since, and its state."""
    events = table(s, d, "events")
    made = events.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("made"))
    changes = events.join(made, "user_id").groupBy("user_id", "made").agg(F.count(F.when(F.col("ts") > F.col("made"), 1)).alias("changes"))
    state = V.staleness_of(F.col("made"), F.col("now"), F.col("changes"), timedelta(days=3), timedelta(days=1), 5)
    return changes.join(F.broadcast(events.agg(F.max("ts").alias("now")))).select("user_id", "changes", state.alias("state"))


_NEAR20 = "(SELECT vec_id FROM (SELECT vec_id, list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS dist FROM embeddings) ORDER BY dist, vec_id LIMIT 20)"

QUERIES = {
    "src_02_partitions": (lambda s, d: table(s, d, "orders").withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n")), "SELECT CAST(count(*) AS BIGINT) AS n FROM orders"),
    "src_03_row_groups": (lambda s, d: where(table(s, d, "lineitem"), {"l_orderkey": {"$lte": 50}}).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey <= 50"),
    "src_09_json": (_json_import, "SELECT c_custkey, c_mktsegment AS tag FROM customer"),
    "src_11_table_backend": (lambda s, d: fnd.find(table(s, d, "supplier"), {"s_nationkey": {"$in": [1, 2, 3]}}, {"s_suppkey": 1}).select("s_suppkey", "s_name"), "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 2, 3)"),
    "src_13_commit_log": (_versions, "SELECT *, 2 AS v FROM nation WHERE n_nationkey < 15 UNION ALL SELECT *, 3 AS v FROM nation WHERE n_nationkey >= 20"),
    "src_15_typed_write": (_typed, "SELECT n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation"),
    "src_18_ingest": (_ingested, "SELECT event_id FROM events WHERE value > 50"),
    "src_20_codecs": (_codecs, "SELECT codec, CAST(sum(s_suppkey) AS BIGINT) AS total FROM supplier, (VALUES ('snappy'), ('gzip'), ('zstd'), ('lz4')) AS c(codec) GROUP BY 1"),
    "src_22_migration": (_migrated, "SELECT * FROM region"),
    "flt_28_vector_in_find": (lambda s, d: table(s, d, "embeddings").join(vectors.top_k(table(s, d, "embeddings"), _query_vector(s, d), 20).select("vec_id"), "vec_id", "left_semi").where("label < 6").select("vec_id"), f"SELECT vec_id FROM embeddings WHERE label < 6 AND vec_id IN {_NEAR20}"),
    "flt_29_geo_in_find": (lambda s, d: table(s, d, "customer").join(geo.near(_geo(s, d), 10.0, 20.0, 4_000_000.0, limit=10**6).select(F.col("id").alias("c_custkey")), "c_custkey", "left_semi").where("c_acctbal > 0").select("c_custkey"), f"SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT id FROM (SELECT id, {_HAV} AS dist FROM {_GEO}) WHERE dist <= 4000000)"),
    "fnd_08_hybrid_search": (_hybrid, f"{_bm25([('thing', 1)])}, t AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS r FROM sc ORDER BY score DESC, doc LIMIT 30), v AS (SELECT vec_id AS doc, row_number() OVER (ORDER BY dist, vec_id) AS r FROM (SELECT vec_id, list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS dist FROM embeddings) ORDER BY dist, vec_id LIMIT 30) SELECT doc, round(x, 8) AS score FROM (SELECT coalesce(t.doc, v.doc) AS doc, coalesce(0.5 / (60 + t.r), 0.0) + coalesce(0.5 / (60 + v.r), 0.0) AS x FROM t FULL JOIN v ON t.doc = v.doc) ORDER BY x DESC, doc LIMIT 10"),
    "fnd_09_explain": (lambda s, d: s.createDataFrame(P.explain(table(s, d, "orders"), [{"$match": {"o_orderstatus": "F"}}, {"$group": {"_id": "$o_orderpriority", "n": {"$sum": 1}}}, {"$limit": 3}]), "stage string, n long"), "SELECT '$match' AS stage, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT '$group', count(DISTINCT o_orderpriority) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT '$limit', 3"),
    "exp_25_cost": (lambda s, d: ST.costs(table(s, d, "events").select(F.col("event_type").alias("model"), (F.col("event_id") % 10).alias("a"), (F.col("event_id") % 7).alias("b")), s.createDataFrame([("view", 2.0, 4.0)], "model string, price_in double, price_out double"), ["model"], "a", "b").select("model", F.round("cost", 6).alias("cost")), "SELECT event_type AS model, round(sum(CASE WHEN event_type = 'view' THEN (event_id % 10) * 2.0 / 1000 + (event_id % 7) * 4.0 / 1000 ELSE 0.0::DOUBLE END), 6) AS cost FROM events GROUP BY 1"),
    "exp_29_vector_scores": (lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(vectors.squared_distance(F.col("embedding"), vectors.normalised(F.col("embedding"))), 5).alias("d")), "SELECT vec_id, round(pow(list_distance(e, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))), 2), 5) AS d FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"),
    "win_01_latest": (lambda s, d: H.latest(_log(s, d)).select("target", "id", "op"), f"SELECT target, id, op FROM {_LOG} QUALIFY row_number() OVER (PARTITION BY target ORDER BY ts DESC, id DESC) = 1"),
    "win_02_versions": (lambda s, d: H.numbered(_log(s, d)).select("id", F.col("version").cast("long").alias("version")), f"SELECT id, row_number() OVER (PARTITION BY target ORDER BY ts, id) AS version FROM {_LOG}"),
    "win_06_baseline": (lambda s, d: ST.anomalies(table(s, d, "events"), "event_type", ["ts", "event_id"], "value", 30).where("anomalous").select("event_id"), "SELECT event_id FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) WHERE sd > 0 AND abs((value - m) / sd) > 3"),
    "srt_05_engine_sort": (lambda s, d: P.sort(table(s, d, "nation"), {"n_regionkey": "desc", "n_name": "asc"}).select("n_nationkey"), "SELECT n_nationkey FROM nation ORDER BY n_regionkey DESC, n_name"),
    "svc_18_service_sort": (lambda s, d: P.sort(table(s, d, "part").withColumn("x", F.when(F.col("p_size") > 5, F.col("p_size"))), {"x": -1, "p_partkey": 1}, "view").limit(30).select("p_partkey"), "SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_size END AS x FROM part) ORDER BY x DESC NULLS FIRST, p_partkey LIMIT 30"),
    "svc_20_fields": (lambda s, d: fnd.projected(table(s, d, "part"), {"p_partkey": 1, "p_size": 1}), "SELECT p_partkey, p_size FROM part"),
    "svc_22_highlight": (lambda s, d: table(s, d, "part").select("p_partkey", fulltext.highlight(F.col("p_name"), "red", "<mark>", "</mark>").alias("h")), "SELECT p_partkey, regexp_replace(p_name, '(?i)\\b(red)\\b', '<mark>\\1</mark>', 'g') AS h FROM part"),
    "svc_25_vector_candidates": (lambda s, d: vectors.filtered_top_k(table(s, d, "embeddings"), _query_vector(s, d), 5, F.col("vec_id") % 3 == 0, "pre", "dot").select("vec_id", F.round("score", 6).alias("score")), "SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings WHERE vec_id % 3 = 0) ORDER BY s DESC, vec_id LIMIT 5"),
    "vec_06_nearest": _knn("cosine"),
    "vec_09_strategy": (_strategies, "SELECT most, CASE WHEN n < 20 THEN 'pre' WHEN n > 0.8 * total AND total > 1000 THEN 'post' ELSE 'pre' END AS how FROM (SELECT m AS most, count(*) FILTER (label <= m) AS n, count(*) AS total FROM embeddings, (SELECT DISTINCT label AS m FROM embeddings) GROUP BY 1)"),
    "vec_12_former_form": (_former, "SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, 1 - list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 7) WHERE score >= 0.1"),
    "svc_23_templates": (lambda s, d: faceted.by_template(table(s, d, "orders").withColumnRenamed("o_orderdate", "date"), "recent", ties="o_orderkey").select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 20"),
    "mv_06_staleness": (_states, "WITH v AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS made FROM events GROUP BY 1), c AS (SELECT user_id, made, count(*) FILTER (ts > made) AS changes FROM events JOIN v USING (user_id) GROUP BY 1, 2), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, changes, CASE WHEN made IS NULL THEN 'invalid' WHEN now - made > INTERVAL 3 DAY OR changes >= 5 THEN 'stale' WHEN now - made > INTERVAL 2 DAY THEN 'warning' ELSE 'fresh' END AS state FROM c, n"),
    "vec_10_product_quantisation": (_quantised, None),
    "vec_13_vector_table": (lambda s, d: (files.write(table(s, d, "embeddings"), p := _base(s, "vectors"), sort_by=["vec_id"]), vectors.top_k(s.read.parquet(p), _query_vector(s, d), 10))[1].select("vec_id"), "SELECT vec_id FROM (SELECT vec_id, list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS dist FROM embeddings) ORDER BY dist, vec_id LIMIT 10"),
    "upd_16_link": (_linked, "SELECT o_orderkey AS src, o_custkey AS dst FROM orders UNION SELECT c_custkey, c_custkey FROM customer WHERE c_custkey BETWEEN 1 AND 19"),
    "mut_05_bulk": (_bulk, "SELECT s_suppkey, CASE WHEN s_suppkey < 10 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM (SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT i, 1.0 FROM (SELECT unnest(range(900, 903)) AS i)) WHERE s_suppkey % 3 <> 0"),
    "tt_11_table_snapshots": (_versions, "SELECT *, 2 AS v FROM nation WHERE n_nationkey < 15 UNION ALL SELECT *, 3 AS v FROM nation WHERE n_nationkey >= 20"),
    "sql_06_values": (_sql("SELECT o_orderkey FROM veldoc_orders WHERE o_custkey = :customer AND o_orderdate >= :since", customer=7, since="1996-01-01"), "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderdate >= TIMESTAMP '1996-01-01'"),
    "mv_03_chunked": (lambda s, d: _rounded(V.finished(_view, V.merge(_view, *[V.partials(_view, table(s, d, "orders").where(f"o_orderkey % 4 = {i}")) for i in range(4)]))), _VIEW),
    "mv_04_incremental": (lambda s, d: _rounded(V.finished(_view, V.refreshed(_view, V.partials(_view, table(s, d, "orders").where("o_orderkey <= 10000")), table(s, d, "orders").where("o_orderkey <= 10000"), table(s, d, "orders").where("o_orderkey > 10000"), 0))), _VIEW),
    "mv_05_streaming_refresh": (_maintained, _VIEW),
    "str_06_transforms": (_transforms, "SELECT event_type, how, round(CASE how WHEN 'count' THEN count(*) WHEN 'sum' THEN sum(value) WHEN 'avg' THEN avg(value) WHEN 'min' THEN min(value) WHEN 'max' THEN max(value) WHEN 'first' THEN arg_min(value, ts) ELSE arg_max(value, ts) END, 4) AS value FROM events, (VALUES ('count'), ('sum'), ('avg'), ('min'), ('max'), ('first'), ('last')) AS h(how) GROUP BY 1, 2"),
    "str_07_pipeline_transform": (lambda s, d: P.run(S.selected(S.StreamView("v", types=["click", "view"]), table(s, d, "events")), [{"$group": {"_id": "$user_id", "n": {"$sum": 1}}}]), "SELECT user_id AS _id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1"),
    "str_08_watermark": (_late, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(sum(value), 4) AS value FROM events GROUP BY 1"),
    "str_10_append_sink": (lambda s, d: _progress(s, d).agg(F.sum("read").alias("read")), "SELECT count(*) AS read FROM events"),
    "str_11_progress": (_progress, "SELECT CAST(event_id % 2 AS INTEGER) AS run, count(*) AS read FROM events GROUP BY 1"),
}
