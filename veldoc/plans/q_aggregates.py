"""Groups, views' aggregates, statistics, joins and windows over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldoc.operators import faceted, graph as G, history as H, pipeline as P, statistics as S, views as V
from veldoc.operators.filters import where
from veldoc.sources.tables import table


def _li(s, d):
    """Lines, the quantity null on each third one."""
    return table(s, d, "lineitem").withColumn("q", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")))


_LI = "(SELECT *, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS q FROM lineitem)"


def _group(spec, sql, by="l_returnflag", order=None):
    def run(s, d):
        return P.run(_li(s, d), [{"$group": {"_id": f"${by}", "v": spec}}], order=order)

    return run, f"SELECT {by} AS _id, {sql} AS v FROM {_LI} GROUP BY {by}"


def _flags(s, d):
    return P.run(_li(s, d), [{"$match": {"l_shipdate": {"$lte": "1998-09-02"}}}, {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "sum_qty": {"$sum": "$l_quantity"}, "sum_base": {"$sum": "$l_extendedprice"}, "avg_qty": {"$avg": "$l_quantity"}, "avg_disc": {"$avg": "$l_discount"}, "n": {"$sum": 1}}}, {"$sort": {"_id": 1}}]).select(F.col("_id.flag").alias("l_returnflag"), F.col("_id.status").alias("l_linestatus"), F.round("sum_qty", 2).alias("sum_qty"), F.round("sum_base", 2).alias("sum_base"), F.round("avg_qty", 6).alias("avg_qty"), F.round("avg_disc", 6).alias("avg_disc"), "n")


def _facet(s, d):
    out = P.run(table(s, d, "part"), [{"$facet": {"brands": [{"$group": {"_id": "$p_brand", "n": {"$sum": 1}}}, {"$sort": {"n": -1, "_id": 1}}, {"$limit": 5}], "total": [{"$count": "n"}]}}])
    return out.select(F.to_json("brands").alias("brands"), F.to_json("total").alias("total"))


def _view(**spec):
    return lambda s, d: V.evaluate(V.View("v", "lineitem", **spec), {"lineitem": _li(s, d)}, order="l_orderkey")


def _mva(agg, sql, digits=None):
    def run(s, d):
        out = V.evaluate(V.View("v", "lineitem", group={"flag": "$l_returnflag"}, aggregates={"v": agg}), {"lineitem": _li(s, d)})
        return out.withColumn("v", F.round("v", digits)) if digits is not None else out

    return run, f"SELECT l_returnflag AS flag, {f'round({sql}, {digits})' if digits is not None else sql} AS v FROM {_LI} GROUP BY l_returnflag"


def _merged(s, d):
    view = V.View("v", "lineitem", group={"flag": "$l_returnflag"}, aggregates={"n": {"$count": "*"}, "total": {"$sum": "$l_quantity"}, "mean": {"$avg": "$q"}, "most": {"$max": "$q"}})
    df = _li(s, d)
    return V.finished(view, V.incremental(view, V.partials(view, df.where("l_orderkey % 2 = 0")), df.where("l_orderkey % 2 = 1"))).withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


def _requests(s, d):
    """Events as requests: a status, a latency and whether it was cached, from the event's id and value."""
    return table(s, d, "events").select("event_id", "user_id", "event_type", "value", (200 + (F.col("event_id") % 4) * 100).alias("status"), (F.col("event_id") % 3 == 0).alias("cached"))


_RQ = "(SELECT event_id, user_id, event_type, value, 200 + (event_id % 4) * 100 AS status, event_id % 3 = 0 AS cached FROM events)"
_P = ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99))


def _request_metrics(s, d):
    out = S.request_metrics(_requests(s, d), ["event_type"], "status", "value", "cached")
    return out.select("event_type", "total", "errors", *[F.round(c, 6).alias(c) for c in ("error_rate", "cache_ratio", "mean_latency", "min_latency", "max_latency", "p50", "p90", "p95", "p99")], F.to_json("by_status").alias("by_status"))


def _costs(s, d):
    prices = s.createDataFrame([("click", 1.0, 2.0), ("view", 0.5, 0.5)], "model string, price_in double, price_out double")
    rq = table(s, d, "events").select(F.col("event_type").alias("model"), "user_id", (F.col("event_id") % 100).alias("tin"), (F.col("event_id") % 50).alias("tout"))
    return S.costs(rq, prices, ["model"], "tin", "tout").withColumn("cost", F.round("cost", 6))


QUERIES = {
    "agg_pricing_summary": (_flags, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"),
    "agg_01_group_null_key": (lambda s, d: P.run(_li(s, d), [{"$group": {"_id": None, "n": {"$sum": 1}}}]).select("n"), "SELECT count(*) AS n FROM lineitem"),
    "agg_01_group_compound_key": (lambda s, d: P.run(_li(s, d), [{"$group": {"_id": {"a": "$l_returnflag", "b": "$l_linenumber"}, "n": {"$sum": 1}}}]).select("_id.a", "_id.b", "n"), "SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY ALL"),
    "agg_02_sum_constant": _group({"$sum": 3}, "count(*) * 3"),
    "agg_03_sum_field": (lambda s, d: P.run(_li(s, d), [{"$group": {"_id": "$l_returnflag", "v": {"$sum": "$q"}}}]).withColumn("v", F.round("v", 2)), f"SELECT l_returnflag AS _id, round(coalesce(sum(q), 0), 2) AS v FROM {_LI} GROUP BY 1"),
    "agg_04_avg_over_all_rows": (lambda s, d: P.run(_li(s, d), [{"$group": {"_id": "$l_returnflag", "v": {"$avg": "$q"}}}]).withColumn("v", F.round("v", 6)), f"SELECT l_returnflag AS _id, round(sum(coalesce(q, 0)) / count(*), 6) AS v FROM {_LI} GROUP BY 1"),
    "agg_05_max": _group({"$max": "$q"}, "max(q)"),
    "agg_06_min": _group({"$min": "$q"}, "min(q)"),
    "agg_07_first": (lambda s, d: P.run(table(s, d, "orders"), [{"$group": {"_id": "$o_orderstatus", "v": {"$first": "$o_custkey"}}}], order="o_orderkey"), "SELECT o_orderstatus AS _id, arg_min(o_custkey, o_orderkey) AS v FROM orders GROUP BY 1"),
    "agg_08_last": (lambda s, d: P.run(table(s, d, "orders"), [{"$group": {"_id": "$o_orderstatus", "v": {"$last": "$o_custkey"}}}], order="o_orderkey"), "SELECT o_orderstatus AS _id, arg_max(o_custkey, o_orderkey) AS v FROM orders GROUP BY 1"),
    "agg_09_push": (lambda s, d: P.run(table(s, d, "nation"), [{"$group": {"_id": "$n_regionkey", "v": {"$push": "$n_name"}}}], order="n_nationkey").withColumn("v", F.to_json("v")), "SELECT n_regionkey AS _id, CAST(to_json(list(n_name ORDER BY n_nationkey)) AS VARCHAR) AS v FROM nation GROUP BY 1"),
    "agg_10_add_to_set": (lambda s, d: P.run(table(s, d, "customer"), [{"$group": {"_id": "$c_nationkey", "v": {"$addToSet": "$c_mktsegment"}}}]).withColumn("v", F.concat_ws("|", "v")), "SELECT c_nationkey AS _id, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS v FROM customer GROUP BY 1"),
    "agg_11_count_accumulator": _group({"$count": {}}, "count(*)"),
    "agg_12_count_stage": (lambda s, d: P.run(table(s, d, "orders"), [{"$match": {"o_orderstatus": "none"}}, {"$count": "n"}]), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'none'"),
    "agg_13_bucket": (lambda s, d: P.run(table(s, d, "part"), [{"$bucket": {"groupBy": "$p_size", "boundaries": [0, 10, 20, 30], "default": "other", "output": {"n": {"$sum": 1}, "total": {"$sum": "$p_size"}}}}]), "SELECT CASE WHEN p_size >= 0 AND p_size < 10 THEN '0' WHEN p_size < 20 THEN '10' WHEN p_size < 30 THEN '20' ELSE 'other' END AS _id, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1"),
    "agg_14_facet": (_facet, """SELECT '[' || string_agg('{"_id":"' || p_brand || '","n":' || n || '}', ',' ORDER BY p_brand) || ']' AS brands, (SELECT '[{"n":' || count(*) || '}]' FROM part) AS total FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5)"""),
    "agg_15_sample": (lambda s, d: P.run(table(s, d, "customer"), [{"$sample": {"size": 10}}]).agg(F.count("*").alias("n")), "SELECT least(10, count(*)) AS n FROM customer"),
    "mva_01_count": _mva({"$count": "$q"}, "count(q)"),
    "mva_01_count_star": _mva({"$count": "*"}, "count(*)"),
    "mva_02_sum": _mva({"$sum": "$q"}, "coalesce(sum(q), 0)", 2),
    "mva_03_avg_of_numbers": _mva({"$avg": "$q"}, "avg(q)", 6),
    "mva_04_min": _mva({"$min": "$l_linestatus"}, "min(l_linestatus)"),
    "mva_05_max": _mva({"$max": "$l_linestatus"}, "max(l_linestatus)"),
    "mva_06_first": (lambda s, d: V.evaluate(V.View("v", "orders", group={"status": "$o_orderstatus"}, aggregates={"v": {"$first": "$o_custkey"}}), {"orders": table(s, d, "orders")}, order="o_orderkey"), "SELECT o_orderstatus AS status, arg_min(o_custkey, o_orderkey) AS v FROM orders GROUP BY 1"),
    "mva_07_last": (lambda s, d: V.evaluate(V.View("v", "orders", group={"status": "$o_orderstatus"}, aggregates={"v": {"$last": "$o_custkey"}}), {"orders": table(s, d, "orders")}, order="o_orderkey"), "SELECT o_orderstatus AS status, arg_max(o_custkey, o_orderkey) AS v FROM orders GROUP BY 1"),
    "mva_08_std_dev": _mva({"$stdDev": "$q"}, "stddev_pop(q)", 6),
    "mva_09_std_dev_samp": _mva({"$stdDevSamp": "$q"}, "stddev_samp(q)", 6),
    "mva_10_date_group": (lambda s, d: V.evaluate(V.View("v", "events", group={"weekday": {"$dateField": "ts", "$datePart": "dayOfWeek"}}, aggregates={"n": {"$count": "*"}}), {"events": table(s, d, "events")}).withColumn("weekday", F.col("weekday").cast("long")), "SELECT dayofweek(ts) AS weekday, count(*) AS n FROM events GROUP BY 1"),
    "mva_11_bucket_group": (lambda s, d: V.evaluate(V.View("v", "part", group={"size": {"$bucket": "p_size", "$boundaries": [1, 10, 40]}}, aggregates={"n": {"$count": "*"}}), {"part": table(s, d, "part")}), "SELECT CASE WHEN p_size >= 1 AND p_size < 10 THEN '1-10' WHEN p_size >= 10 AND p_size < 40 THEN '10-40' ELSE 'other' END AS size, count(*) AS n FROM part GROUP BY 1"),
    "mva_12_whole_view": (lambda s, d: V.evaluate(V.View("v", "orders", filter={"o_orderstatus": {"$ne": "P"}}, group={"customer": "$o_custkey"}, aggregates={"n": {"$count": "*"}, "most": {"$max": "$o_totalprice"}}, having={"n": {"$gte": 15}}, sort={"most": -1, "customer": 1}, limit=20), {"orders": table(s, d, "orders")}), "SELECT o_custkey AS customer, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(*) >= 15 ORDER BY most DESC, customer LIMIT 20"),
    "mva_13_view_of_pipeline": (lambda s, d: V.evaluate(V.View("v", "orders", pipeline=[{"$match": {"o_orderstatus": "F"}}, {"$group": {"_id": "$o_orderpriority", "n": {"$sum": 1}}}]), {"orders": table(s, d, "orders")}), "SELECT o_orderpriority AS _id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"),
    "mva_14_incremental_merge": (_merged, f"SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_quantity), 2) AS total, round(avg(q), 6) AS mean, max(q) AS most FROM {_LI} GROUP BY 1"),
    "mva_15_conditional": _mva({"$sum": {"$cond": [{"l_discount": {"$gt": 0.05}}, 1, 0]}}, "CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT)"),
    "mva_16_unnest": (lambda s, d: V.evaluate(V.View("v", "part", unnest="words", group={"word": "$words"}, aggregates={"n": {"$count": "*"}}), {"part": table(s, d, "part").withColumn("words", F.split("p_name", " "))}), "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1"),
    "col_01_count": (lambda s, d: table(s, d, "lineitem").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM lineitem"),
    "col_02_min_max": (lambda s, d: table(s, d, "lineitem").agg(F.min("l_orderkey").alias("low"), F.max("l_extendedprice").alias("high")), "SELECT min(l_orderkey) AS low, max(l_extendedprice) AS high FROM lineitem"),
    "col_03_column_aggregates": (lambda s, d: _li(s, d).agg(F.count("q").alias("n"), F.round(F.sum("q"), 2).alias("total"), F.round(F.avg("q"), 6).alias("mean"), F.min("q").alias("low"), F.max("q").alias("high")), f"SELECT count(q) AS n, round(sum(q), 2) AS total, round(avg(q), 6) AS mean, min(q) AS low, max(q) AS high FROM {_LI}"),
    "sta_01_percentiles": (lambda s, d: table(s, d, "events").groupBy("event_type").agg(*S.percentiles(F.col("value"))).select("event_type", *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (50, 90, 95, 99)]), f"SELECT event_type, {_P} FROM events GROUP BY 1"),
    "sta_02_nearest_rank": (lambda s, d: table(s, d, "events").groupBy("event_type").agg(S.nearest_rank("value", 0.95).alias("p95")), "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1"),
    "sta_03_distinct_counts": (lambda s, d: table(s, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types")), "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events"),
    "sta_04_histogram": (lambda s, d: S.histogram(table(s, d, "lineitem"), "l_discount", 10, 0.0, 0.125), "SELECT CAST(greatest(0, least(floor((l_discount - 0.0) / 0.0125), 9)) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1"),
    "sta_04_bands": (lambda s, d: S.bands(table(s, d, "events").withColumn("score", (F.col("event_id") % 101) / 100), "score", ["event_type"]), "SELECT event_type, count(*) FILTER (score >= 0.9) AS excellent, count(*) FILTER (score >= 0.7 AND score < 0.9) AS good, count(*) FILTER (score >= 0.5 AND score < 0.7) AS fair, count(*) FILTER (score < 0.5) AS poor FROM (SELECT *, (event_id % 101) / 100 AS score FROM events) GROUP BY 1"),
    "sta_05_request_metrics": (_request_metrics, f"SELECT event_type, count(*) AS total, CAST(sum(CAST(status >= 400 AS BIGINT)) AS BIGINT) AS errors, round(avg(CAST(status >= 400 AS DOUBLE)), 6) AS error_rate, round(avg(CAST(cached AS DOUBLE)), 6) AS cache_ratio, round(avg(value), 6) AS mean_latency, round(min(value), 6) AS min_latency, round(max(value), 6) AS max_latency, {_P}, '{{\"2xx\":' || count(*) FILTER (status = 200) || ',\"3xx\":' || count(*) FILTER (status = 300) || ',\"4xx\":' || count(*) FILTER (status = 400) || ',\"5xx\":' || count(*) FILTER (status = 500) || '}}' AS by_status FROM {_RQ} GROUP BY 1"),
    "sta_06_path_summary": (lambda s, d: S.path_summary(_requests(s, d), "event_type", "value", "status").select("event_type", "total", "errors", *[F.round(c, 6).alias(c) for c in ("mean_latency", "p50", "p95")]), f"SELECT event_type, count(*) AS total, CAST(sum(CAST(status >= 400 AS BIGINT)) AS BIGINT) AS errors, round(avg(value), 6) AS mean_latency, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM {_RQ} GROUP BY 1"),
    "sta_07_costs": (_costs, "SELECT event_type AS model, count(*) AS requests, CAST(sum(event_id % 100) AS BIGINT) AS tokens_in, CAST(sum(event_id % 50) AS BIGINT) AS tokens_out, round(sum(CASE event_type WHEN 'click' THEN (event_id % 100) * 1.0 / 1000 + (event_id % 50) * 2.0 / 1000 WHEN 'view' THEN (event_id % 100) * 0.5 / 1000 + (event_id % 50) * 0.5 / 1000 ELSE 0.0 END), 6) AS cost FROM events GROUP BY 1"),
    "sta_08_errors_by_user": (lambda s, d: _requests(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sum((F.col("status") >= 400).cast("long")).alias("errors")), f"SELECT user_id, count(*) AS n, CAST(sum(CAST(status >= 400 AS BIGINT)) AS BIGINT) AS errors FROM {_RQ} GROUP BY 1"),
    "sta_09_trend": (lambda s, d: S.trend(table(s, d, "events"), "ts", "day", "value").select(F.date_format("bucket", "yyyy-MM-dd").alias("day"), F.round("mean", 6).alias("mean"), "n", F.round("change", 6).alias("change")), "SELECT strftime(b, '%Y-%m-%d') AS day, round(m, 6) AS mean, n, round(m - lag(m) OVER (ORDER BY b), 6) AS change FROM (SELECT date_trunc('day', ts) AS b, avg(value) AS m, count(*) AS n FROM events GROUP BY 1)"),
    "sta_09_compared": (lambda s, d: S.compared(table(s, d, "events"), F.col("event_id") % 2 == 0, "event_type", "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("a", "b", "relative")], "n_a", "n_b", "significant"), "SELECT event_type, round(a, 6) AS a, round(b, 6) AS b, round((b - a) / a, 6) AS relative, n_a, n_b, coalesce(abs((b - a) / a) > 0.05 AND n_a >= 30 AND n_b >= 30, FALSE) AS significant FROM (SELECT event_type, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 <> 0) AS b, count(*) FILTER (event_id % 2 = 0) AS n_a, count(*) FILTER (event_id % 2 <> 0) AS n_b FROM events GROUP BY 1)"),
    "sta_10_anomalies": (lambda s, d: S.anomalies(table(s, d, "events"), "user_id", ["ts", "event_id"], "value", 20).select("event_id", F.round("z", 4).alias("z")), "SELECT event_id, round(coalesce(CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0.0 END, 0.0), 4) AS z FROM (SELECT event_id, value, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"),
    "sta_11_error_rollup": (lambda s, d: S.error_rollup(_requests(s, d).withColumn("m", F.when(F.col("cached"), "timed out").otherwise(F.col("event_type"))), "m", "status"), f"SELECT CASE WHEN cached THEN 'timeout' ELSE 'unknown' END AS category, CASE WHEN status >= 500 THEN 'critical' WHEN status >= 400 THEN 'error' WHEN status >= 300 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM {_RQ} GROUP BY 1, 2"),
    "sta_12_levels": (lambda s, d: S.levels(table(s, d, "events").withColumn("l", F.upper("event_type")), "l"), "SELECT event_type AS level, count(*) AS n FROM events GROUP BY 1"),
    "sta_13_newest_versions": (lambda s, d: S.newest_versions(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "contents"), "SELECT user_id, event_id, event_type, contents FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) JOIN (SELECT user_id, count(DISTINCT event_type) AS contents FROM events GROUP BY 1) USING (user_id) WHERE r = 1"),
    "sta_14_limit_alerts": (lambda s, d: S.limit_alerts(table(s, d, "events"), "ts", "event_type", "1 day", 60).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "state"), "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, CASE WHEN count(*) > 60 THEN 'exceeded' WHEN count(*) > 48 THEN 'warning' ELSE 'ok' END AS state FROM events GROUP BY 1, 2"),
}


def _lookup(s, d):
    out = P.run(table(s, d, "region"), [{"$lookup": {"from": "nation", "localField": "r_regionkey", "foreignField": "n_regionkey", "as": "nations"}}], {"nation": table(s, d, "nation")})
    return out.select("r_regionkey", F.transform("nations", lambda n: n["n_name"]).alias("names")).select("r_regionkey", F.concat_ws("|", F.array_sort("names")).alias("names"))


def _hydrated(s, d):
    out = G.hydrate(table(s, d, "customer"), table(s, d, "orders"), "c_custkey", "o_custkey", "top", limit=2, sort={"o_totalprice": -1, "o_orderkey": 1})
    return out.select("c_custkey", F.concat_ws("|", F.transform("top", lambda o: o["o_orderkey"].cast("string"))).alias("top"))


def _hops(s, d):
    """Customers that are linked by parts: order to customer, line to part, over two hops from order 1."""
    orders, lines = table(s, d, "orders"), table(s, d, "lineitem")
    a = lines.select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"))
    edges = a.union(orders.select(F.concat(F.lit("o"), F.col("o_orderkey")), F.concat(F.lit("c"), F.col("o_custkey"))))
    return G.hops(s.createDataFrame([("o1",)], ["node"]), edges.union(edges.select(F.col("dst"), F.col("src"))), 2)


_E = "(SELECT 'o' || l_orderkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"
_E2 = f"(SELECT src, dst FROM {_E} UNION ALL SELECT dst, src FROM {_E})"


def _edges(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))


def _linked(s, d):
    edges = _edges(s, d)
    new = s.range(1, 40).select(F.col("id").alias("src"), (F.col("id") * 7).alias("dst"))
    return G.link(edges, new, table(s, d, "customer").where("c_custkey % 2 = 1"), "c_custkey", single=True)


QUERIES |= {
    "jn_01_lookup": (_lookup, "SELECT r_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    "jn_02_joins": (lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")), "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "jn_03_forward": (lambda s, d: G.forward(table(s, d, "nation"), table(s, d, "region"), "n_regionkey", "r_regionkey").select("n_name", "r_name"), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "jn_04_reverse": (lambda s, d: G.reverse(table(s, d, "nation"), table(s, d, "supplier"), "n_nationkey", "s_nationkey", "supplier").groupBy("n_nationkey").agg(F.count("supplier").alias("n"), F.max("supplier.s_acctbal").alias("top")), "SELECT n_nationkey, count(s_suppkey) AS n, max(s_acctbal) AS top FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "jn_05_related": (lambda s, d: G.related(table(s, d, "customer"), table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), {"o_orderstatus": "O"}, {"o_totalprice": -1, "o_orderkey": 1}, limit=20, offset=5, project=["c_custkey", "o_orderkey"]), "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5"),
    "jn_06_hydrate": (_hydrated, "SELECT c_custkey, coalesce(array_to_string(list(o_orderkey ORDER BY r), '|'), '') AS top FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 2) ON c_custkey = o_custkey GROUP BY 1"),
    "jn_07_capped_inbound": (lambda s, d: G.capped_inbound(table(s, d, "nation"), table(s, d, "customer"), "n_nationkey", "c_nationkey", "c_custkey", 3).select("n_nationkey", F.concat_ws("|", F.transform("inbound", lambda x: x.cast("string"))).alias("inbound"), "inbound_count"), "SELECT n_nationkey, coalesce(array_to_string(list(c_custkey ORDER BY c_custkey) FILTER (r <= 3), '|'), '') AS inbound, count(c_custkey) AS inbound_count FROM nation LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) ON c_nationkey = n_nationkey GROUP BY 1"),
    "jn_09_hops": (_hops, f"SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT 'o1' AS node, 0 AS hop UNION ALL SELECT dst, 1 FROM {_E2} WHERE src = 'o1' UNION ALL SELECT b.dst, 2 FROM {_E2} a JOIN {_E2} b ON a.dst = b.src WHERE a.src = 'o1') GROUP BY 1"),
    "jn_10_semi": (lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    "jn_11_fuzzy": (lambda s, d: G.fuzzy(table(s, d, "embeddings"), table(s, d, "embeddings"), "vec_id", "vec_id", "embedding", 0.2).select("left", "right", F.round("similarity", 6).alias("similarity")), "SELECT \"left\", \"right\", round(s, 6) AS similarity FROM (SELECT a.vec_id AS \"left\", b.vec_id AS \"right\", list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) = 1) WHERE s >= 0.2"),
    "jn_12_expand": (lambda s, d: V.evaluate(V.View("v", "supplier", expand={"nation": ("nation", "s_nationkey", "n_nationkey")}, select=["s_suppkey", "nation_n_name"]), {"supplier": table(s, d, "supplier"), "nation": table(s, d, "nation")}), "SELECT s_suppkey, n_name AS nation_n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"),
    "jn_13_link": (_linked, "SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey NOT IN (SELECT i FROM (SELECT unnest(range(1, 40)) AS i) JOIN customer ON c_custkey = i * 7 AND c_custkey % 2 = 1) UNION SELECT i, i * 7 FROM (SELECT unnest(range(1, 40)) AS i) JOIN customer ON c_custkey = i * 7 AND c_custkey % 2 = 1"),
    "jn_14_anti": (lambda s, d: G.dangling(_edges(s, d), table(s, d, "customer").where("c_nationkey <> 3"), "c_custkey").select("src"), "SELECT o_orderkey AS src FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)"),
    "set_01_set_operations": (lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey")).union(table(s, d, "nation").select("n_nationkey").exceptAll(table(s, d, "supplier").select("s_nationkey"))), "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT ALL SELECT s_nationkey FROM supplier)"),
    "set_02_log_union": (lambda s, d: table(s, d, "events").where("event_id % 2 = 0").unionByName(table(s, d, "events").where("event_id % 3 = 0")).orderBy("ts", "event_id").select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 3 = 0"),
    "set_03_dedupe": (lambda s, d: H.latest(table(s, d, "events"), ("user_id",), ("ts", "event_id")).select("user_id", "event_id"), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "set_04_exclude": (lambda s, d: table(s, d, "part").select("p_partkey").subtract(table(s, d, "lineitem").select("l_partkey")), "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem"),
    "win_03_merge_layers": (lambda s, d: H.merge_layers(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(1).alias("v"), F.lit("c").alias("op"), "c_name"), table(s, d, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("id"), F.lit(1).alias("v"), F.when(F.col("c_custkey") % 8 == 0, "d").otherwise("u").alias("op"), F.upper("c_name").alias("c_name"))).select("id", "op", "c_name"), "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'u' ELSE 'c' END AS op, CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer WHERE c_custkey % 8 <> 0"),
    "win_04_relations": (lambda s, d: H.latest(table(s, d, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("id")), ("user_id", "event_type")).select("user_id", "event_type", "id"), "SELECT user_id, event_type, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"),
    "win_05_per_parent": (lambda s, d: faceted.top_per_group(table(s, d, "orders"), "o_orderstatus", [F.desc("o_totalprice"), F.asc("o_orderkey")], 4).select("o_orderstatus", "o_orderkey", "rank"), "SELECT o_orderstatus, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 4"),
    "win_07_sessions": (lambda s, d: table(s, d, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_timestamp(F.col("w.start").cast("timestamp")).alias("start"), "n"), "SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, session"),
}

#: Star-schema queries in the library's own stages.


def _q3(s, d):
    c = where(table(s, d, "customer"), {"c_mktsegment": "BUILDING"})
    o = table(s, d, "orders").where("o_orderdate < timestamp_ntz'1998-01-01'")
    li = table(s, d, "lineitem").where("l_shipdate > timestamp_ntz'1996-01-01'")
    j = c.join(o, c["c_custkey"] == o["o_custkey"]).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    out = j.groupBy("o_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


def _q5(s, d):
    j = table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(table(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    j = j.join(table(s, d, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def _q14(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    gain = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return j.agg(F.round(100 * F.sum(F.when(F.col("p_type").startswith("PROMO"), gain).otherwise(0.0)) / F.sum(gain), 6).alias("promo"))


QUERIES |= {
    "star_q3_shipping_priority": (_q3, "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_shipdate > TIMESTAMP '1996-01-01' GROUP BY 1 ORDER BY revenue DESC, o_orderkey LIMIT 10"),
    "star_q5_local_suppliers": (_q5, "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "star_q6_revenue_change": (lambda s, d: where(table(s, d, "lineitem"), {"l_discount": {"$gte": 0.05, "$lte": 0.07}, "l_quantity": {"$lt": 24}}).agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue")), "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24"),
    "star_q10_returns": (lambda s, d: where(table(s, d, "lineitem"), {"l_returnflag": "R"}).join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("lost")).orderBy(F.desc("lost"), "o_custkey").limit(20), "SELECT o_custkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS lost FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY lost DESC, o_custkey LIMIT 20"),
    "star_q14_promotion": (_q14, "SELECT round(100 * sum(CASE WHEN starts_with(p_type, 'PROMO') THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey"),
    "star_ssb_by_year_brand": (lambda s, d: table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("n_regionkey = 1").groupBy(F.year("l_shipdate").cast("long").alias("year"), "p_brand").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue")), "SELECT year(l_shipdate) AS year, p_brand, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1, 2"),
}
