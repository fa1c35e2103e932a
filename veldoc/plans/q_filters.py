"""Filters, finding and projections over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldoc.functions import expressions as X
from veldoc.operators import find as fnd, pipeline as P
from veldoc.operators.builder import Query
from veldoc.operators.filters import strict_where, where
from veldoc.sources.tables import table

#: `part` with nulls and arrays, and the same in SQL: sizes divisible by 7 are null, names are split into words.
PART_SQL = "(SELECT p_partkey, p_name, p_brand, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS size, string_split(p_name, ' ') AS words, p_retailprice FROM part)"
#: Orders with an array of the quantities of their lines, and of structs.
LINES_SQL = "(SELECT l_orderkey, list_sort(list(l_quantity)) AS quantities, list(struct_pack(part := l_partkey, qty := l_quantity)) AS items FROM lineitem GROUP BY l_orderkey)"


def part(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("size"), F.split("p_name", " ").alias("words"), "p_retailprice")


def lines(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("quantities"), F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))).alias("items"))


def _filter(spec, sql, of=None, frame=None, source=None, key=None):
    """A query that lists the keys of the rows a filter matches."""

    def run(spark, sf):
        df = frame(spark, sf) if frame else table(spark, sf, of)
        return where(df, spec).select(key)

    return run, f"SELECT {key} FROM {source or of} WHERE {sql}"


_p = {"frame": part, "source": PART_SQL, "key": "p_partkey"}
_l = {"frame": lines, "source": LINES_SQL, "key": "l_orderkey"}
_o = {"of": "orders", "key": "o_orderkey"}
_c = {"of": "customer", "key": "c_custkey"}

QUERIES = {
    "flt_01_implicit_equality": _filter({"c_mktsegment": "BUILDING", "c_nationkey": 7}, "c_mktsegment = 'BUILDING' AND c_nationkey = 7", **_c),
    "flt_01_implicit_null": _filter({"size": None}, "size IS NULL", **_p),
    "flt_02_eq": _filter({"o_orderstatus": {"$eq": "F"}}, "o_orderstatus = 'F'", **_o),
    "flt_02_eq_array": _filter({"quantities": {"$eq": [10.0, 20.0]}}, "quantities = [10.0, 20.0]", **_l),
    "flt_03_ne": _filter({"size": {"$ne": 5}}, "size IS DISTINCT FROM 5", **_p),
    "flt_04_gt": _filter({"size": {"$gt": 40}}, "size > 40", **_p),
    "flt_05_gte": _filter({"o_totalprice": {"$gte": 300000}}, "o_totalprice >= 300000", **_o),
    "flt_06_lt": _filter({"size": {"$lt": 4}}, "size < 4", **_p),
    "flt_07_lte": _filter({"c_acctbal": {"$lte": 0}}, "c_acctbal <= 0", **_c),
    "flt_08_in": _filter({"size": {"$in": [1, 2, None]}}, "size IN (1, 2) OR size IS NULL", **_p),
    "flt_09_nin": _filter({"size": {"$nin": [1, 2, 3]}}, "size IS NULL OR size NOT IN (1, 2, 3)", **_p),
    "flt_10_mod": _filter({"o_orderkey": {"$mod": [10, 3]}}, "o_orderkey % 10 = 3", **_o),
    "flt_10_mod_zero": _filter({"o_orderkey": {"$mod": [0, 0]}}, "FALSE", **_o),
    "flt_11_regex": _filter({"p_name": {"$regex": "E[AL]", "$options": "i"}}, "regexp_matches(p_name, '(?i)E[AL]')", **_p),
    "flt_12_starts_with": _filter({"p_brand": {"$startsWith": "Brand#1"}}, "starts_with(p_brand, 'Brand#1')", **_p),
    "flt_13_ends_with": _filter({"c_name": {"$endsWith": "7"}}, "c_name LIKE '%7'", **_c),
    "flt_14_contains": _filter({"p_name": {"$contains": "re"}}, "contains(p_name, 're')", **_p),
    "flt_15_all": _filter({"quantities": {"$all": [10.0, 20.0]}}, "list_contains(quantities, 10.0) AND list_contains(quantities, 20.0)", **_l),
    "flt_16_elem_match": _filter({"items": {"$elemMatch": {"qty": {"$gt": 45}, "part": {"$lt": 500}}}}, "len(list_filter(items, lambda x: x.qty > 45 AND x.part < 500)) > 0", **_l),
    "flt_16_elem_match_scalar": _filter({"quantities": {"$elemMatch": {"$gt": 20, "$lt": 22}}}, "len(list_filter(quantities, lambda x: x > 20 AND x < 22)) > 0", **_l),
    "flt_17_size": _filter({"quantities": {"$size": 3}}, "len(quantities) = 3", **_l),
    "flt_18_exists": _filter({"size": {"$exists": False}}, "size IS NULL", **_p),
    "flt_19_type": _filter({"$and": [{"size": {"$type": "number"}}, {"p_name": {"$type": "string"}}, {"words": {"$type": "array"}}]}, "size IS NOT NULL AND p_name IS NOT NULL AND words IS NOT NULL", **_p),
    "flt_20_and": _filter({"$and": [{"o_orderstatus": "O"}, {"o_totalprice": {"$gt": 100000}}]}, "o_orderstatus = 'O' AND o_totalprice > 100000", **_o),
    "flt_21_or": _filter({"$or": [{"size": 1}, {"size": {"$gt": 48}}]}, "size = 1 OR size > 48", **_p),
    "flt_22_not": _filter({"$not": {"size": {"$gt": 10}}}, "NOT coalesce(size > 10, FALSE)", **_p),
    "flt_23_nor": _filter({"$nor": [{"size": {"$gt": 10}}, {"p_brand": {"$startsWith": "Brand#1"}}]}, "NOT (coalesce(size > 10, FALSE) OR starts_with(p_brand, 'Brand#1'))", **_p),
    "flt_24_field_not": _filter({"size": {"$not": {"$gte": 10, "$lte": 40}}}, "NOT coalesce(size >= 10 AND size <= 40, FALSE)", **_p),
    "flt_25_expr": _filter({"$expr": {"$lt": ["$size", "$p_partkey"]}}, "coalesce(size < p_partkey, TRUE)", **_p),
    "flt_25_expr_gte": _filter({"$expr": {"$gte": ["$size", "$p_partkey"]}}, "coalesce(size >= p_partkey, FALSE)", **_p),
    "flt_26_comment": _filter({"$comment": "all of one status", "o_orderstatus": "P"}, "o_orderstatus = 'P'", **_o),
    "flt_30_scalar_rows": _filter({"words": {"$elemMatch": {"$startsWith": "b"}}}, "len(list_filter(words, lambda x: starts_with(x, 'b'))) > 0", **_p),
    "flt_31_unknown_ignored": _filter({"o_orderstatus": {"$eq": "F", "$fancy": 1}}, "o_orderstatus = 'F'", **_o),
}


def _system_fields(spark, sf):
    df = table(spark, sf, "customer")
    return where(df, {"$id": {"$lte": 20}, "name": {"$contains": "1"}}, renamed={"$id": "c_custkey", "name": "c_name"}).select("c_custkey")


def _soft_delete(spark, sf):
    df = table(spark, sf, "customer").withColumn("deletedAt", F.when(F.col("c_custkey") % 5 == 0, F.lit("2024-01-01")))
    return fnd.find(df, {"c_acctbal": {"$gt": 0}}).select("c_custkey")


def _nested(spark, sf):
    return where(lines(spark, sf), {"items.0.qty": {"$gt": 0}, "quantities.0": {"$lte": 2}}).select("l_orderkey")


def _variant(spark, sf):
    df = table(spark, sf, "events").withColumn("doc", F.parse_json("props"))
    return df.where(F.try_variant_get("doc", "$.k", "int") > 90).select("event_id", F.try_variant_get("doc", "$.k", "int").alias("k"))


def _after(spark, sf):
    df = table(spark, sf, "orders")
    last = df.where("o_orderkey = 100").select("o_totalprice", "o_orderkey").first().asDict()
    return fnd.after(df, [("o_totalprice", True), ("o_orderkey", False)], last).orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey")


def _page(spark, sf):
    found = fnd.page(table(spark, sf, "customer"), {"c_mktsegment": "BUILDING"}, {"c_acctbal": -1}, "c_custkey", 10)
    return found.items.select("c_custkey").withColumn("total", F.lit(found.total).cast("long")).withColumn("has_more", F.lit(found.has_more))


def _sorted(dialect):
    def run(spark, sf):
        df = part(spark, sf).select("p_partkey", "size")
        first = P.sort(df, {"size": 1, "p_partkey": 1}, dialect).limit(40).withColumn("way", F.lit("up"))
        return first.union(P.sort(df, {"size": -1, "p_partkey": 1}, dialect).limit(40).withColumn("way", F.lit("down")))

    up, down = {"find": ("NULLS LAST", "NULLS LAST"), "pipeline": ("NULLS FIRST", "NULLS LAST"), "view": ("NULLS LAST", "NULLS FIRST")}[dialect]
    sql = f"(SELECT p_partkey, size, 'up' AS way FROM {PART_SQL} ORDER BY size ASC {up}, p_partkey LIMIT 40) UNION ALL (SELECT p_partkey, size, 'down' AS way FROM {PART_SQL} ORDER BY size DESC {down}, p_partkey LIMIT 40)"
    return run, sql


QUERIES |= {
    "flt_32_system_fields": (_system_fields, "SELECT c_custkey FROM customer WHERE c_custkey <= 20 AND contains(c_name, '1')"),
    "flt_33_soft_delete": (_soft_delete, "SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey % 5 <> 0"),
    "flt_34_strict_dialect": (lambda s, d: strict_where(table(s, d, "orders"), {"$or": [{"o_orderstatus": "F"}, {"o_orderkey": "12"}]}).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "flt_35_zone_maps": (lambda s, d: where(table(s, d, "lineitem"), {"l_orderkey": {"$gte": 100, "$lte": 200}}).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 100 AND 200"),
    "flt_36_variant": (_variant, "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 90"),
    "exp_17_nested_paths": (_nested, f"SELECT l_orderkey FROM {LINES_SQL} WHERE items[1].qty > 0 AND quantities[1] <= 2"),
    "fnd_01_find": (lambda s, d: fnd.find(table(s, d, "orders"), {"o_orderstatus": "F"}, {"o_totalprice": -1, "o_orderkey": 1}, skip=5, limit=15, project={"o_orderkey": 1, "o_totalprice": 1}), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5"),
    "fnd_02_find_one": (lambda s, d: fnd.find(table(s, d, "orders"), {"o_orderkey": 77}, limit=1).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77"),
    "fnd_03_get": (lambda s, d: fnd.find(table(s, d, "customer"), {"c_custkey": 42}).select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42"),
    "fnd_04_get_many": (lambda s, d: fnd.get_many(table(s, d, "customer"), [5, 3, 999999999, 8], "c_custkey").select("position", "asked", "c_name"), "SELECT CAST(position AS BIGINT) AS position, CAST(asked AS BIGINT) AS asked, c_name FROM (VALUES (0, 5), (1, 3), (2, 999999999), (3, 8)) AS v(position, asked) LEFT JOIN customer ON c_custkey = asked"),
    "fnd_05_count": (lambda s, d: where(table(s, d, "lineitem"), {"l_quantity": {"$gt": 45}}).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 45"),
    "fnd_06_exists": (lambda s, d: table(s, d, "orders").where("o_orderkey = 5").limit(1).agg((F.count("*") > 0).alias("found")), "SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 5"),
    "fnd_07_distinct": (lambda s, d: P.run(table(s, d, "customer"), [{"$group": {"_id": "$c_mktsegment"}}]), "SELECT DISTINCT c_mktsegment AS _id FROM customer"),
    "prj_01_include": (lambda s, d: fnd.projected(table(s, d, "nation"), {"n_name": 1, "n_regionkey": 1}), "SELECT n_name, n_regionkey FROM nation"),
    "prj_01_exclude": (lambda s, d: fnd.projected(table(s, d, "nation"), {"n_regionkey": 0}), "SELECT n_nationkey, n_name FROM nation"),
    "srt_01_find_order": _sorted("find"),
    "srt_02_pipeline_order": _sorted("pipeline"),
    "srt_03_view_order": _sorted("view"),
    "srt_04_full_sort": (lambda s, d: P.sort(table(s, d, "supplier"), {"s_acctbal": -1, "s_suppkey": 1}).select("s_suppkey", "s_acctbal"), "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey"),
    "lim_01_limit": (lambda s, d: P.run(table(s, d, "orders"), [{"$sort": {"o_orderkey": 1}}, {"$limit": 7}, {"$project": {"o_orderkey": 1}}]), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7"),
    "lim_02_skip": (lambda s, d: P.run(table(s, d, "nation"), [{"$sort": {"n_nationkey": 1}}, {"$skip": 20}, {"$project": {"n_nationkey": 1}}]), "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20"),
    "lim_03_top_k": (lambda s, d: fnd.find(table(s, d, "lineitem"), {}, {"l_extendedprice": -1, "l_orderkey": 1, "l_linenumber": 1}, limit=25).select("l_orderkey", "l_linenumber", "l_extendedprice"), "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25"),
    "pag_01_keyset": (_after, "SELECT o_orderkey FROM orders, (SELECT o_totalprice AS p, o_orderkey AS k FROM orders WHERE o_orderkey = 100) WHERE o_totalprice < p OR (o_totalprice = p AND o_orderkey > k) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "pag_02_offset": (lambda s, d: fnd.find(table(s, d, "orders"), {}, {"o_orderkey": 1}, skip=40, limit=20).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40"),
    "pag_03_envelope": (_page, "SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total, (SELECT count(*) > 10 FROM customer WHERE c_mktsegment = 'BUILDING') AS has_more FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10"),
    "bld_01_builder": (lambda s, d: Query(table(s, d, "orders")).where("o_orderstatus", "=", "F").and_("o_totalprice", ">", 200000).or_("o_orderkey", "<=", 10).not_("o_orderstatus", "eq", "P").select("o_orderkey").find(), "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderkey <= 10 AND o_orderstatus <> 'P')"),
}

#: Expressions over lines and orders: (name, column, SQL).
_LINE = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END"


def _expressions(spark, sf, spec):
    df = table(spark, sf, "lineitem").withColumn("q", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    return P.add_fields(df, {"v": spec}).select("l_orderkey", "l_linenumber", "v")


def _exp(spec, sql):
    return (lambda s, d: _expressions(s, d, spec)), f"SELECT l_orderkey, l_linenumber, {sql} AS v FROM (SELECT *, {_LINE} AS q FROM lineitem)"


QUERIES |= {
    "exp_01_str_len": _exp({"$strLenCP": "$l_returnflag"}, "CAST(length(l_returnflag) AS INTEGER)"),
    "exp_02_concat": _exp({"$concat": ["$l_returnflag", "-", "$l_linestatus"]}, "l_returnflag || '-' || l_linestatus"),
    "exp_03_to_upper": _exp({"$toUpper": {"$concat": ["x", "$l_returnflag"]}}, "upper('x' || l_returnflag)"),
    "exp_04_to_lower": _exp({"$toLower": "$l_returnflag"}, "lower(l_returnflag)"),
    "exp_05_gt": _exp({"$gt": ["$q", 25]}, "coalesce(q > 25, FALSE)"),
    "exp_06_gte": _exp({"$gte": ["$q", 25]}, "coalesce(q >= 25, FALSE)"),
    "exp_07_lt": _exp({"$lt": ["$q", 25]}, "coalesce(q < 25, TRUE)"),
    "exp_08_lte": _exp({"$lte": ["$q", 25]}, "coalesce(q <= 25, TRUE)"),
    "exp_09_eq": _exp({"$eq": ["$q", 25]}, "q IS NOT DISTINCT FROM 25"),
    "exp_10_ne": _exp({"$ne": ["$q", 25]}, "q IS DISTINCT FROM 25"),
    "exp_11_add": _exp({"$add": ["$q", 1, "$l_linenumber"]}, "coalesce(q, 0) + 1.0 + CAST(l_linenumber AS DOUBLE)"),
    "exp_12_subtract": _exp({"$subtract": ["$q", 5]}, "coalesce(q, 0) - 5.0"),
    "exp_13_multiply": _exp({"$multiply": ["$q", 2]}, "coalesce(q, 0) * 2.0"),
    "exp_14_divide": _exp({"$divide": ["$q", "$q"]}, "CASE WHEN q IS NULL OR q = 0 THEN NULL ELSE q / q END"),
    "exp_15_cond": _exp({"$cond": ["$q", "some", "none"]}, "CASE WHEN q IS NOT NULL AND q <> 0 THEN 'some' ELSE 'none' END"),
    "exp_16_if_null": _exp({"$ifNull": ["$q", -1.0]}, "coalesce(q, -1.0)"),
    "prj_02_project": (lambda s, d: P.project(table(s, d, "orders"), {"o_orderkey": 1, "shout": {"$toLower": "$o_orderpriority"}}), "SELECT o_orderkey, lower(o_orderpriority) AS shout FROM orders"),
    "prj_03_add_fields": (lambda s, d: P.add_fields(table(s, d, "nation"), {"twice": {"$multiply": ["$n_nationkey", 2]}}), "SELECT *, CAST(n_nationkey * 2 AS DOUBLE) AS twice FROM nation"),
    "prj_04_unset": (lambda s, d: P.run(table(s, d, "nation"), [{"$unset": ["n_name"]}]), "SELECT n_nationkey, n_regionkey FROM nation"),
    "prj_05_replace_root": (lambda s, d: P.run(table(s, d, "nation").select(F.struct("n_nationkey", "n_name").alias("doc")), [{"$replaceRoot": {"newRoot": "$doc"}}]), "SELECT n_nationkey, n_name FROM nation"),
    "unw_01_unwind": (lambda s, d: P.unwind(part(s, d).select("p_partkey", "words"), {"path": "$words", "includeArrayIndex": "i"}), f"SELECT p_partkey, words[i + 1] AS words, CAST(i AS INTEGER) AS i FROM (SELECT p_partkey, words, unnest(range(0, len(words))) AS i FROM {PART_SQL})"),
    "unw_01_unwind_outer": (lambda s, d: P.unwind(part(s, d).select("p_partkey", F.when(F.col("size").isNotNull(), F.col("words")).alias("words")), {"path": "$words", "preserveNullAndEmptyArrays": True}), f"SELECT p_partkey, unnest(CASE WHEN size IS NULL THEN [NULL] ELSE words END) AS words FROM {PART_SQL}"),
    "exp_18_date_parts": (lambda s, d: table(s, d, "events").select("event_id", *[X.date_part(F.col("ts"), p).cast("long").alias(p) for p in ("year", "month", "day", "hour", "minute", "dayOfWeek", "week")]), "SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, dayofweek(ts) AS dayOfWeek, weekofyear(ts) AS week FROM events"),
    "exp_19_time_buckets": (lambda s, d: table(s, d, "events").select("event_id", *[F.date_format(X.time_bucket(F.col("ts"), u), "yyyy-MM-dd HH:mm:ss").alias(u) for u in ("minute", "hour", "day", "week", "month")]), "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, strftime(date_trunc('day', ts) - to_days(CAST(dayofweek(ts) AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS week, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS month FROM events"),
    "exp_20_status_category": (lambda s, d: table(s, d, "events").select("event_id", X.status_category((100 + F.col("event_id") % 500)).alias("category")), "SELECT event_id, CASE WHEN 100 + event_id % 500 < 200 THEN '1xx' WHEN 100 + event_id % 500 < 300 THEN '2xx' WHEN 100 + event_id % 500 < 400 THEN '3xx' WHEN 100 + event_id % 500 < 500 THEN '4xx' ELSE '5xx' END AS category FROM events"),
    "exp_21_error_class": (lambda s, d: table(s, d, "events").select("event_id", X.error_class(F.concat(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, " timed out").when(F.col("event_id") % 3 == 1, " not found").otherwise(""))).alias("category"), X.severity(100 + F.col("event_id") % 500).alias("severity")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'timeout' WHEN event_id % 3 = 1 THEN 'not_found' ELSE 'unknown' END AS category, CASE WHEN 100 + event_id % 500 >= 500 THEN 'critical' WHEN 100 + event_id % 500 >= 400 THEN 'error' WHEN 100 + event_id % 500 >= 300 THEN 'warning' ELSE 'info' END AS severity FROM events"),
    "exp_22_content_type": (lambda s, d: table(s, d, "events").select("event_id", X.content_type(F.col("props")).alias("kind")), "SELECT event_id, 'json' AS kind FROM events"),
    "exp_23_code_language": (lambda s, d: table(s, d, "pages").select("page_id", X.code_language(F.col("html")).alias("language")), r"SELECT page_id, CASE WHEN regexp_matches(html, '(?m)^\s*(def \w+\(|import \w+$|from \w+ import )') THEN 'python' WHEN regexp_matches(html, '\binterface \w+ \{|: (string|number|boolean)\b') THEN 'typescript' WHEN regexp_matches(html, '\b(const|let|var) \w+ =|=>|\bfunction\b') THEN 'javascript' WHEN regexp_matches(html, '\bpublic (static |final )*(class|void)\b') THEN 'java' WHEN regexp_matches(html, '\bfunc \w+\(|\bpackage main\b') THEN 'go' WHEN regexp_matches(html, '\bfn \w+\(|\blet mut\b') THEN 'rust' WHEN regexp_matches(html, '(?i)\bselect\b.+\bfrom\b') THEN 'sql' ELSE 'unknown' END AS language FROM pages"),
    "exp_24_token_estimate": (lambda s, d: table(s, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens")), "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents"),
    "exp_26_djb2": (lambda s, d: table(s, d, "part").select("p_partkey", X.djb2(F.col("p_brand")).alias("h")), "SELECT p_partkey, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(p_brand, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 33 + c) % 4294967296) AS h FROM part"),
    "exp_27_json_path": (lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"),
    "exp_28_typed_value": (lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.typed_value(F.when(F.col("l_linenumber") == 1, F.col("l_orderkey").cast("string")).when(F.col("l_linenumber") == 2, F.lit("true")).when(F.col("l_linenumber") == 3, F.lit("2024-01-02")).when(F.col("l_linenumber") == 4, F.lit("")).otherwise(F.col("l_returnflag"))).alias("kind")), "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'integer' WHEN 2 THEN 'boolean' WHEN 3 THEN 'date' WHEN 4 THEN 'null' ELSE 'string' END AS kind FROM lineitem"),
    "exp_34_fnv1a": (lambda s, d: table(s, d, "customer").select("c_custkey", F.pmod(X.fnv1a(F.col("c_name")), F.lit(16)).alias("shard")), "SELECT c_custkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 16 AS shard FROM customer"),
}
