"""Full-text, faceted, vector and geographic search over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veldoc.functions import geo, vectors
from veldoc.functions.text import STOP_WORDS, stem, stem_by_language
from veldoc.operators import faceted as X, fulltext as T
from veldoc.sources.tables import table
from veldoc.sources.workspace import scratch

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


#: Indexes that this process has stored, by application and folder of tables.
_INDEXES: dict[tuple[str, str], str] = {}


def _ix(s, d):
    """The index over all documents: stored by the first query that needs it, read by all others."""
    key = (s.sparkContext.applicationId, d)
    if key in _INDEXES:
        path = s._jvm.org.apache.hadoop.fs.Path(f"{_INDEXES[key]}/stats/_SUCCESS")
        if not path.getFileSystem(s._jsc.hadoopConfiguration()).exists(path):
            del _INDEXES[key]
    if key not in _INDEXES:
        _INDEXES[key] = f"{scratch(s)}/index-{uuid.uuid4().hex}"
        T.save(_docs(s, d), _INDEXES[key], "doc_id", "text")
    return T.load(s, _INDEXES[key])


#: Tokens with positions, postings and lengths, as the index has them.
_TOK = f"""WITH raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9À-ɏḀ-ỿ]+') AS w FROM documents),
tok AS (SELECT doc_id AS doc, lower(w[i + 1]) AS term, i AS position FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM raw) WHERE length(w[i + 1]) BETWEEN 2 AND 50 AND lower(w[i + 1]) NOT IN ({_STOP})),
post AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY 1, 2),
lens AS (SELECT r.doc_id AS doc, count(t.term) AS length FROM raw r LEFT JOIN tok t ON t.doc = r.doc_id GROUP BY 1),
st AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"""


def _bm25(terms):
    """Scores by document for (term, times)."""
    values = ", ".join(f"('{t}', {n})" for t, n in terms)
    return f"""{_TOK}, q AS (SELECT * FROM (VALUES {values}) AS v(term, times)),
sc AS (SELECT p.doc, sum(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * times * 2.2 / (tf * times + 1.2 * (0.25 + 0.75 * length / mean))) AS score
    FROM post p JOIN q USING (term) JOIN df USING (term) JOIN lens USING (doc), st GROUP BY 1)"""


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


#: Terms and positions of the faceted service.
_SIMPLE = "SELECT DISTINCT p_partkey AS doc, term FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9_]+')) AS term FROM part) WHERE length(term) >= 2"


def _parts(s, d):
    return X.postings(table(s, d, "part"), "p_partkey", "p_name")


def _geo(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(k.alias("id"), ((k * 37) % 180 - 90).cast("double").alias("lat"), ((k * 73) % 360 - 180).cast("double").alias("lng"))


_GEO = "(SELECT c_custkey AS id, CAST((c_custkey * 37) % 180 - 90 AS DOUBLE) AS lat, CAST((c_custkey * 73) % 360 - 180 AS DOUBLE) AS lng FROM customer)"
_HAV = "2 * 6371008.8 * atan2(sqrt(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lng - 20) / 2), 2)), sqrt(1 - (pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lng - 20) / 2), 2))))"


def _query_vector(s, d):
    return list(table(s, d, "embeddings").where("vec_id = 0").first()["embedding"])


def _knn(metric):
    def run(s, d):
        out = vectors.top_k(table(s, d, "embeddings"), _query_vector(s, d), 10, metric)
        return out.select("vec_id", F.round("distance", 6).alias("distance"))

    dist = {"cosine": "list_cosine_distance(e, q)", "euclidean": "list_distance(e, q)", "dot": "-list_inner_product(e, q)"}[metric]
    return run, f"SELECT vec_id, round({dist}, 6) AS distance FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0) AS q FROM embeddings) ORDER BY {dist}, vec_id LIMIT 10"


def _filtered(how):
    def run(s, d):
        return vectors.filtered_top_k(table(s, d, "embeddings"), _query_vector(s, d), 10, F.col("label") < 5, how).select("vec_id", F.round("distance", 6).alias("distance"))

    base = "(SELECT vec_id, label, list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS dist FROM embeddings)"
    if how == "pre":
        return run, f"SELECT vec_id, round(dist, 6) AS distance FROM {base} WHERE label < 5 ORDER BY dist, vec_id LIMIT 10"
    return run, f"SELECT vec_id, round(dist, 6) AS distance FROM (SELECT * FROM {base} ORDER BY dist, vec_id LIMIT 30) WHERE label < 5 ORDER BY dist, vec_id LIMIT 10"


def _rrf(s, d):
    text = T.search(_ix(s, d), "the thing onand", 50)
    text = text.select("doc", "score")
    vec = vectors.top_k(table(s, d, "embeddings"), _query_vector(s, d), 50).select(F.col("vec_id").alias("doc"), "score")
    return X.fused(text, vec).select("doc", F.round("score", 8).alias("score"))


def _cursor(s, d):
    """The fourth page of ten: each page gives the cursor of the next."""
    cursor, page = None, None
    for _ in range(4):
        page, cursor = X.page_of(table(s, d, "part").orderBy("p_partkey"), 10, cursor)
    return page.select("p_partkey")


def _boolean(s, d):
    return T.boolean_docs(_ix(s, d), "(erer AND NOT thth) OR nder")


QUERIES = {
    "fts_01_tokens": (lambda s, d: _docs(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n")), f"{_TOK} SELECT doc AS doc_id, length AS n FROM lens"),
    "fts_03_stems": (lambda s, d: _ix(s, d).terms().select("term").withColumn("stem", stem("en")("term")), None),
    "fts_04_other_stems": (lambda s, d: _docs(s, d).select("lang", F.explode(F.array_distinct(T.tokens(F.col("text"))["term"])).alias("term")).distinct().withColumn("stem", stem_by_language()("lang", "term")), None),
    "fts_05_postings": (lambda s, d: _ix(s, d).terms(), f"{_TOK} SELECT term, df FROM df"),
    "fts_06_bm25": (lambda s, d: _rounded(T.search(_ix(s, d), "erer thion", None)).select("doc", "score"), f"{_bm25([('erer', 1), ('thion', 1)])} SELECT doc, round(score, 6) AS score FROM sc"),
    "fts_07_repeated_term": (lambda s, d: _rounded(T.search(_ix(s, d), "thing thing", 20)).select("doc", "score"), f"{_bm25([('thing', 2)])} SELECT doc, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, doc LIMIT 20"),
    "fts_08_phrase": (lambda s, d: T.phrase(_ix(s, d), ["all", "rights", "reserved"]), f"{_TOK} SELECT a.doc, count(*) AS n FROM tok a JOIN tok b ON a.doc = b.doc AND b.position = a.position + 1 AND b.term = 'rights' JOIN tok c ON a.doc = c.doc AND c.position = a.position + 2 AND c.term = 'reserved' WHERE a.term = 'all' GROUP BY 1"),
    "fts_09_marked": (lambda s, d: _rounded(T.marked_search(_ix(s, d), "+rights -general reserved", 1000)).select("doc", "score"), f"{_bm25([('rights', 1), ('reserved', 1)])} SELECT doc, round(score, 6) AS score FROM sc WHERE doc IN (SELECT doc FROM post WHERE term = 'rights') AND doc NOT IN (SELECT doc FROM post WHERE term = 'general') ORDER BY sc.score DESC, doc LIMIT 1000"),
    "fts_10_boolean": (_boolean, f"{_TOK}, h AS (SELECT doc, max(CAST(term = 'erer' AS INT)) AS a, max(CAST(term = 'thth' AS INT)) AS b, max(CAST(term = 'nder' AS INT)) AS c FROM post GROUP BY 1) SELECT doc FROM h WHERE (a = 1 AND b = 0) OR c = 1"),
    "fts_11_fuzzy": (lambda s, d: _rounded(T.fuzzy_search(_ix(s, d), "reservde", 100)).select("doc", "score"), f"{_TOK}, w AS (SELECT term, CASE WHEN term = 'reservde' THEN 1.0 ELSE 1 - 0.2 * damerau_levenshtein(term, 'reservde') END AS weight FROM df WHERE term[1] = 'r' AND damerau_levenshtein(term, 'reservde') <= 2) SELECT doc, round(sum(weight * greatest(0, ln((n - k + 0.5) / (k + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM post JOIN w USING (term) JOIN lens USING (doc), st, (SELECT count(*) FILTER (term = 'reservde') AS k FROM post) GROUP BY doc ORDER BY sum(weight * greatest(0, ln((n - k + 0.5) / (k + 0.5) + 1)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) DESC, doc LIMIT 100"),
    "fts_12_highlight": (lambda s, d: _docs(s, d).select("doc_id", T.snippet(T.highlight(F.col("text"), "thing"), "thing").alias("snippet")), "SELECT doc_id, CASE WHEN p > 1 THEN '...' ELSE '' END || substring(h, p, 150) || CASE WHEN length(h) >= p + 150 THEN '...' ELSE '' END AS snippet FROM (SELECT doc_id, h, greatest(coalesce(nullif(strpos(lower(h), 'thing'), 0), 1) - 50, 1) AS p FROM (SELECT doc_id, regexp_replace(text, '(?i)\\b(thing)\\b', '<b>\\1</b>', 'g') AS h FROM documents))"),
    "fts_13_tf_idf": (lambda s, d: T.tf_idf(_ix(s, d)).select("doc", "term", F.round("weight", 6).alias("weight")), f"{_TOK} SELECT doc, term, round((1 + ln(tf)) * ln(n / df), 6) AS weight FROM post JOIN df USING (term), st"),
    "flt_27_text_in_find": (lambda s, d: _docs(s, d).join(T.docs_with(_ix(s, d), "rights").withColumnRenamed("doc", "doc_id"), "doc_id", "left_semi").where("n_chars > 500").select("doc_id"), f"{_TOK} SELECT doc_id FROM documents WHERE n_chars > 500 AND doc_id IN (SELECT doc FROM post WHERE term = 'rights')"),
    "svc_01_analysers": (lambda s, d: table(s, d, "part").select("p_partkey", F.concat_ws("|", X.analyse(F.col("p_name"))).alias("terms")), "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9_]+'), lambda w: length(w) >= 2), '|') AS terms FROM part"),
    "svc_03_scores": (lambda s, d: X.scores(_parts(s, d), "red re* greem~"), f"WITH p AS ({_SIMPLE}), v AS (SELECT DISTINCT term FROM p), w AS (SELECT term, CAST(CASE WHEN term = 'red' THEN 10 WHEN starts_with(term, 'red') AND length(term) <= 8 THEN 2 ELSE 0 END + CASE WHEN starts_with(term, 're') THEN 4 ELSE 0 END + CASE WHEN levenshtein(term, 'greem') <= 1 THEN 1 ELSE 0 END AS DOUBLE) AS points FROM v) SELECT doc, sum(points) AS score FROM p JOIN w USING (term) WHERE points <> 0 GROUP BY 1"),
    "svc_04_exclusion": (lambda s, d: X.scores(_parts(s, d), "red -small"), f"WITH p AS ({_SIMPLE}), w AS (SELECT DISTINCT term, CAST(CASE WHEN term = 'red' THEN 10 WHEN starts_with(term, 'red') AND length(term) <= 8 THEN 2 ELSE 0 END AS DOUBLE) AS points FROM p) SELECT doc, sum(points) AS score FROM p JOIN w USING (term) WHERE points <> 0 AND doc NOT IN (SELECT doc FROM p WHERE term = 'small') GROUP BY 1"),
    "svc_05_synonyms": (lambda s, d: X.term_points(X.vocabulary(_parts(s, d)), "big"), f"WITH p AS ({_SIMPLE}) SELECT DISTINCT term, CAST(CASE WHEN term = 'big' THEN 10 WHEN term = 'large' THEN 3 ELSE 2 END AS DOUBLE) AS points FROM p WHERE term IN ('big', 'large') OR (starts_with(term, 'big') AND length(term) <= 8)"),
    "svc_06_did_you_mean": (lambda s, d: X.did_you_mean(X.vocabulary(_parts(s, d)), "grene").select("term", F.col("d").cast("long").alias("d"), "df"), f"WITH p AS ({_SIMPLE}), v AS (SELECT term, count(*) AS df FROM p GROUP BY 1) SELECT term, levenshtein(term, 'grene') AS d, df FROM v WHERE levenshtein(term, 'grene') <= 3 AND abs(length(term) - 5) <= 2 AND term <> 'grene' ORDER BY d, df DESC, term LIMIT 1"),
    "svc_07_complete": (lambda s, d: X.complete(X.vocabulary(_parts(s, d)), "re"), f"WITH p AS ({_SIMPLE}) SELECT term, count(*) AS df FROM p WHERE starts_with(term, 're') GROUP BY 1 ORDER BY df DESC, term LIMIT 10"),
    "svc_08_multi_value": (lambda s, d: X.filtered(table(s, d, "part"), {"p_brand": ["Brand#11", "Brand#12"]}, {"p_size": [1, 2, 3]}).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') AND p_size NOT IN (1, 2, 3)"),
    "svc_09_ranges": (lambda s, d: X.filtered(table(s, d, "part"), at_least={"p_retailprice": 950}, at_most={"p_retailprice": 980, "p_size": 25}).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 950 AND 980 AND p_size <= 25"),
    "svc_10_has": (lambda s, d: X.filtered(table(s, d, "part").withColumn("x", F.when(F.col("p_size") > 10, F.col("p_size"))), has=["x"]).select("p_partkey"), "SELECT p_partkey FROM part WHERE p_size > 10"),
    "svc_11_score_bounds": (lambda s, d: X.scores(_parts(s, d), "red re*").where("score between 4 and 12"), f"WITH p AS ({_SIMPLE}), w AS (SELECT DISTINCT term, CAST(CASE WHEN term = 'red' THEN 10 WHEN starts_with(term, 'red') AND length(term) <= 8 THEN 2 ELSE 0 END + CASE WHEN starts_with(term, 're') THEN 4 ELSE 0 END AS DOUBLE) AS points FROM p) SELECT doc, sum(points) AS score FROM p JOIN w USING (term) WHERE points <> 0 GROUP BY 1 HAVING sum(points) BETWEEN 4 AND 12"),
    "svc_12_distinct_by": (lambda s, d: X.distinct_by(table(s, d, "part"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")]).select("p_brand", "p_partkey"), "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1"),
    "svc_13_facets": (lambda s, d: X.facet(table(s, d, "documents"), "source"), "SELECT source AS value, count(*) AS count FROM documents GROUP BY 1 ORDER BY count DESC, value LIMIT 10"),
    "svc_14_statistics": (lambda s, d: X.statistics(table(s, d, "documents"), "n_chars"), "SELECT CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max, round(avg(n_chars), 1) AS avg, CAST(sum(n_chars) AS DOUBLE) AS sum, count(n_chars) AS count, round(var_pop(n_chars), 2) AS variance FROM documents"),
    "svc_15_histogram": (lambda s, d: X.histogram(table(s, d, "documents"), "n_chars", 500), "SELECT CAST(floor(n_chars / 500) * 500 AS BIGINT) AS \"from\", CAST(floor(n_chars / 500) * 500 + 500 AS BIGINT) AS \"to\", count(*) AS count FROM documents GROUP BY 1, 2"),
    "svc_16_top_per_group": (lambda s, d: X.top_per_group(table(s, d, "documents"), "lang", [F.desc("n_chars"), F.asc("doc_id")]).select("group", "rank", "doc_id"), "SELECT lang AS \"group\", CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank, doc_id FROM documents QUALIFY rank <= 3"),
    "svc_17_random": (lambda s, d: table(s, d, "documents").orderBy(F.rand(7)).limit(25).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM (SELECT * FROM documents LIMIT 25)"),
    "svc_19_cursor": (_cursor, "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 30"),
    "svc_21_similar": (lambda s, d: X.similar(table(s, d, "part"), _parts(s, d), "p_partkey", "p_name", 1).orderBy(F.desc("score"), "doc").limit(10), f"WITH p AS ({_SIMPLE}), q AS (SELECT unnest(list_filter(string_split(lower(p_name), ' '), lambda w: length(w) >= 3 AND w NOT IN ({_STOP}))[1:3]) AS q FROM part WHERE p_partkey = 1), w AS (SELECT term, sum(CASE WHEN term = q THEN 10 WHEN starts_with(term, q) AND length(term) - length(q) <= 5 THEN 2 WHEN length(q) >= 4 AND levenshtein(term, q) = 1 THEN 1 ELSE 0 END) AS points FROM (SELECT DISTINCT term FROM p), q GROUP BY 1) SELECT doc, CAST(sum(points) AS DOUBLE) AS score FROM p JOIN w USING (term) WHERE points <> 0 AND doc <> 1 GROUP BY 1 ORDER BY score DESC, doc LIMIT 10"),
    "svc_24_filter_first": (lambda s, d: X.filter_first(table(s, d, "part"), _parts(s, d), "p_partkey", F.col("p_size") > 20, ["red", "zzzz"]), f"WITH p AS ({_SIMPLE}), b AS (SELECT term, count(*) AS df FROM p WHERE starts_with(term, 'red') AND term <> 'red' GROUP BY 1 ORDER BY df DESC, term LIMIT 5) SELECT p_partkey AS doc, 10 AS score FROM part WHERE p_size > 20 AND p_partkey IN (SELECT doc FROM p WHERE term = 'red' OR term IN (SELECT term FROM b))"),
    "svc_26_rank_fusion": (_rrf, f"{_bm25([('the', 1), ('thing', 1), ('onand', 1)])}, t AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS r FROM sc ORDER BY score DESC, doc LIMIT 50), v AS (SELECT vec_id AS doc, row_number() OVER (ORDER BY dist, vec_id) AS r FROM (SELECT vec_id, list_cosine_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS dist FROM embeddings) ORDER BY dist, vec_id LIMIT 50) SELECT coalesce(t.doc, v.doc) AS doc, round(coalesce(0.5 / (60 + t.r), 0.0) + coalesce(0.5 / (60 + v.r), 0.0), 8) AS score FROM t FULL JOIN v ON t.doc = v.doc"),
    "svc_27_id_sets": (lambda s, d: _parts(s, d).where("term = 'red'").select("doc").intersect(table(s, d, "part").where("p_size > 25").select("p_partkey")).union(table(s, d, "part").where("p_size = 1").select("p_partkey")).distinct(), f"WITH p AS ({_SIMPLE}) (SELECT doc FROM p WHERE term = 'red' INTERSECT SELECT p_partkey FROM part WHERE p_size > 25) UNION SELECT p_partkey FROM part WHERE p_size = 1"),
    "vec_01_cosine": _knn("cosine"),
    "vec_02_euclidean": _knn("euclidean"),
    "vec_03_dot": _knn("dot"),
    "vec_04_scores": (lambda s, d: table(s, d, "embeddings").select("vec_id", *[F.round(vectors.score(f(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _query_vector(s, d)])), m), 6).alias(m) for m, f in vectors.DISTANCES.items()]), "SELECT vec_id, round(1 - list_cosine_distance(e, q), 6) AS cosine, round(exp(-list_distance(e, q)), 6) AS euclidean, round(list_inner_product(e, q), 6) AS dot FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)"),
    "vec_05_normalise": (lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(vectors.norm(vectors.normalised(F.col("embedding"))), 6).alias("length")), "SELECT vec_id, CASE WHEN list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) = 0 THEN 0::DOUBLE ELSE 1::DOUBLE END AS length FROM embeddings"),
    "vec_07_pre_filter": _filtered("pre"),
    "vec_08_post_filter": _filtered("post"),
    "geo_01_near": (lambda s, d: geo.near(_geo(s, d), 10.0, 20.0, 3_000_000.0, 500_000.0).select("id", F.round("distance", 1).alias("distance")), f"SELECT id, round(dist, 1) AS distance FROM (SELECT id, {_HAV} AS dist FROM {_GEO}) WHERE dist <= 3000000 AND dist >= 500000 ORDER BY dist, id LIMIT 100"),
    "geo_02_haversine": (lambda s, d: _geo(s, d).select("id", F.round(geo.haversine(F.lit(10.0), F.lit(20.0), F.col("lat"), F.col("lng")), 1).alias("m")), f"SELECT id, round({_HAV}, 1) AS m FROM {_GEO}"),
    "geo_03_equirectangular": (lambda s, d: _geo(s, d).select("id", F.round(geo.equirectangular(F.lit(10.0), F.lit(20.0), F.col("lat"), F.col("lng")), 1).alias("m")), f"SELECT id, round(6371008.8 * sqrt(pow(radians(lng - 20) * cos(radians(10 + lat) / 2), 2) + pow(radians(lat - 10), 2)), 1) AS m FROM {_GEO}"),
    "geo_04_box": (lambda s, d: _geo(s, d).where(geo.in_box(F.col("lat"), F.col("lng"), -20.0, 20.0, 170.0, -170.0)).select("id"), f"SELECT id FROM {_GEO} WHERE lat BETWEEN -20 AND 20 AND (lng >= 170 OR lng <= -170)"),
    "exp_30_bearing": (lambda s, d: _geo(s, d).select("id", F.round(geo.bearing(F.lit(10.0), F.lit(20.0), F.col("lat"), F.col("lng")), 4).alias("b")), f"SELECT id, round(fmod(degrees(atan2(sin(radians(lng - 20)) * cos(radians(lat)), cos(radians(10)) * sin(radians(lat)) - sin(radians(10)) * cos(radians(lat)) * cos(radians(lng - 20)))) + 360, 360), 4) AS b FROM {_GEO}"),
    "exp_31_geohash": (lambda s, d: _geo(s, d).select("id", geo.geohash(F.col("lat"), F.col("lng")).alias("cell"), geo.hilbert(F.col("lat"), F.col("lng")).alias("hilbert")), None),
    "exp_32_edit_distance": (lambda s, d: X.vocabulary(_parts(s, d)).select("term", F.levenshtein("term", F.lit("green")).cast("long").alias("d")), f"WITH p AS ({_SIMPLE}) SELECT DISTINCT term, levenshtein(term, 'green') AS d FROM p"),
}
