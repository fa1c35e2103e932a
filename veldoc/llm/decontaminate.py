"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Of each window of an item (ten consecutive words; an item of fewer is one window) the rarest terms by corpus count
are its anchors. The index stores the postings (term, document, position) of the anchors over all documents. A
posting less the anchor's offset in its item is a diagonal: where as many anchors as a window of the item has stand on one
diagonal of a document, the lists intersect and the item's windows are compared there word by word. Anchors on neighbouring diagonals that
cover most of an item are proximity matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from veldoc.llm.common import BROADCAST_ROWS, counted, sha_hex, stored, text_key, words

WINDOW = 10
#: Terms of a window whose lists are intersected before words are compared.
ANCHORS = 3
#: Rows up to which candidates with their items' words are broadcast; `counted` bounds their bytes too.
CANDIDATE_ROWS = BROADCAST_ROWS // 10
_OUT = ("n_words", "n_hit", "hit_items")


@dataclass
class Index:
    items: DataFrame  # item, item_id, item_words, len, windows
    anchors: DataFrame  # item, s, off, t
    diagonals: DataFrame  # item, id, key, diag, n (anchors that stand on it)


def build_index(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int = WINDOW, anchors: int = ANCHORS) -> Index:
    """The postings of the rarest terms, intersected into diagonals. Items without words take no part."""
    item_words = words(F.col(item_text_col))
    own = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), item_words.alias("item_words")).where(F.size("item_words") > 0)
    own = own.withColumn("item", F.xxhash64("item_id", "item_words")).dropDuplicates(["item"])
    own = own.withColumn("len", F.least(F.size("item_words"), F.lit(window))).withColumn("windows", F.size("item_words") - F.col("len") + 1)
    own = stored(own, "items")
    terms = own.select("item", "len", "windows", F.posexplode("item_words").alias("off", "w")).withColumn("t", F.xxhash64("w"))

    corpus = docs.select(F.explode(words(F.col(text_col))).alias("w")).select(F.xxhash64("w").alias("t"))
    counts = corpus.join(counted(stored(terms.select("t").distinct(), "terms")), "t").groupBy("t").agg(F.count("*").alias("cf"))

    spans = F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") - F.col("len") + 1), F.least(F.col("off"), F.col("windows") - 1)))
    in_window = terms.join(counts, "t", "left").select("item", "off", "t", F.coalesce("cf", F.lit(0)).alias("cf"), spans.alias("s"))
    per_window = W.partitionBy("item", "s")
    ranked = in_window.withColumn("least", F.min("cf").over(per_window)).withColumn("rank", F.row_number().over(per_window.orderBy("cf", "off")))
    chosen = stored(ranked.where((F.col("rank") <= anchors) & (F.col("least") > 0)).select("item", "s", "off", "t"), "anchors")

    at = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.posexplode(words(F.col(text_col))).alias("pos", "w"))
    postings = at.select("id", "key", "pos", F.xxhash64("w").alias("t")).join(counted(stored(chosen.select("t").distinct(), "anchor-terms")), "t")
    postings = stored(postings.select("t", "id", "key", "pos"), "postings")
    places = counted(stored(chosen.select("item", "off", "t").distinct(), "places"))
    diagonals = postings.join(places, "t").groupBy("item", "id", "key", (F.col("pos") - F.col("off")).alias("diag")).agg(F.count("*").alias("n"))
    return Index(own, chosen, diagonals)


def find_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs`, each row once, with n_words, n_hit (words inside an occurrence of a window) and hit_items (sorted ids,
    as strings, of the items with occurring windows).

    Null and empty texts have no words and no hits; a null item id counts as the empty string; items without words
    hit nothing. Rows that are repeated, or share an id, are each judged by their own text. Columns of `docs` named
    like the three results are replaced; other names may be any.
    """
    index = build_index(docs, items, id_col, text_col, item_col, item_text_col, window)
    need = index.anchors.groupBy("item", "s").agg(F.count("*").alias("need")).groupBy("item").agg(F.min("need").alias("need"))
    whole = index.diagonals.join(counted(stored(need, "need")), "item").where("n >= need")
    # an item's words go once into a document's row, however many diagonals it has there
    found = whole.groupBy("id", "key", "item").agg(F.collect_set("diag").alias("diags")).join(counted(index.items), "item")
    found = found.groupBy("id", "key").agg(F.collect_list(F.struct("item_id", "diags", "item_words", "len", "windows")).alias("cands"))
    found = counted(stored(found, "candidates"), CANDIDATE_ROWS)

    kept = [c for c in docs.columns if c not in _OUT]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"))
    rows = rows.withColumn("own_key", text_key(F.col("own_text")))
    rows = rows.join(found, rows["own_id"].eqNullSafe(found["id"]) & (rows["own_key"] == found["key"]), "left")
    # where there is no candidate only the count of words is asked for, if that
    found_in = F.when(F.col("cands").isNotNull(), words(F.col("own_text")))
    rows = rows.select("row", "cands", found_in.alias("words"), F.size(words(F.col("own_text"))).cast("long").alias("n_words"))

    def windows_of(c):
        def on(diag):
            def same(s):
                start = diag + s
                return (start >= 0) & (start + c["len"] <= F.size("words")) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, c["len"]) == F.slice(c["item_words"], s + 1, c["len"]))

            return F.transform(F.filter(F.sequence(F.lit(0), c["windows"] - 1), same), lambda s: F.struct(c["item_id"].alias("item_id"), (diag + s).alias("at"), c["len"].alias("len")))

        return F.flatten(F.transform(c["diags"], on))

    hits = F.when(F.col("cands").isNotNull(), F.flatten(F.transform("cands", windows_of)))
    rows = rows.select("row", "n_words", hits.alias("hits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1)))))
    ids = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"])))
    return rows.select("row.*", "n_words", F.when(F.col("hits").isNull(), 0).otherwise(covered).cast("long").alias("n_hit"), F.coalesce(ids, F.array().cast("array<string>")).alias("hit_items"))


def near_benchmark(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slack: int = 3, share: float = 0.8) -> DataFrame:
    """(id, item_id, start, share): items of which at least `share` of the anchors, three or more, stand in a document
    within `slack` words of one diagonal: copies with words added, dropped or changed. One row for each diagonal."""
    index = build_index(docs.dropDuplicates([id_col, text_col]), items, id_col, text_col, item_col, item_text_col)
    total = index.anchors.groupBy("item").agg(F.count_distinct("off").alias("total"))
    near = W.partitionBy("item", "id", "key").orderBy("diag").rangeBetween(-slack, slack)
    seen = index.diagonals.withColumn("seen", F.sum("n").over(near))
    seen = seen.join(total, "item").join(index.items.select("item", "item_id"), "item").where("total >= 3")
    return seen.select("id", "item_id", F.col("diag").alias("start"), F.least(F.lit(1.0), F.col("seen") / F.col("total")).alias("share")).where(F.col("share") >= share)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit by windows of `benchmark` items, for each row of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.concat_ws(",", "hit_items")
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), sha_hex(ids).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
l AS (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM l)),
places AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, p.n FROM places p JOIN win USING (n, g)),
cover AS (SELECT doc_id, count(DISTINCT word_no) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS word_no FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN its USING (doc_id)
"""
