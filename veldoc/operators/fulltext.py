"""Full-text search: postings, BM25, phrases, required and excluded terms, boolean queries, fuzzy terms."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as S

from veldoc.functions.text import LATIN, damerau, query_tokens, tokens
from veldoc.sources.workspace import kept

#: Parameters of BM25, and of fuzzy terms (least length, prefix that must agree, penalty an edit).
K1, B = 1.2, 0.75
FUZZY_LENGTH, FUZZY_PREFIX, FUZZY_PENALTY = 4, 1, 0.2
#: Near terms up to which a fuzzy query names them to the scan, and up to which its weights are broadcast.
NAMED, BROADCAST = 2_000, 500_000


@dataclass
class Index:
    """postings(term, doc, tf, length, positions), where length is the document's, docs(doc, length) of all documents,
    vocabulary(term, df), and the number and mean length of documents."""

    postings: DataFrame
    docs: DataFrame
    vocabulary: DataFrame
    n: int
    mean: float

    def terms(self) -> DataFrame:
        return self.vocabulary

    def of(self, terms: Sequence[str]) -> DataFrame:
        """The postings of a few terms: a filter that reaches the stored, sorted table."""
        return self.postings.where(F.col("term").isin(list(dict.fromkeys(terms))))


def index(df: DataFrame, key: str, text: str, pattern: str = LATIN) -> Index:
    """The postings as a plan, computed anew by each query. `save` and `load` keep them."""
    placed = df.select(F.col(key).alias("doc"), tokens(F.col(text), pattern).alias("ts"))
    docs = placed.select("doc", F.size("ts").alias("length"))
    at = placed.select("doc", F.size("ts").alias("length"), F.explode("ts").alias("t")).select("doc", "length", "t.term", "t.position")
    postings = at.groupBy("term", "doc").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.array_sort(F.collect_list("position")).alias("positions"))
    stats = docs.agg(F.count("*"), F.avg("length")).first()
    return Index(postings, docs, postings.groupBy("term").agg(F.count("*").alias("df")), stats[0], stats[1] or 0.0)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each text, made where the text stands; a text without terms has one row with a null term."""
    for b in batches:
        sizes = b.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        terms = b.column("terms").flatten().dictionary_encode()
        codes = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = row * max(1, len(terms.dictionary)) + codes
        order = np.argsort(key, kind="stable")  # positions of a text ascend already
        starts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else key
        empty = np.flatnonzero(sizes == 0)
        ends = np.concatenate([starts[1:], [len(key)]])[: len(starts)]
        of = np.concatenate([row[order[starts]], empty])
        term = pa.concat_arrays([terms.dictionary.take(pa.array(codes[order[starts]])), pa.nulls(len(empty), terms.dictionary.type)])
        tf = np.concatenate([ends - starts, np.zeros(len(empty), np.int64)])
        places = b.column("positions").flatten().take(pa.array(order))
        positions = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tf)]).astype(np.int32)), places)
        yield pa.RecordBatch.from_arrays([term, b.column("doc").take(pa.array(of)), pa.array(tf), pa.array(sizes[of].astype(np.int32)), positions], ["term", "doc", "tf", "length", "positions"])


def _rows(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(term, doc, tf, length, positions) of each row, without a shuffle."""
    placed = df.select(F.col(key).alias("doc"), tokens(F.col(text), pattern).alias("ts"))
    placed = placed.select("doc", F.col("ts.term").alias("terms"), F.col("ts.position").alias("positions"))
    fields = [("term", S.StringType()), ("doc", placed.schema["doc"].dataType), ("tf", S.LongType()), ("length", S.IntegerType()), ("positions", S.ArrayType(S.IntegerType()))]
    return placed.mapInArrow(_grouped, S.StructType([S.StructField(*f) for f in fields]))


def save(df: DataFrame, path: str, key: str, text: str, pattern: str = LATIN) -> None:
    """Writes an index: postings in ranges of terms, each file sorted, so that a term's rows stand in a few row groups; a
    frequent term's rows are spread by document. Texts are read once, and their terms grouped where they stand; only rows
    of keys that occur again are grouped once more."""
    spark = df.sparkSession
    _rows(df, key, text, pattern).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    again = kept(df.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"))
    if again.limit(1).count():
        same = F.col("doc").eqNullSafe(F.col("again"))
        merged = rows.join(again, same, "left_semi").groupBy("term", "doc").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        rows = rows.join(again, same, "left_anti").unionByName(merged)
    rows.where("term is not null").repartitionByRange("term", "doc").sortWithinPartitions("term", "doc").write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    rows.groupBy("doc").agg(F.max("length").alias("length")).write.parquet(f"{path}/docs")
    found = spark.read.parquet(f"{path}/postings")
    found.groupBy("term").agg(F.count("*").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/vocabulary")
    spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).write.parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> Index:
    """An index that `save` has written. Documents are told apart by their key."""
    postings, docs, vocabulary, stats = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "docs", "vocabulary", "stats"))
    n, mean = stats.first()
    return Index(postings, docs, vocabulary, n, mean or 0.0)


def idf(df: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.lit(0.0), F.log((n - df + 0.5) / (df + 0.5) + 1))


def bm25(ix: Index, weights: DataFrame, terms: Sequence[str] | None = None, k1: float = K1, b: float = B, few: bool | None = None) -> DataFrame:
    """(doc, score) from (term, weight, idf_term): the idf is that of idf_term. Where the terms are known beforehand, as
    those of a query are, only their postings are read. Weights that are few are broadcast."""
    few = terms is not None if few is None else few
    postings = ix.postings if terms is None else ix.of(terms)
    known = ix.vocabulary if terms is None else ix.vocabulary.where(F.col("term").isin(list(dict.fromkeys(terms))))
    counts = known.select(F.col("term").alias("idf_term"), "df")
    weights = weights.join(counts, "idf_term", "left")
    scored = postings.select("doc", "term", "tf", "length").join(F.broadcast(weights) if few else weights, "term")
    tf = F.col("tf") * F.col("times")
    part = F.col("weight") * idf(F.coalesce("df", F.lit(0)), ix.n) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / ix.mean))
    return scored.groupBy("doc").agg(F.sum(part).alias("score"))


def _weights(ix: Index, terms: Sequence[str]) -> DataFrame:
    counted: dict[str, int] = {}
    for t in terms:
        counted[t] = counted.get(t, 0) + 1
    return ix.postings.sparkSession.createDataFrame([(t, 1.0, t, n) for t, n in counted.items()] or [("", 0.0, "", 0)], "term string, weight double, idf_term string, times int")


def search(ix: Index, query: str, limit: int | None = 100, least: float = 0.0) -> DataFrame:
    """Documents with any term of the query, best first, all of them without a limit; a repeated term doubles its
    frequency."""
    terms = query_tokens(query)
    out = bm25(ix, _weights(ix, terms), terms).where(F.col("score") >= least).orderBy(F.desc("score"), "doc")
    return out if limit is None else out.limit(limit)


def phrase(ix: Index, words: Sequence[str]) -> DataFrame:
    """(doc, n): documents in which the words stand one behind the other, and how often."""
    starts = None
    for i, w in enumerate(words):
        one = ix.of([w]).select("doc", F.explode("positions").alias("p")).select("doc", (F.col("p") - i).alias("at"))
        starts = one if starts is None else starts.join(one, ["doc", "at"], "left_semi")
    return starts.groupBy("doc").agg(F.count("*").alias("n"))


def phrase_search(ix: Index, query: str, limit: int = 100) -> DataFrame:
    """Documents with the phrase; the score is BM25 of its terms times 1 + log2(1 + count) / 2."""
    words = query_tokens(query)
    found = bm25(ix, _weights(ix, words), words).join(phrase(ix, words), "doc")
    out = found.select("doc", (F.col("score") * (1 + 0.5 * F.log2(F.col("n") + 1))).alias("score"), "n")
    return out.orderBy(F.desc("score"), "doc").limit(limit)


def docs_with(ix: Index, term: str) -> DataFrame:
    return ix.of([term]).select("doc").distinct()


def parse_marks(query: str) -> dict[str, list[str]]:
    """Required (+), excluded (-), quoted and plain parts of a query."""
    out: dict[str, list[str]] = {"required": [], "excluded": [], "phrases": [], "plain": []}
    for mark, quoted, word in re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', query):
        kind = {"+": "required", "-": "excluded"}.get(mark, "phrases" if quoted else "plain")
        out[kind].append(quoted or word)
    return out


def _matching(ix: Index, part: str) -> DataFrame:
    words = query_tokens(part)
    return phrase(ix, words).select("doc") if len(words) > 1 else docs_with(ix, words[0] if words else "")


def marked_search(ix: Index, query: str, limit: int = 100) -> DataFrame:
    """Search with `+required -excluded "phrase"`: semi joins and anti joins before the score."""
    marks = parse_marks(query)
    terms = [t for k in ("required", "phrases", "plain") for p in marks[k] for t in query_tokens(p)]
    scored = bm25(ix, _weights(ix, terms), terms)
    for p in marks["required"] + marks["phrases"]:
        scored = scored.join(_matching(ix, p), "doc", "left_semi")
    for p in marks["excluded"]:
        scored = scored.join(_matching(ix, p), "doc", "left_anti")
    return scored.orderBy(F.desc("score"), "doc").limit(limit)


def boolean_docs(ix: Index, query: str) -> DataFrame:
    """Documents that satisfy a query of AND, OR, NOT, parentheses and quoted phrases; words side by side mean OR."""
    parts = re.findall(r'\(|\)|"[^"]*"|[^\s()"]+', query)
    everything = ix.docs.select("doc")

    def either(i: int) -> tuple[DataFrame, int]:
        left, i = both(i)
        while i < len(parts) and parts[i] != ")":
            right, i = both(i + (parts[i].upper() == "OR"))
            left = left.union(right).distinct()
        return left, i

    def both(i: int) -> tuple[DataFrame, int]:
        left, i = one(i)
        while i < len(parts) and parts[i].upper() == "AND":
            right, i = one(i + 1)
            left = left.join(right, "doc", "left_semi")
        return left, i

    def one(i: int) -> tuple[DataFrame, int]:
        if parts[i].upper() == "NOT":
            inner, i = one(i + 1)
            return everything.join(inner, "doc", "left_anti"), i
        if parts[i] == "(":
            inner, i = either(i + 1)
            return inner, i + 1
        return _matching(ix, parts[i].strip('"')), i + 1

    return either(0)[0]


def fuzzy_weights(ix: Index, query: str, most: int = 2) -> DataFrame:
    """The vocabulary's terms near to those of the query, with a penalty for each edit; idf stays the query term's. The
    vocabulary is cut by length and first letter before distances are taken."""
    made = []
    for t in query_tokens(query):
        made.append((t, 1.0, t, 1))
    spark = ix.postings.sparkSession
    exact = spark.createDataFrame(made, "term string, weight double, idf_term string, times int")
    long = [t for t, *_ in made if len(t) >= FUZZY_LENGTH]
    vocabulary = ix.vocabulary.select("term")
    near = []
    for t in long:
        close = vocabulary.where(F.col("term").startswith(t[:FUZZY_PREFIX]) & (F.abs(F.length("term") - len(t)) <= most) & (F.col("term") != t))
        near.append(close.where((F.levenshtein("term", F.lit(t)) <= 2 * most)).select("term", F.lit(t).alias("idf_term")))
    if not near:
        return exact
    pairs = functools.reduce(DataFrame.union, near)
    from veldoc.functions.text import edits

    close = pairs.withColumn("d", edits(most)("term", "idf_term")).where(F.col("d") <= most)
    return exact.union(close.select("term", (1 - FUZZY_PENALTY * F.col("d")).alias("weight"), "idf_term", F.lit(1).alias("times")))


def fuzzy_search(ix: Index, query: str, limit: int = 100, most: int = 2) -> DataFrame:
    """The near terms are found first, so that only their postings are read, and never shuffled but for their scores."""
    weights = kept(fuzzy_weights(ix, query, most))
    n = weights.limit(BROADCAST + 1).count()
    terms = [x["term"] for x in weights.select("term").distinct().collect()] if n <= NAMED else None
    out = bm25(ix, weights, terms, few=n <= BROADCAST)
    return out.orderBy(F.desc("score"), "doc").limit(limit)


def tf_idf(ix: Index, weighting: str = "log") -> DataFrame:
    """(doc, term, weight): log, augmented or raw frequency times the logarithm of n / df."""
    counts = ix.terms()
    top = ix.postings.groupBy("doc").agg(F.max("tf").alias("top"))
    tf = {"log": 1 + F.log("tf"), "augmented": 0.5 + 0.5 * F.col("tf") / F.col("top"), "raw": F.col("tf").cast("double")}[weighting]
    return ix.postings.select("doc", "term", "tf").join(counts, "term").join(top, "doc").select("doc", "term", (tf * F.log(F.lit(float(ix.n)) / F.col("df"))).alias("weight"))


def highlight(text: Column, query: str, left: str = "<b>", right: str = "</b>") -> Column:
    words = "|".join(map(re.escape, query_tokens(query)))
    return F.regexp_replace(text, rf"(?i)\b({words})\b", f"{left}$1{right}") if words else text


def snippet(text: Column, query: str, before: int = 50, after: int = 100) -> Column:
    """The piece of a text around the first term of the query that it has; its beginning if it has none."""
    low = F.lower(text)
    places = [F.nullif(F.instr(low, w), F.lit(0)) for w in query_tokens(query)]
    first = F.coalesce(F.array_min(F.array(*places)) if places else F.lit(None), F.lit(1))
    start = F.greatest(first - before, F.lit(1))
    return F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, F.lit(before + after)), F.when(F.length(text) >= start + before + after, "...").otherwise(""))


def bm25_of(tf: int, df: int, n: int, length: float, mean: float) -> float:
    """One term's score, for tests."""
    return max(0.0, math.log((n - df + 0.5) / (df + 0.5) + 1)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


__all__ = ["Index", "index", "save", "load", "search", "phrase_search", "marked_search", "boolean_docs", "fuzzy_search", "tf_idf", "highlight", "snippet", "damerau"]
