"""A faceted search service over a collection: additive term scores, filters, facets, statistics, buckets, grouping,
spelling, completion, similar documents, and fusion with vector search. All matches count, not a capped list of them."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from veldoc.functions.text import STOP_WORDS, light_stem

#: Points of each kind of match.
POINTS = {"exact": 10, "stem": 5, "wildcard": 4, "synonym": 3, "prefix": 2, "fuzzy": 1}
#: Synonyms of single words.
SYNONYMS = {"movie": ["film"], "film": ["movie"], "tv": ["television"], "television": ["tv"], "car": ["automobile"], "big": ["large"], "large": ["big"], "fast": ["quick"], "quick": ["fast"], "buy": ["purchase"], "photo": ["picture"], "picture": ["photo"]}
#: Presets of parameters.
TEMPLATES = {"recent": {"sort": {"date": -1}, "limit": 20}, "top": {"sort": {"score": -1}, "limit": 10}, "all": {"limit": 100}}
PREFIX_ROOM, PREFIX_LENGTH, FUZZY_LENGTH = 5, 3, 4
RRF_K, RRF_WEIGHT = 60, 0.5


def analyse(text: Column, how: str = "simple") -> Column:
    """Terms of a text. simple: runs of letters, digits and underscores, of two or more; english: those without stop
    words, stemmed lightly; keyword: the whole text."""
    if how == "keyword":
        return F.array(F.lower(text))
    terms = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+"), lambda w: F.length(w) >= 2)
    return terms if how == "simple" else F.transform(F.filter(terms, lambda w: ~w.isin(STOP_WORDS)), light_stem)


def parse(query: str) -> dict[str, list[str]]:
    """Plain, must (+), not (-), phrase, prefix (*) and fuzzy (~) terms. Must terms count, but aren't demanded."""
    out: dict[str, list[str]] = {k: [] for k in ("plain", "must", "not", "phrase", "prefix", "fuzzy")}
    for mark, quoted, word in re.findall(r'([+-]?)(?:"([^"]*)"|(\S+))', query.lower()):
        if quoted:
            out["phrase"].append(quoted)
        elif mark:
            out["must" if mark == "+" else "not"].append(word)
        elif word.endswith("*"):
            out["prefix"].append(word[:-1])
        elif word.endswith("~"):
            out["fuzzy"].append(word[:-1])
        else:
            out["plain"].append(word)
    return out


def postings(df: DataFrame, key: str, text: str, how: str = "simple") -> DataFrame:
    """(doc, term), each once."""
    return df.select(F.col(key).alias("doc"), F.explode(F.array_distinct(analyse(F.col(text), how))).alias("term"))


def vocabulary(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def term_points(vocab: DataFrame, query: str, boosts: Mapping[str, float] | None = None) -> DataFrame:
    """(term, points): the vocabulary's terms that a query's terms reach, by kind of match; points of several add up."""
    parsed = parse(query)
    boosts = boosts or {}
    t, parts = F.col("term"), []
    for q in parsed["plain"] + parsed["must"]:
        boost = float(boosts.get(q, 1.0))
        kinds = F.when(t == q, POINTS["exact"]).when(light_stem(t) == light_stem(F.lit(q)), POINTS["stem"])
        if q in SYNONYMS:
            kinds = kinds.when(t.isin(SYNONYMS[q]), POINTS["synonym"])
        if len(q) >= PREFIX_LENGTH:
            kinds = kinds.when(t.startswith(q) & (F.length(t) - len(q) <= PREFIX_ROOM), POINTS["prefix"])
        if len(q) >= FUZZY_LENGTH:
            kinds = kinds.when(F.levenshtein(t, F.lit(q), 1) == 1, POINTS["fuzzy"])
        parts.append(kinds * boost)
    parts += [F.when(t.startswith(q), POINTS["wildcard"] * float(boosts.get(q, 1.0))) for q in parsed["prefix"]]
    parts += [F.when((t == q) | (F.levenshtein(t, F.lit(q), 1) == 1), POINTS["fuzzy"] * float(boosts.get(q, 1.0))) for q in parsed["fuzzy"]]
    total = functools.reduce(lambda a, b: a + b, [F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts], F.lit(0.0))
    return vocab.select("term", total.alias("points")).where(F.col("points") != 0)


def scores(post: DataFrame, query: str, boosts: Mapping[str, float] | None = None) -> DataFrame:
    """(doc, score) of the documents reached, without those that have a term excluded by the query."""
    found = post.join(term_points(vocabulary(post), query, boosts), "term").groupBy("doc").agg(F.sum("points").alias("score"))
    for q in parse(query)["not"]:
        found = found.join(post.where((F.col("term") == q) | (light_stem(F.col("term")) == light_stem(F.lit(q)))).select("doc"), "doc", "left_anti")
    return found


def did_you_mean(vocab: DataFrame, word: str) -> DataFrame:
    """The most frequent of the nearest terms: up to 3 edits, 2 letters of difference in length."""
    near = vocab.where((F.abs(F.length("term") - len(word)) <= 2) & (F.col("term") != word)).withColumn("d", F.levenshtein("term", F.lit(word), 3)).where("d >= 0")
    return near.orderBy("d", F.desc("df"), "term").limit(1)


def complete(vocab: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return vocab.where(F.col("term").startswith(prefix)).orderBy(F.desc("df"), "term").limit(limit if len(prefix) >= 2 else 0)


def filtered(df: DataFrame, equals: Mapping[str, Sequence] | None = None, excluded: Mapping[str, Sequence] | None = None, at_least: Mapping[str, float] | None = None, at_most: Mapping[str, float] | None = None, has: Sequence[str] = ()) -> DataFrame:
    """Values of a field or each other, fields and together; ranges on numbers, of which text that is none is outside."""
    tests = [F.col(f).isin(list(v)) for f, v in (equals or {}).items()]
    tests += [~F.coalesce(F.col(f).isin(list(v)), F.lit(False)) for f, v in (excluded or {}).items()]
    tests += [F.col(f).try_cast("double") >= v for f, v in (at_least or {}).items()]
    tests += [F.col(f).try_cast("double") <= v for f, v in (at_most or {}).items()]
    tests += [F.col(f).isNotNull() for f in has]
    return functools.reduce(lambda d, t: d.where(t), tests, df)


def distinct_by(df: DataFrame, field: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each value; null is the empty text's equal."""
    rank = F.row_number().over(W.partitionBy(F.coalesce(F.col(field).cast("string"), F.lit(""))).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def facet(df: DataFrame, field: str, limit: int = 10) -> DataFrame:
    """(value, count) of the most frequent values; elements of arrays count by themselves."""
    value = F.explode(field) if isinstance(df.schema[field].dataType, T.ArrayType) else F.col(field)
    return df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def statistics(df: DataFrame, field: str) -> DataFrame:
    c = F.col(field).cast("double")
    return df.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), 1).alias("avg"), F.sum(c).alias("sum"), F.count(c).alias("count"), F.round(F.var_pop(c), 2).alias("variance"))


def histogram(df: DataFrame, field: str, size: float) -> DataFrame:
    low = (F.floor(F.col(field) / size) * size).alias("from")
    return df.where(F.col(field).isNotNull()).groupBy(low).agg(F.count("*").alias("count")).select("from", (F.col("from") + size).alias("to"), "count").orderBy("from")


def top_per_group(df: DataFrame, field: str, order: Sequence[Column], n: int = 3) -> DataFrame:
    by = F.coalesce(F.col(field).cast("string"), F.lit("null"))
    return df.withColumn("group", by).withColumn("rank", F.row_number().over(W.partitionBy("group").orderBy(*order))).where(F.col("rank") <= n)


def similar(df: DataFrame, post: DataFrame, key: str, title: str, doc: Any) -> DataFrame:
    """Documents like one: its first three telling title terms as a query, itself left out."""
    row = df.where(F.col(key) == F.lit(doc)).select(title).first()
    terms = [w for w in re.findall(r"[a-z0-9_]+", (row[0] if row else "").lower()) if len(w) >= 3 and w not in STOP_WORDS][:3]
    return scores(post, " ".join(terms)).where(F.col("doc") != F.lit(doc))


def by_template(df: DataFrame, name: str, ties: str, **changes: Any) -> DataFrame:
    """A search by a preset of parameters, some of them changed; `ties` orders equal rows."""
    spec = {**TEMPLATES[name], **changes}
    order = [F.desc_nulls_first(k) if v == -1 else F.asc_nulls_last(k) for k, v in spec.get("sort", {}).items()]
    return df.orderBy(*order, ties).offset(spec.get("offset", 0)).limit(spec["limit"])


def filter_first(df: DataFrame, post: DataFrame, key: str, spec: Column, terms: Sequence[str]) -> DataFrame:
    """(doc, score): filters and the sets of each term are intersected before anything is scored; 10 for each term. A
    term reaches itself, its stem and up to five words that it begins; one that reaches nothing is passed over."""
    out, used = df.where(spec).select(F.col(key).alias("doc")), 0
    for q in terms:
        vocab = vocabulary(post).where((F.col("term") == q) | (light_stem(F.col("term")) == light_stem(F.lit(q))))
        begun = vocabulary(post).where(F.col("term").startswith(q) & (F.col("term") != q)).orderBy(F.desc("df"), "term").limit(5)
        docs = post.join(F.broadcast(vocab.select("term").union(begun.select("term")).distinct()), "term", "left_semi").select("doc").distinct()
        if not docs.isEmpty():
            out, used = out.join(docs, "doc", "left_semi"), used + 1
    return out.select("doc", F.lit(10 * used).alias("score"))


def page_of(df: DataFrame, size: int, cursor: str | None = None) -> tuple[DataFrame, str]:
    """A page of a sorted search and the cursor of the page behind it: base64 of the offset, as the service gives it. A
    cursor that can't be read begins at the first row."""
    try:
        offset = max(0, int(base64.b64decode(cursor or "", validate=True) or b"0"))
    except ValueError:
        offset = 0
    return df.offset(offset).limit(size), base64.b64encode(str(offset + size).encode()).decode()


def fused(text: DataFrame, vector: DataFrame, k: int = RRF_K, weight: float = RRF_WEIGHT) -> DataFrame:
    """Reciprocal rank fusion of (doc, score) of a text search and of a vector search, each the top rows of a search."""
    ranked = lambda df, name: df.withColumn(name, F.row_number().over(W.orderBy(F.desc("score"), "doc"))).select("doc", name)
    both = ranked(text, "text_rank").join(ranked(vector, "vector_rank"), "doc", "full_outer")
    part = lambda w, c: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    return both.select("doc", (part(F.lit(weight), "text_rank") + part(F.lit(1 - weight), "vector_rank")).alias("score"))
