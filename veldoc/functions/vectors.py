"""Distances and scores of vectors, in double precision, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """1 less the cosine distance."""
    return 1 - cosine_distance(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; 0 between two zero vectors, 1 between a zero vector and another one."""
    na, nb = norm(a), norm(b)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), na * nb)))
    return F.when((na == 0) & (nb == 0), 0.0).when((na == 0) | (nb == 0), 1.0).otherwise(1 - cosine)


def squared_distance(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean_distance, "dot": dot_distance}


def score(distance: Column, metric: str) -> Column:
    return {"cosine": lambda d: 1 - d, "euclidean": lambda d: F.exp(-d), "dot": lambda d: -d}[metric](distance)


def normalised(a: Column) -> Column:
    """Of length 1; the zero vector stays."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def top_k(df: DataFrame, query: list[float], k: int, metric: str = "cosine", vector: str = "embedding", key: str = "vec_id", most: float | None = None) -> DataFrame:
    """The k nearest rows to one vector, exactly, with distance and score; ties to the smaller key. Each partition keeps
    its own k best, so k rows a partition are moved."""
    d = DISTANCES[metric](F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    out = df.withColumn("distance", d).withColumn("score", score(F.col("distance"), metric))
    out = out.where(F.col("distance") <= most) if most is not None else out
    return out.orderBy("distance", key).limit(k)


def strategy(candidates: int, total: int, k: int) -> str:
    """Whether to filter before the search or after it, by the share of rows that pass."""
    share = candidates / total if total else 0.0
    return "pre" if candidates < 2 * k else "post" if share > 0.8 and total > 1000 else "pre"


def strategy_of(candidates: Column, total: Column, k: int) -> Column:
    """`strategy` of many filters at once, as a column."""
    return F.when(candidates < 2 * k, "pre").when((candidates > 0.8 * total) & (total > 1000), "post").otherwise("pre")


def filtered_top_k(df: DataFrame, query: list[float], k: int, keep: Column, how: str = "pre", metric: str = "cosine", **options: str) -> DataFrame:
    """The k nearest rows that pass a filter: filtered first, or, `post`, the best 3k of all filtered afterwards."""
    if how == "pre":
        return top_k(df.where(keep), query, k, metric, **options)
    return top_k(df, query, 3 * k, metric, **options).where(keep).orderBy("distance", options.get("key", "vec_id")).limit(k)


def normalised_search(spec: dict) -> dict:
    """A vector search in its present form, from the present or the former one ($near, $k, $field, $minScore)."""
    return {"query": spec.get("query", spec.get("$near")), "topK": spec.get("topK", spec.get("$k", 10)), "field": spec.get("field", spec.get("$field", "embedding")), "minScore": spec.get("minScore", spec.get("$minScore"))}
