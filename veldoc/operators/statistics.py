"""Rollups of requests, errors, costs and evaluations: percentiles, histograms, trends, anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veldoc.functions.expressions import error_class, severity, status_category, time_bucket


def percentiles(c: Column, ps: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> list[Column]:
    """Interpolated percentiles, named p50 and so on."""
    return [F.percentile(c, F.lit(p)).alias(f"p{round(p * 100)}") for p in ps]


def nearest_rank(name: str, p: float) -> Column:
    """The least value that a share p of values does not exceed."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{name}`)")


def request_metrics(df: DataFrame, by: Sequence[str], status: str, latency: str, cached: str) -> DataFrame:
    """Totals, shares and latencies for each group, and the number of requests by category as a sorted map."""
    category = status_category(F.col(status))
    counts = df.groupBy(*by, category.alias("category")).agg(F.count("*").alias("n"))
    maps = counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("by_status"))
    bad, hit = F.col(status) >= 400, F.col(cached)
    out = df.groupBy(*by).agg(F.count("*").alias("total"), F.sum(bad.cast("long")).alias("errors"), F.avg(bad.cast("double")).alias("error_rate"), F.avg(hit.cast("double")).alias("cache_ratio"), F.avg(latency).alias("mean_latency"), F.min(latency).alias("min_latency"), F.max(latency).alias("max_latency"), *percentiles(F.col(latency)))
    return out.join(maps, list(by))


def path_summary(df: DataFrame, path: str, latency: str, status: str) -> DataFrame:
    return df.groupBy(path).agg(F.count("*").alias("total"), F.sum((F.col(status) >= 400).cast("long")).alias("errors"), F.avg(latency).alias("mean_latency"), *percentiles(F.col(latency), (0.5, 0.95)))


def costs(df: DataFrame, prices: DataFrame, by: Sequence[str], tokens_in: str, tokens_out: str, model: str = "model") -> DataFrame:
    """Tokens and costs by group, at the prices for each thousand tokens; models without a price cost 0."""
    priced = df.join(prices, model, "left")
    cost = F.coalesce(F.col(tokens_in) * F.col("price_in") / 1000 + F.col(tokens_out) * F.col("price_out") / 1000, F.lit(0.0))
    return priced.groupBy(*by).agg(F.count("*").alias("requests"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"), F.sum(cost).alias("cost"))


def histogram(df: DataFrame, value: str, n: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """n bins of equal width; the highest value falls into the last."""
    size = (high - low) / n
    bin_ = F.greatest(F.lit(0), F.least(F.floor((F.col(value) - low) / size), F.lit(n - 1)))
    return df.where(F.col(value).isNotNull()).groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def bands(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of excellent (0.9 or more), good (0.7), fair (0.5) and poor."""
    c = F.col(value)
    count = lambda t: F.sum(F.coalesce(t, F.lit(False)).cast("long"))
    return df.groupBy(*by).agg(count(c >= 0.9).alias("excellent"), count((c >= 0.7) & (c < 0.9)).alias("good"), count((c >= 0.5) & (c < 0.7)).alias("fair"), count(c < 0.5).alias("poor"))


def trend(df: DataFrame, ts: str, unit: str, value: str) -> DataFrame:
    """Mean by bucket of time, and its change to the bucket before."""
    out = df.groupBy(time_bucket(F.col(ts), unit).alias("bucket")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.withColumn("change", F.col("mean") - F.lag("mean").over(W.orderBy("bucket")))


def compared(df: DataFrame, side: Column, by: str, value: str, least: int = 30, share: float = 0.05) -> DataFrame:
    """Means of two sides (true and false) by group; significant if they differ by more than a share and both have
    enough rows."""
    mean = lambda t: F.avg(F.when(t, F.col(value)))
    count = lambda t: F.sum(t.cast("long"))
    out = df.groupBy(by).agg(mean(side).alias("a"), mean(~side).alias("b"), count(side).alias("n_a"), count(~side).alias("n_b"))
    rel = F.try_divide(F.col("b") - F.col("a"), F.col("a"))
    return out.withColumn("relative", rel).withColumn("significant", F.coalesce((F.abs(rel) > share) & (F.col("n_a") >= least) & (F.col("n_b") >= least), F.lit(False)))


def anomalies(df: DataFrame, by: str, order: Sequence[str], value: str, n: int = 50, limit: float = 3.0) -> DataFrame:
    """Each row's distance, in standard deviations, from the mean of the n rows before it."""
    before = W.partitionBy(by).orderBy(*order).rowsBetween(-n, -1)
    sigma = F.stddev_pop(value).over(before)
    z = F.when(sigma > 0, (F.col(value) - F.avg(value).over(before)) / sigma).otherwise(0.0)
    return df.withColumn("z", F.coalesce(z, F.lit(0.0))).withColumn("anomalous", F.abs("z") > limit)


def error_rollup(df: DataFrame, message: str, status: str) -> DataFrame:
    return df.groupBy(error_class(F.col(message)).alias("category"), severity(F.col(status)).alias("severity")).agg(F.count("*").alias("n"))


def levels(df: DataFrame, level: str) -> DataFrame:
    return df.groupBy(F.lower(level).alias("level")).agg(F.count("*").alias("n"))


def newest_versions(df: DataFrame, key: str, order: Sequence[str], content: str) -> DataFrame:
    """Of each key the last row and the number of distinct contents that it has had."""
    rest = [c for c in df.columns if c != key]
    top = F.max(F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row")))
    return df.groupBy(key).agg(top.alias("_top"), F.count_distinct(content).alias("contents")).select(key, "_top._row.*", "contents")


def limit_alerts(df: DataFrame, ts: str, by: str, window: str, most: int) -> DataFrame:
    """Windows in which a group goes beyond its limit, or uses more than 80 % of it."""
    out = df.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n"))
    state = F.when(F.col("n") > most, "exceeded").when(F.col("n") > 0.8 * most, "warning").otherwise("ok")
    return out.select(F.col("w.start").alias("start"), by, "n", state.alias("state"))


def prometheus(df: DataFrame, name: str, labels: Sequence[str], value: str) -> DataFrame:
    """Lines of the Prometheus text format."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))
