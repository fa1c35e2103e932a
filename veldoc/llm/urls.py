"""URL filters over time, in DataFrame operations only.

A list entry names a rule (a host, a domain above hosts, or a host and the first step of its path), an action and the
day from which it holds. The entries of a rule become validity intervals: each holds until the next. A capture is
tested against the intervals that hold when it is fetched, by an equi-join on rule and block of days; of the rules that
match the most specific decides.

Entries of one rule and day are reduced to the last one before anything is joined, so a rule has at most one interval a
day, however often it is listed; a host with a third of all captures meets only that many rows, in a join whose
large side Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: Days of a block: intervals are listed once for each block that they touch.
BLOCK = 32
#: An interval without an end is listed up to the last day fetched.
_OUT = ("rule", "action", "since", "until")


def host_of(url: Column) -> Column:
    """The host, lower-cased and without user, port and a leading www.; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def rules_of(url: Column) -> Column:
    """The rules that a URL can match, the most specific first: host and first step of the path, host, domains above
    it down to two labels."""
    host = host_of(url)
    step = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(F.when(step != "", F.array(F.concat(host, F.lit("/"), step))).otherwise(F.array().cast("array<string>")), domains))


def intervals(entries: DataFrame) -> DataFrame:
    """(rule, action, since, until) from (rule, action, day, seq): until is the day of the rule's next entry, or null.
    Of several entries of a rule on one day the one of greatest seq, then action, holds. Entries without a rule or
    day are void; a null action lifts the rule (`allow`)."""
    last = entries.where("rule is not null and day is not null").groupBy("rule", F.col("day").cast("int").alias("since"))
    last = last.agg(F.max(F.struct("seq", F.coalesce("action", F.lit("allow")).alias("action"))).alias("top"))
    order = W.partitionBy("rule").orderBy("since")
    return last.select("rule", F.col("top.action").alias("action"), "since", F.lead("since").over(order).alias("until"))


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day", key_col: str = "page_id") -> DataFrame:
    """`captures` with the rule, action, since and until of the entry that decides (null, `allow`, null, null without one).

    A null or malformed URL matches no rule, a null day no interval. Each row of `captures` stays; rows that have key, URL
    and day in common share the verdict. Columns named like the results are replaced, other names may be any.
    """
    kept = [c for c in captures.columns if c not in _OUT]
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(key_col).alias("k"), F.col(url_col).alias("u"), F.col(day_col).cast("int").alias("d"))
    asked = rows.where("d is not null").select("k", "u", "d").distinct()
    asked = asked.select("k", "u", "d", F.posexplode(rules_of(F.col("u"))).alias("rank", "rule")).withColumn("block", F.floor(F.col("d") / BLOCK))
    bounds = captures.agg(F.max(F.col(day_col).cast("int")), F.min(F.col(day_col).cast("int"))).first()
    held = intervals(entries)
    if bounds[0] is None:
        held = held.where(F.lit(False))
    low, high = bounds[1] or 0, bounds[0] or 0
    ends = F.least(F.coalesce(F.col("until") - 1, F.lit(high)), F.lit(high))
    starts = F.greatest(F.col("since"), F.lit(low))
    held = held.where(ends >= starts).withColumn("block", F.explode(F.sequence(F.floor(starts / BLOCK), F.floor(ends / BLOCK))))
    now = (asked["d"] >= held["since"]) & (held["until"].isNull() | (asked["d"] < held["until"]))
    met = asked.join(held, (asked["rule"] == held["rule"]) & (asked["block"] == held["block"]) & now)
    best = met.groupBy("k", "u", "d").agg(F.min(F.struct("rank", held["rule"].alias("rule"), "action", "since", "until")).alias("best"))
    same = rows["k"].eqNullSafe(best["k"]) & rows["u"].eqNullSafe(best["u"]) & (rows["d"] == best["d"])
    out = rows.join(best, same, "left")
    return out.select("row.*", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("action"), F.col("best.since").alias("since"), F.col("best.until").alias("until"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each row of `pages`. The table has no dates, so they follow from its ids: a page is fetched on day
    (37 id mod 365), and each page whose id is divisible by 7 or whose host is a farm or sells pills enters, on day
    (53 id mod 365), a rule into the list: its host, or its host and path step if the id is odd; to be allowed
    again if the id leaves 2 when divided by 3, to be blocked otherwise."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = lambda n: ((F.col("page_id") * n) % 365).cast("int")
    listed = pages.where((F.col("page_id") % 7 == 0) | host_of(F.col("url")).rlike("(^|[.])(spam-farm|cheap-pills)[.]"))
    rules = rules_of(F.col("url"))
    rule = F.when((F.col("page_id") % 2 == 1) | ~F.get(rules, F.lit(0)).contains("/"), F.get(rules, F.lit(0))).otherwise(F.get(rules, F.lit(1)))
    entries = listed.select(rule.alias("rule"), F.when(F.col("page_id") % 3 == 2, "allow").otherwise("block").alias("action"), day(53).alias("day"), F.col("page_id").alias("seq"))
    found = filter_urls(pages.withColumn("day", day(37)), entries)
    return found.select("page_id", "day", "rule", "action", "since", "until")


ORACLE = r"""
WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS host,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)) AS step,
    CAST((page_id * 37) % 365 AS INTEGER) AS d, CAST((page_id * 53) % 365 AS INTEGER) AS ed FROM pages),
r AS (SELECT page_id, d, 0 AS rank, host || '/' || step AS rule FROM p WHERE host <> '' AND step <> ''
    UNION ALL SELECT page_id, d, i AS rank, array_to_string(l[i:], '.') AS rule FROM (SELECT page_id, d, l, unnest(range(1, greatest(1, len(l) - 1) + 1)) AS i FROM (SELECT *, string_split(host, '.') AS l FROM p WHERE host <> ''))),
e AS (SELECT CASE WHEN step <> '' AND page_id % 2 = 1 THEN host || '/' || step ELSE host END AS rule, CASE WHEN page_id % 3 = 2 THEN 'allow' ELSE 'block' END AS action, ed AS since, page_id
    FROM p WHERE host <> '' AND (page_id % 7 = 0 OR regexp_matches(host, '(^|[.])(spam-farm|cheap-pills)[.]'))),
one AS (SELECT rule, since, arg_max(action, page_id) AS action FROM e GROUP BY rule, since),
iv AS (SELECT *, lead(since) OVER (PARTITION BY rule ORDER BY since) AS until FROM one),
m AS (SELECT r.page_id, r.rank, iv.rule, action, since, until FROM r JOIN iv ON r.rule = iv.rule AND r.d >= since AND (until IS NULL OR r.d < until)),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank) = 1)
SELECT p.page_id, p.d AS day, b.rule, coalesce(b.action, 'allow') AS action, b.since, b.until FROM p LEFT JOIN b USING (page_id)
"""
