"""A quality classifier whose evidence from the text is combined with what is known of the site.

Two logistic models, of poor and of toxic texts, are fitted to a bounded sample of labelled rows. All documents are
scored; the expected share of bad ones is summed by host and by path, in grouped aggregates. Hosts are shrunk toward
the global share and paths toward their host, by as many pseudo-documents as the spread between the groups tells
(empirical Bayes by moments), so a sparse site says little. The log odds of a document are moved by the difference
between its path's share and the global one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veldoc.llm.common import small_batches, stored, text_key
from veldoc.llm.hashing import buffers, word_chunks

#: Labelled rows that the models are fitted to at most, those of least hash of their id: this bounds what goes to the driver.
FIT_ROWS = 12_000
#: Words (by hash) that each model may weigh, those that tell most; rows of the sample in which a word must occur.
FIT_WORDS, MIN_ROWS = 256, 5
#: The share of bad ones is kept away from 0 and 1 by this much, and a site moves the log odds by this much at most.
EPS, MOST_SHIFT = 1e-4, 2.0
_OUT = ("keep", "bad", "toxic", "poor", "host_rate", "path_rate")
#: Classes of bytes whose shares of a text are features.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".", b",", b"!?", b"|", b"#$%&*", b"<>{}[]();=/\\", b"\"'-_:@+~^`"]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
N_SHAPE = len(_CLASSES) + 1 + 3


def shape_features(column: pa.Array) -> np.ndarray:
    """Shares of classes of bytes, length, and mean and spread of word lengths, for each text."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    out = np.zeros((n, N_SHAPE))
    width = len(_CLASSES) + 1
    for lo, hi, own, rows, hashes, starts, ends in word_chunks(column):
        owner = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
        counts = np.bincount(owner * width + _CLASS[own], minlength=(hi - lo) * width).reshape(-1, width)
        size = np.maximum(counts.sum(axis=1), 1)
        out[lo:hi, :width] = np.sqrt(counts / size[:, None])
        found = np.maximum(np.bincount(rows, minlength=hi - lo), 1)
        length = (ends - starts).astype(float)
        mean = np.bincount(rows, length, minlength=hi - lo) / found
        out[lo:hi, width] = np.log1p(found) / 10
        out[lo:hi, width + 1] = mean / 10
        out[lo:hi, width + 2] = np.sqrt(np.maximum(np.bincount(rows, length**2, minlength=hi - lo) / found - mean**2, 0)) / 10
    return out


@dataclass
class Logistic:
    """Weights of words (by hash, sorted), of standardised shape features and of 1."""

    words: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0

    def logits(self, shape: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        out = (shape - self.mean) / self.scale @ self.weights[len(self.words) : -1] + self.weights[-1]
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[at] == hashes
            once = np.unique(rows[hit] * len(self.words) + at[hit])
            out += np.bincount(once // len(self.words), self.weights[once % len(self.words)], minlength=len(out))
        return out


def fit_logistic(shape: np.ndarray, rows: np.ndarray, hashes: np.ndarray, bad: np.ndarray, ridge: float = 0.3) -> Logistic:
    """Newton's method with a ridge, on the words whose presence tells most about `bad` (by chi squared)."""
    n, base = len(bad), bad.mean()
    names, inverse = np.unique(hashes, return_inverse=True)
    seen = np.bincount(inverse, minlength=len(names))
    with_bad = np.bincount(inverse, bad[rows].astype(float), minlength=len(names))
    chi = np.where(seen >= MIN_ROWS, (with_bad - seen * base) ** 2 / np.maximum(seen * base * (1 - base), 1e-9), 0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:FIT_WORDS])
    chosen = chosen[chi[chosen] > 12]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    mean, scale = shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-3)
    x = np.zeros((n, len(chosen) + shape.shape[1] + 1), np.float32)
    hit = place[inverse] >= 0
    x[rows[hit], place[inverse[hit]]] = 1
    x[:, len(chosen) : -1] = (shape - mean) / scale
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    w[-1] = np.log(max(base, EPS) / max(1 - base, EPS))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - bad) + penalty * w
        bend = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return Logistic(names[chosen], mean, scale, w)


@dataclass
class Model:
    poor: Logistic
    toxic: Logistic


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        shape = shape_features(b.column("text"))
        for lo, hi, _, rows, hashes, _, _ in word_chunks(b.column("text")):
            order = np.lexsort((hashes, rows))
            r, h = rows[order], hashes[order]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])]) if len(r) else np.zeros(0, bool)
            ends = np.concatenate([[0], np.cumsum(np.bincount(r[new], minlength=hi - lo))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[new].view(np.int64)))
            shapes = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * N_SHAPE), pa.array(shape[lo:hi].reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo), b.column("quality").slice(lo, hi - lo), b.column("toxic").slice(lo, hi - lo), lists, shapes], ["node", "quality", "toxic", "words", "shape"])


def _telling(rows: DataFrame) -> list[int]:
    """The words that tell most about either label, FIT_WORDS for each: counted and ranked by grouped aggregates."""
    bad = {"poor": (F.col("quality") == 0).cast("double"), "toxic": (F.col("toxic") == 1).cast("double")}
    n, *sums = rows.agg(F.count("*"), *[F.sum(b) for b in bad.values()]).first()
    if not n:
        return []
    counts = rows.select(F.explode("words").alias("word"), *[b.alias(c) for c, b in bad.items()]).groupBy("word")
    counts = stored(counts.agg(F.count("*").alias("seen"), *[F.sum(c).alias(c) for c in bad]).where(F.col("seen") >= MIN_ROWS), "words")
    out: set[int] = set()
    for c, total in zip(bad, sums):
        base = total / n
        chi = (F.col(c) - F.col("seen") * base) ** 2 / F.greatest(F.col("seen") * (base * (1 - base)), F.lit(1e-9))
        out |= {r["word"] for r in counts.orderBy(F.desc(chi), "word").limit(FIT_WORDS).collect()}
    return sorted(out)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Fits both models to the labelled rows of least hash, `rows` at most. Equal texts count once; of labels that
    contradict each other the worst holds (quality 0, toxic 1). Labels that are null count as 1 for quality and 0 for
    toxic. Without any labelled text all documents are good.

    What goes to the driver is bounded by `rows` and FIT_WORDS, however long the texts are and however often they repeat.
    """
    small_batches(docs.sparkSession)
    sample = labels.select(F.col(id_col).alias("label_id"), F.coalesce("quality", F.lit(1)).cast("int").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("int").alias("toxic"))
    sample = sample.where(F.col("label_id").isNotNull()).orderBy(F.xxhash64("label_id"), "label_id", "quality", F.desc("toxic")).limit(rows)
    texts = docs.select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(sample), "label_id").withColumn("node", text_key(F.col("text")))
    found = found.groupBy("node").agg(F.first("text").alias("text"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    schema = "node long, quality int, toxic int, words array<long>, shape array<double>"
    held = stored(found.select("text", "node", "quality", "toxic").mapInArrow(_distinct_words, schema), "labelled")
    names = _telling(held)
    chosen = F.filter("words", lambda w: w.isin(names)) if names else F.array().cast("array<long>")
    got = held.select("node", "quality", "toxic", chosen.alias("words"), "shape").toArrow()
    if got.num_rows == 0:
        none = Logistic(np.zeros(0, np.uint64), np.zeros(N_SHAPE), np.ones(N_SHAPE), np.concatenate([np.zeros(N_SHAPE), [-20.0]]))
        return Model(none, none)
    got = got.sort_by("node").combine_chunks()
    lists = got.column("words").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    owner, hashes = np.repeat(np.arange(got.num_rows), sizes), lists.flatten().to_numpy().view(np.uint64)
    shape = np.array(got.column("shape").to_pylist())
    return Model(fit_logistic(shape, owner, hashes, (got.column("quality").to_numpy() == 0).astype(float)), fit_logistic(shape, owner, hashes, (got.column("toxic").to_numpy() == 1).astype(float)))


def _evidence(docs: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    """`kept` columns of `docs` and the log odds that its column text_in is poor and toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two models of FIT_WORDS weights: some KB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("text_in"))
            shape = shape_features(column)
            poor, toxic = np.zeros(len(shape)), np.zeros(len(shape))
            for lo, hi, _, rows, hashes, _, _ in word_chunks(column):
                poor[lo:hi] = shared.value.poor.logits(shape[lo:hi], rows, hashes)
                toxic[lo:hi] = shared.value.toxic.logits(shape[lo:hi], rows, hashes)
            own = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(poor), pa.array(toxic)], [*kept, "poor_", "toxic_"])

    rows = docs.select(*dict.fromkeys([*kept, "text_in"]))
    schema = docs.select(*kept).schema.add("poor_", "double").add("toxic_", "double")
    return rows.mapInArrow(score, schema)


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _log_odds(rate: Column) -> Column:
    return F.log(rate / (1 - rate))


def site_rates(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_rate, path_rate), shares of bad documents after shrinking, and the global share; from columns
    host, path, bad. Only sums over all sites go to the driver."""
    paths = stored(scored.groupBy("host", "path").agg(F.sum("bad").alias("s"), F.count("*").alias("n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    total = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    base = min(1 - EPS, max(EPS, total or EPS))

    def strength(groups: DataFrame, s: str, n: str, around: Column) -> float:
        """Pseudo-documents: the spread between groups, less what chance gives, against the variance of one document."""
        sums = groups.select(F.col(s).alias("s"), F.col(n).alias("n"), around.alias("m")).agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("m")) ** 2), F.sum(F.col("m") * (1 - F.col("m"))), F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))), F.sum("n")).first()
        if not sums[3]:
            return 10.0
        spread, noise, level = (x / sums[3] for x in sums[:3])
        return min(1e6, max(10.0, level / max(spread - noise, 1e-9)))

    clip = lambda c: F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), c))
    k = strength(hosts, "hs", "hn", F.lit(base))
    hosts = hosts.select("host", clip((F.col("hs") + k * base) / (F.col("hn") + k)).alias("host_rate"))
    paths = paths.join(hosts, "host")
    k = strength(paths, "s", "n", F.col("host_rate"))
    return paths.select("host", "path", "host_rate", clip((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), base


def judge(docs: DataFrame, model: Model, text_col: str = "text", host_col: str = "source", path_col: str = "lang", limit: float = 0.5, with_text: bool = True) -> DataFrame:
    """`docs`, each row once, with the chances `poor`, `toxic` and `bad` (either), the shrunken shares of the row's host
    and path, and `keep`: whether `bad` is under `limit`.

    Null hosts and paths count as the empty one; a null text is an empty one and is judged by its site and shape.
    Columns of `docs` named like the results are replaced, other names may be any. Texts are read twice and scored
    twice, which costs less than to shuffle them: only sums by site are shuffled. Sites are joined by a shuffle or a
    broadcast, as Spark's own figures of the sizes tell. `with_text=False` leaves the text out.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in _OUT]
    rest = [c for c in kept if c != text_col]
    host, path = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (host_col, path_col))
    rows = F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in rest])
    keyed = docs.select(rows.alias("row_"), F.col(text_col).alias("text_in"), host.alias("host"), path.alias("path"))
    either = (1 - (1 - _chance(F.col("poor_"))) * (1 - _chance(F.col("toxic_")))).alias("bad")
    rates, base = site_rates(_evidence(keyed, model, ["host", "path"]).select("host", "path", either))
    scored = _evidence(keyed, model, ["row_", "host", "path", *["text_in"] * with_text]).join(stored(rates, "sites"), ["host", "path"], "left")
    shift = F.greatest(F.lit(-MOST_SHIFT), F.least(F.lit(MOST_SHIFT), _log_odds(F.col("path_rate")) - _log_odds(F.lit(base))))
    own = [F.col("text_in").alias(c) if c == text_col else F.col(f"row_.`{c}`") for c in kept if with_text or c != text_col]
    out = scored.select(F.struct(*own).alias("row_"), "host_rate", "path_rate", _chance(F.col("poor_") + shift).alias("poor"), _chance(F.col("toxic_") + shift).alias("toxic"))
    out = out.withColumn("bad", 1 - (1 - F.col("poor")) * (1 - F.col("toxic")))
    return out.select("row_.*", "poor", "toxic", "bad", "host_rate", "path_rate", (F.col("bad") < limit).alias("keep"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances and verdict for each row of `documents`; `source` is the host and `lang` the path below it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(docs, model, with_text=False).select("doc_id", "source", "poor", "toxic", "bad", "host_rate", "path_rate", "keep")
