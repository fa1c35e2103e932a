"""Nearest neighbours by a block matrix join.

Queries and candidates are packed into blocks by a hash of their ids: int8 codes of the components, int8 codes of what
the first leave over, a scale for each vector. Each pair of blocks is a tile. Blocks are dealt once to parts, of
HELD bytes of candidates at most, and a task has a part of either side: it multiplies each of its blocks of queries with
one block of candidates after the other, so tiles are made in the task and moved nowhere. In a
tile the first codes are multiplied; with the error bounds of the quantisation a candidate stays for a query if it can still be
among the k best of the tile and of the tiles before, and the second codes narrow the bounds of those that stay. The tasks' lists
are merged by heaps, MERGE lists at a time, as far as bounds allow. What survives, little more than k for a query, is recomputed
in double precision from the original vectors. The result is exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import DoubleType

from veldoc.llm.common import counted, small_batches, stored

#: Vectors of a block of candidates and of queries, rows of a tile that are multiplied at a time, lists merged at a time.
CANDIDATES, QUERIES, STRIP, MERGE = 4096, 2048, 128, 64
#: Bytes of packed candidates that a task holds.
HELD = 1 << 26
#: Components whose products of codes are exact in float32.
EXACT = 1024
#: Steps of the second code in a step of the first one.
FINE = 254
#: Largest components within which bounds are taken; a candidate beyond stays in any case.
TINY, HUGE = 1e-290, 1e290


def usable(vector: Column) -> Column:
    """Not null, of components that are all finite, one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, int8 codes of the rest, scale and sum of magnitudes of each row. The scale is NaN where the largest
    component is too large or small for bounds."""
    most = np.abs(x).max(axis=1)
    scale = np.where((most >= TINY) & (most <= HUGE), most / 127, np.nan)
    with np.errstate(invalid="ignore", over="ignore"):
        parts = np.nan_to_num(x / scale[:, None])
        high = np.rint(parts)
        low = np.clip(np.rint((parts - high) * FINE), -127, 127)
        return high.astype(np.int8), low.astype(np.int8), scale, np.abs(x).sum(axis=1)


def _pack(df: pd.DataFrame) -> pd.DataFrame:
    ids, keys, vectors = df["id"].to_numpy(np.int64), df["key"].to_numpy(np.int64), np.array(df["v"].tolist(), np.float64)
    if df["asks"].iloc[0]:  # a query's order doesn't change with its scale; a power of two changes no digit
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])
    high, low, scale, size = quantised(vectors)
    return pd.DataFrame({"dim": [int(df["dim"].iloc[0])], "block": [int(df["block"].iloc[0])], **{n: [x.tobytes()] for n, x in zip(_PACKED, (ids, keys, high, low, scale, size))}})


_PACKED = ("ids", "keys", "high", "low", "scale", "size")


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return out


@F.pandas_udf(DoubleType())
def _score(a: pd.Series, b: pd.Series) -> pd.Series:
    sizes, out = a.map(len).to_numpy(), np.zeros(len(a))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out[at] = inner(np.array(a.iloc[at].tolist(), np.float64), np.array(b.iloc[at].tolist(), np.float64))
    return pd.Series(out)


class Block:
    """An unpacked block of codes."""

    def __init__(self, dim: int, ids: bytes, keys: bytes, high: bytes, low: bytes, scale: bytes, size: bytes):
        self.ids, self.keys = np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64)
        self.high, self.low = (np.frombuffer(x, np.int8).reshape(-1, dim) for x in (high, low))
        self.scale, self.size = np.frombuffer(scale), np.frombuffer(size)
        self.floats = self.high.astype(np.float32)
        # no bound overflows or is undefined
        self.plain = bool(np.isfinite(self.scale).all() and (self.size < 1e140).all())
        # magnitudes of what the codes stand for: first codes alone, and both
        self.coarse = np.abs(self.high.astype(np.float64)).sum(axis=1) * self.scale
        self.codes = self.high.astype(np.float64) * FINE + self.low
        self.fine = np.abs(self.codes).sum(axis=1) * self.scale / FINE


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of int8 codes: in float32 for EXACT components at a time."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT].astype(np.float32, copy=False) @ b[:, at : at + EXACT].astype(np.float32, copy=False).T
    return out


def _least(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -inf where there are fewer."""
    if k >= low.shape[1]:
        return np.full(len(low), -np.inf)
    return np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]


def _top(i: np.ndarray, top: np.ndarray, bottom: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of lists of n queries, an item's query in `i`: the k-th largest lower bound of each query, -inf where there are
    fewer, and which items reach it."""
    order = np.lexsort((-bottom, i))
    ends = np.searchsorted(i[order], np.arange(n + 1))
    kth = np.full(n, -np.inf)
    full = np.flatnonzero(np.diff(ends) >= k)
    kth[full] = bottom[order[ends[full] + k - 1]]
    return kth, top >= kth[i]


def _tile(q: Block, c: Block, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and candidates, upper and lower bounds of those of a tile that can be among the k best of their
    query, of which `least` is a lower bound already. A product of codes is off by half a step of either side at most:
    |a.b - a'.b'| <= |a - a'||b| + |a'||b - b'|."""
    slack, out = 1 + 1e-9, []
    for at in range(0, len(q.ids), STRIP):
        s = slice(at, at + STRIP)
        with np.errstate(invalid="ignore"):
            near = products(q.floats[s], c.floats)
            near *= q.scale[s, None]
            near *= c.scale[None, :]
            room = q.coarse[s, None] * c.scale[None, :]
            room += q.scale[s, None] * c.size[None, :]
            room *= slack / 2
        if not (q.plain and c.plain):
            fits = np.isfinite(room)
            near, room = np.where(fits, near, 0), np.where(fits, room, np.inf)
        # a bound of the tile itself is only needed as long as there is none of the tiles before
        bound = least[s].copy()
        new = np.flatnonzero(bound == -np.inf)
        low = near[new] - room[new]
        near += room
        if np.isin(q.ids[s], c.ids).any():
            own = q.ids[s, None] == c.ids[None, :]
            low[own[new]] = -np.inf
            near[own] = np.nan  # reaches no bound
        bound[new] = _least(low, k)
        i, j = np.nonzero(near >= bound[:, None])
        del near, room
        with np.errstate(invalid="ignore"):
            exact = np.einsum("ij,ij->i", q.codes[at + i], c.codes[j]) * (q.scale[at + i] * c.scale[j] / FINE**2)
            room = (q.fine[at + i] * c.scale[j] + q.scale[at + i] * c.size[j]) / (2 * FINE) * slack
        fits = np.isfinite(room)
        top, bottom = np.where(fits, exact + room, np.inf), np.where(fits, exact - room, -np.inf)
        _, stay = _top(i, top, bottom, len(bound), k)
        stay &= top >= least[s][i]
        out.append((at + i[stay], j[stay], top[stay], bottom[stay]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _lists(i: np.ndarray, top: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """Each query that has items: its place, and their upper bounds, largest first, and other columns."""
    order = np.lexsort((-top, i))
    i, *columns = (x[order] for x in (i, top, *more))
    cuts = np.append(np.flatnonzero(np.append(True, i[1:] != i[:-1])[: len(i)]), len(i))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(i[a]), *(x[a:b] for x in columns)


def tile_best(q: Block, c: Block, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query of a tile: id, key, and upper bounds, lower bounds and places of the candidates that can be among
    its k best."""
    i, j, top, bottom = _tile(q, c, k, np.full(len(q.ids), -np.inf))
    for r, *columns in _lists(i, top, bottom, j):
        yield int(q.ids[r]), int(q.keys[r]), *columns


class Best:
    """What can be among the k best of each query of a block, of all blocks of candidates so far."""

    def __init__(self, q: Block, k: int):
        self.q, self.k, self.least = q, k, np.full(len(q.ids), -np.inf)
        self.i, self.keys, self.top, self.bottom = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def add(self, c: Block) -> None:
        i, j, top, bottom = _tile(self.q, c, self.k, self.least)
        if len(i):
            new = (np.concatenate(x) for x in ((self.i, i), (self.keys, c.keys[j]), (self.top, top), (self.bottom, bottom)))
            i, keys, top, bottom = new
            self.least, stay = _top(i, top, bottom, len(self.q.ids), self.k)
            self.i, self.keys, self.top, self.bottom = i[stay], keys[stay], top[stay], bottom[stay]

    def lists(self, part: int) -> pd.DataFrame:
        out = [(int(self.q.ids[r]), int(self.q.keys[r]), part, *columns) for r, *columns in _lists(self.i, self.top, self.bottom, self.keys)]
        return pd.DataFrame(out, columns=["query_id", "key", "part", "tops", "bottoms", "keys"])


def _merged(runs: list[list[tuple[float, float, int]]], k: int) -> list[tuple[float, float, int]]:
    """Of lists sorted by upper bound, largest first, what can be among the k best: a heap keeps the k largest lower
    bounds, and the merge ends where no upper bound reaches the least of them."""
    best: list[float] = []
    out: list[tuple[float, float, int]] = []
    for one in heapq.merge(*runs, key=lambda x: -x[0]):
        if len(best) == k and one[0] < best[0]:
            break
        out.append(one)
        (heapq.heappush if len(best) < k else heapq.heappushpop)(best, one[1])
    return out


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `df` that `queries` selects the k rows, but its own, of largest
    inner product, ties to the smaller id; fewer if there are fewer.

    Vectors that are null, zero or hold null or non-finite components take no part, neither do null ids. Vectors meet
    those of their own length only. Repeated rows count once; different vectors under one id are candidates each, and
    a query's neighbours are the best of its vectors'. Of more than k + 1 equal vectors those of least ids are
    candidates, as no others can be among the nearest. Products that overflow count as infinite, undefined ones as the
    largest of all. Only the two columns named are read, besides `queries`.
    The work grows with queries times candidates; two bytes a component are moved once, and read again from there.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("id", "v").agg(F.max("asks").alias("asks")).withColumn("same", F.xxhash64("v")).withColumn("key", F.xxhash64("id", "same"))
    rows = stored(rows.select("id", "v", "asks", "same", "key", F.size("v").alias("dim")), "vectors")
    often = counted(stored(rows.groupBy("same").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("same"), "often"))
    first = F.row_number().over(W.partitionBy("same", "v").orderBy("id"))
    limited = rows.join(often, "same", "left_semi").withColumn("nth", first).where(F.col("nth") <= k + 1).select(*rows.columns)
    cands = rows.join(often, "same", "left_anti").select(*rows.columns).union(limited)
    sizes = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1)), F.sum(2 * F.col("dim").cast("long") + 32)).first()
    n_c, n_q = max(1, math.ceil(sizes[0] / CANDIDATES)), max(1, math.ceil(sizes[1] / QUERIES))
    # as few parts of candidates as tasks can hold, but all cores have work
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(n_c, max(math.ceil((sizes[2] or 0) / HELD), math.ceil(tasks / n_q)))
    shares = min(n_q, math.ceil(2 * tasks / parts))
    schema = "dim int, block int, ids binary, keys binary, high binary, low binary, scale binary, size binary"

    def packed(of: DataFrame, n: int, asks: bool) -> DataFrame:
        of = of.select("id", "key", "v", "dim", F.lit(asks).alias("asks"), F.pmod(F.xxhash64("key", F.lit(n)), F.lit(n)).cast("int").alias("block"))
        return stored(of.groupBy("dim", "block").applyInPandas(_pack, schema), "blocks")

    right = packed(cands, n_c, False).repartition(parts).select("dim", F.spark_partition_id().alias("part"), *[F.col(x).alias(f"c_{x}") for x in _PACKED])
    left = packed(rows.where("asks"), n_q, True).repartition(shares).select("dim", "block", *[F.col(x).alias(f"q_{x}") for x in _PACKED])
    # never a broadcast: Spark's estimates know nothing of packed blocks. Each task has a part of either side
    tiles = left.join(right.hint("shuffle_replicate_nl"), "dim").select("dim", "block", "part", *[f"{side}_{x}" for side in "qc" for x in _PACKED])

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, best = None, None
        for b in batches:
            for row in b.itertuples(index=False):
                if of != row[:3]:  # blocks of candidates of one part follow each other
                    if best:
                        yield best.lists(of[2])
                    of, best = row[:3], Best(Block(row.dim, *row[3:9]), k)
                best.add(Block(row.dim, *row[9:15]))
        if best:
            yield best.lists(of[2])

    lists = "query_id long, key long, part int, tops array<double>, bottoms array<double>, keys array<long>"

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for query, key, part, many in zip(b["query_id"], b["key"], b["part"], b["lists"]):
                best = _merged([list(zip(one["tops"], one["bottoms"], one["keys"])) for one in many], k)
                out.append((query, key, part, [x[0] for x in best], [x[1] for x in best], [int(x[2]) for x in best]))
            yield pd.DataFrame(out, columns=["query_id", "key", "part", "tops", "bottoms", "keys"])

    best = tiles.mapInPandas(multiply, lists)
    while True:
        parts = math.ceil(parts / MERGE)
        grouped = best.groupBy("query_id", "key", F.floor(F.col("part") / MERGE).cast("int").alias("part")).agg(F.collect_list(F.struct("tops", "bottoms", "keys")).alias("lists"))
        best = grouped.mapInPandas(merge, lists)
        if parts <= 1:
            break
    pairs = best.select("query_id", F.col("key").alias("q_key"), F.explode("keys").alias("key"))
    found = pairs.join(rows.select("key", F.col("id").alias("vec_id"), F.col("v").alias("cv")), "key")
    found = found.join(rows.where("asks").select(F.col("key").alias("q_key"), F.col("v").alias("qv")), "q_key")
    scored = found.select("query_id", "vec_id", _score("qv", "cv").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th row of `embeddings`."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
