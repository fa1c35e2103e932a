"""Relations between collections: traversal, hydration, links. All are joins on keys; Spark picks the strategy."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veldoc.operators.filters import alive, where
from veldoc.operators.pipeline import null_order
from veldoc.sources.workspace import kept


def forward(df: DataFrame, target: DataFrame, key: str, target_key: str) -> DataFrame:
    """(source row, target row): what the key of each row points to; an array of keys points to several."""
    ids = df.select("*", F.explode(key).alias("_to")) if df.schema[key].dataType.typeName() == "array" else df.withColumn("_to", F.col(key))
    return ids.join(alive(target), ids["_to"] == target[target_key]).drop("_to")


def reverse(df: DataFrame, source: DataFrame, key: str, foreign_key: str, name: str) -> DataFrame:
    """Each row with each of the rows that point to it, as a struct: one row for a pair, null where nothing points.
    However many rows point to one, none is gathered; `hydrate` makes arrays of a bounded number of them."""
    pointing = alive(source).select(F.col(foreign_key).alias("_to"), F.struct("*").alias(name))
    return df.join(pointing, df[key] == pointing["_to"], "left").drop("_to")


def related(df: DataFrame, target: DataFrame, on: Column, spec: Mapping[str, Any] | None = None, sort: Mapping[str, int] | None = None, limit: int | None = None, offset: int = 0, project: Sequence[str] | None = None) -> DataFrame:
    """Related rows with filter, sort, offset, limit and projection."""
    out = df.join(where(alive(target), spec or {}), on)
    out = out.orderBy(*[null_order(k, v == -1, "find") for k, v in sort.items()]) if sort else out
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit is not None else out
    return out.select(*project) if project else out


def hydrate(df: DataFrame, child: DataFrame, key: str, foreign_key: str, name: str, limit: int | None = None, sort: Mapping[str, int] | None = None, spec: Mapping[str, Any] | None = None) -> DataFrame:
    """Each row with an array of its children, the first `limit` in the order of `sort`. Children beyond the limit are
    dropped before they are gathered; ranks are found within partitions first."""
    kept = where(alive(child), spec or {})
    keys = [null_order(k, v == -1, "find") for k, v in (sort or {}).items()] or [F.col(kept.columns[0])]
    kept = kept.withColumn("_rank", F.row_number().over(W.partitionBy(foreign_key).orderBy(*keys)))
    kept = kept.where(F.col("_rank") <= limit) if limit is not None else kept
    fields = F.struct("_rank", *[c for c in kept.columns if c != "_rank"])
    many = kept.groupBy(F.col(foreign_key).alias("_to")).agg(F.array_sort(F.collect_list(fields)).alias(name))
    many = many.withColumn(name, F.transform(name, lambda x: x.dropFields("_rank")))
    out = df.join(many, df[key] == many["_to"], "left").drop("_to")
    return out.withColumn(name, F.coalesce(name, F.array().cast(many.schema[name].dataType)))


def capped_inbound(df: DataFrame, source: DataFrame, key: str, foreign_key: str, id_col: str, most: int) -> DataFrame:
    """Each row with its inbound ids, the `most` least, and the count of all of them. Ranks beyond `most` are dropped
    before rows are shuffled, and the count is an aggregate."""
    ranked = source.withColumn("_rank", F.row_number().over(W.partitionBy(foreign_key).orderBy(id_col))).where(F.col("_rank") <= most)
    ids = ranked.groupBy(F.col(foreign_key).alias("_to")).agg(F.array_sort(F.collect_list(id_col)).alias("inbound"))
    counts = source.groupBy(F.col(foreign_key).alias("_to")).agg(F.count("*").alias("inbound_count"))
    out = df.join(counts.join(ids, "_to", "left"), df[key] == F.col("_to"), "left").drop("_to")
    return out.withColumn("inbound", F.coalesce("inbound", F.array().cast(ids.schema["inbound"].dataType))).withColumn("inbound_count", F.coalesce("inbound_count", F.lit(0)))


#: Rows of a front of a traversal up to which it is broadcast, so that edges needn't be shuffled.
FRONT_ROWS = 100_000


def hops(start: DataFrame, edges: DataFrame, n: int, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, hop): nodes by the least number of hops from the start, up to n. Each hop keeps new nodes only and is
    stored; while the front is small it is broadcast to the edges' scan."""
    seen = front = kept(start.select(F.col(node).alias("node")).distinct().withColumn("hop", F.lit(0)))
    for i in range(1, n + 1):
        small = front.limit(FRONT_ROWS + 1).count() <= FRONT_ROWS
        reached = edges.join(F.broadcast(front) if small else front, edges[src] == front["node"]).select(F.col(dst).alias("node")).distinct()
        front = kept(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(i)))
        seen = seen.unionByName(front)
    return seen


def link(edges: DataFrame, new: DataFrame, targets: DataFrame, target_key: str, single: bool = False) -> DataFrame:
    """Edges (src, dst) with new ones whose targets exist and are not deleted; a singular relation's new edge replaces."""
    valid = new.join(alive(targets).select(F.col(target_key).alias("dst")), "dst", "left_semi").select("src", "dst")
    kept = edges.join(valid.select("src").distinct(), "src", "left_anti") if single else edges
    return kept.select("src", "dst").union(valid).distinct()


def unlink(edges: DataFrame, gone: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Edges without the given ones, or without all of the given sources."""
    return edges.join(gone, ["src", "dst"], "left_anti") if gone is not None else edges.join(sources, "src", "left_anti")


def dangling(edges: DataFrame, targets: DataFrame, target_key: str) -> DataFrame:
    return edges.join(targets.select(F.col(target_key).alias("dst")), "dst", "left_anti")


#: Vectors of either side that are multiplied at a time; the blocks of a side, and the bytes of vectors of one block from
#: which on there are more. Each row moves once for each block of the other side.
BLOCK, BLOCKS, BLOCK_BYTES = 2048, 16, 32 << 20


def _blocks(n: int, size: int) -> int:
    """The number of blocks of a side of n rows, `size` bytes of vectors in all."""
    return max(1, min(BLOCKS, -(-n // BLOCK)), -(-size // BLOCK_BYTES))


def _packed(df: DataFrame, name: str, blocks: int) -> DataFrame:
    """Blocks (dim, name) of rows (key, v), packed."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array(rows["v"].tolist(), np.float64)
        return pd.DataFrame({"dim": [vectors.shape[1]], name: [int(rows["block"].iloc[0])], f"{name}_keys": [rows["key"].to_numpy(np.int64).tobytes()], f"{name}_vectors": [vectors.tobytes()]})

    rows = df.where("key is not null and size(v) > 0").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return rows.groupBy(F.size("v").alias("dim"), "block").applyInPandas(pack, f"dim int, {name} int, {name}_keys binary, {name}_vectors binary")


def _first(i: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the row of greatest value of each i; ties to the smaller key."""
    order = np.lexsort((key, -value, i))
    return order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(order) else order


def _nearest(lk: np.ndarray, x: np.ndarray, rk: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the left row, right key, similarity): the best right row of each left row. What a product of matrices finds
    nearly best is computed anew in order, so that equal vectors tie."""
    nx, ny = in_order(x, x) ** 0.5, in_order(y, y) ** 0.5
    zx, zy = nx == 0, ny == 0
    near = (x / np.where(zx, 1, nx)[:, None]) @ (y / np.where(zy, 1, ny)[:, None]).T
    if zx.any() or zy.any():
        near[zx], near[:, zy] = 0, 0
        near[np.ix_(zx, zy)] = 1
    if len(np.intersect1d(lk, rk)):
        near[lk[:, None] == rk[None, :]] = -np.inf
    i, j = np.nonzero(near >= near.max(axis=1)[:, None] - 1e-9)
    i, j = i[near[i, j] > -np.inf], j[near[i, j] > -np.inf]
    with np.errstate(divide="ignore", invalid="ignore"):
        exact = np.where(zx[i] | zy[j], near[i, j], 1 - (1 - np.clip(in_order(x[i], y[j]) / (nx[i] * ny[j]), -1, 1)))
    first = _first(i, rk[j], exact)
    return i[first], rk[j[first]], exact[first]


def _best(tiles: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best right row of each left row of a tile, by BLOCK rows of either side at a time."""
    for b in tiles:
        for dim, lk, lv, rk, rv in zip(b["dim"], b["l_keys"], b["l_vectors"], b["r_keys"], b["r_vectors"]):
            lk, rk = np.frombuffer(lk, np.int64), np.frombuffer(rk, np.int64)
            x, y = np.frombuffer(lv).reshape(-1, dim), np.frombuffer(rv).reshape(-1, dim)
            for at in range(0, len(lk), BLOCK):
                some = [_nearest(lk[at : at + BLOCK], x[at : at + BLOCK], rk[k : k + BLOCK], y[k : k + BLOCK]) for k in range(0, len(rk), BLOCK)]
                i, right, value = (np.concatenate(c) for c in zip(*some))
                first = _first(i, right, value)
                yield pd.DataFrame({"left": lk[at + i[first]], "right": right[first], "similarity": value[first]})


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def fuzzy(left: DataFrame, right: DataFrame, left_key: str, right_key: str, vector: str, least: float) -> DataFrame:
    """(left, right, similarity): for each left row the most similar right row, itself left out, if similar enough; ties to
    the smaller key. Both sides are packed into blocks, each pair of blocks is a tile that keeps one row for each left
    row, and the tiles' rows are merged by an aggregate: no pair of rows is ever a row. Keys are integers; null keys and
    null vectors take no part."""
    sides = []
    for df, key, name in ((left, left_key, "l"), (right, right_key, "r")):
        rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull()))
        n, components = rows.agg(F.count("*"), F.sum(F.size("v"))).first()
        blocks = _blocks(n, 8 * (components or 0))
        sides.append((kept(_packed(rows, name, blocks)), blocks))
    (a, n_a), (b, n_b) = sides
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tiles = a.withColumn("r", every(n_b)).join(b.withColumn("l", every(n_a)), ["dim", "l", "r"])
    pairs = tiles.select("dim", "l_keys", "l_vectors", "r_keys", "r_vectors").mapInPandas(_best, "left long, right long, similarity double")
    best = pairs.groupBy("left").agg(F.max(F.struct("similarity", (-F.col("right")).alias("r"))).alias("top"))
    return best.select("left", (-F.col("top.r")).alias("right"), F.col("top.similarity").alias("similarity")).where(F.col("similarity") >= least)
