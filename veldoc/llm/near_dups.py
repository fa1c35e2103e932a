"""Near-duplicate documents by DartMinHash.

A text is the multiset of its shingles of five words. Every unit of an element's weight is a region on which a
Poisson process, seeded by the element and the unit, throws darts; a dart that falls beyond the element's weight
is dropped. Each dart has a rank and a coordinate, and of each coordinate the dart of least rank is kept: two texts
keep the same dart with the probability of their weighted Jaccard similarity. Only the darts of low rank are made,
about `k ln k` for a text of any length.

The weights of the query are the counts of the shingles: one unit for each time that a shingle occurs in a text.

Signatures are joined by bands. In a bucket of up to PAIRWISE texts all pairs are candidates. In a larger one each
text is a candidate with two hubs at first: the text that shares most buckets with others, as copies of one original
resemble it at least as much as each other, and one by hash, another in each bucket. Each candidate pair is compared
exactly. Of the classes that come of this, a large bucket may hold several; then each of its texts outside of its largest
class is compared exactly with all texts of the bucket that are in other classes, in tiles of TILE x TILE texts. So the
classes are those of all pairs that share a band, and no bucket is capped; the work in a large bucket is its texts times
those that its hubs leave outside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from veldoc.llm.common import counted, small_batches, stored, text_key
from veldoc.llm.hashing import U64, grams, mix, unit, word_chunks

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at the threshold shares none of the 24 bands of 5 with a probability of 0.00007.
BANDS, ROWS = 24, 5
#: Size of a bucket up to which all its pairs are candidates.
PAIRWISE = 12
#: Texts and bytes of elements of a side of a tile, about, and elements whose counts are multiplied at a time.
TILE, TILE_BYTES, STRIP = 512, 8_000_000, 4096


def shingles(rows: np.ndarray, hashes: np.ndarray, n_rows: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The elements of each row and their rows, sorted by both. The second, third ... time that a shingle occurs
    counts as an element of its own, so the weighted similarity of multisets is the plain one of these sets.
    A text of fewer than k words is one shingle."""
    values, at = grams(hashes, rows, k)
    owner = rows[at]
    sizes = np.bincount(rows, minlength=n_rows)
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for r in np.flatnonzero((sizes > 0) & (sizes < k)).tolist():
        with np.errstate(over="ignore"):
            h = U64(sizes[r])
            for x in hashes[heads[r] : heads[r] + sizes[r]]:
                h = h * U64(0x100000001B3) + x
        values, owner = np.append(values, mix(np.array([h], U64))), np.append(owner, r)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])])
        again = np.arange(len(values)) - np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
        with np.errstate(over="ignore"):
            values = np.where(again > 0, mix(values + again.astype(U64) * U64(0x9E3779B97F4A7C15)), values)
    return owner, values


def dart_signatures(owner: np.ndarray, elements: np.ndarray, n_rows: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """For each row the darts kept of coordinates 0..k-1 (0: the row has no elements). `weights`: of the elements,
    1 each if not given; an element is as many regions of unit weight as its weight has units or parts of one."""
    if weights is not None:
        units = np.ceil(weights).astype(np.int64)
        piece = np.arange(int(units.sum())) - np.repeat(np.cumsum(units) - units, units)
        owner, room = np.repeat(owner, units), np.minimum(1.0, np.repeat(weights, units) - piece)
        with np.errstate(over="ignore"):
            elements = np.repeat(elements, units) + piece.astype(U64) * U64(0xD6E8FEB86659FD93)
        total = np.bincount(owner, weights=room, minlength=n_rows)
    else:
        room, total = None, np.bincount(owner, minlength=n_rows).astype(float)
    best = np.full(n_rows * k, np.inf)
    kept = np.zeros(n_rows * k, U64)
    seeds = mix(elements)
    darts = k * (np.log(k) + 2.0)
    todo = total > 0
    while todo.any():
        reach = np.where(todo, darts / np.maximum(total, 1e-9), 0.0)[owner]
        live = np.flatnonzero(reach > 0)
        rank, state, j = np.zeros(len(live)), seeds[live], 0
        while len(live):
            with np.errstate(over="ignore"):
                state = mix(state + U64(0xA0761D6478BD642F))
            rank = rank - np.log(unit(state))
            near = rank < reach[live]
            live, rank, state = live[near], rank[near], state[near]
            if not len(live):
                break
            with np.errstate(over="ignore"):
                name = mix(state ^ U64(0x5851F42D4C957F2D))
                spot = owner[live] * k + (mix(name + U64(1)) % U64(k)).astype(np.int64)
            ok = slice(None) if room is None else unit(mix(name + U64(2))) <= room[live]
            s, r, d = spot[ok], rank[ok], name[ok]
            order = np.argsort(r, kind="stable")[::-1]  # the last write to a coordinate is its least rank
            s, r, d = s[order], r[order], d[order]
            low = r < best[s]
            best[s[low]], kept[s[low]] = r[low], d[low]
        todo &= np.isinf(best.reshape(n_rows, k)).any(axis=1)
        darts *= 2
    return kept.reshape(n_rows, k)


def bands_of(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A number for each band of each signature, different from band to band."""
    n, k = signatures.shape
    out = np.broadcast_to(np.arange(k // rows, dtype=U64), (n, k // rows)).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out * U64(0x9E3779B97F4A7C15) + signatures[:, j::rows][:, : k // rows])
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, _, rows, hashes, _, _ in word_chunks(b.column("text")):
            owner, elements = shingles(rows, hashes, hi - lo)
            sizes = np.bincount(owner, minlength=hi - lo)
            bands = bands_of(dart_signatures(owner, elements, hi - lo, BANDS * ROWS))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo), b.column("doc_id").slice(lo, hi - lo), pa.array(sizes, pa.int64()), lists], ["node", "doc_id", "size", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, _, rows, hashes, _, _ in word_chunks(b.column("text")):
            owner, elements = shingles(rows, hashes, hi - lo)
            order = np.lexsort((elements, owner))
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=hi - lo))]) * 8
            raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(elements[order])])
            yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo), raw], ["node", "elements"])


@F.pandas_udf(DoubleType())
def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
        if len(x) > len(y):
            x, y = y, x
        both = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x) if len(x) else 0
        out.append(both / (len(x) + len(y) - both) if len(y) else 0.0)
    return pd.Series(out, dtype=float)


def _banded(signed: DataFrame) -> DataFrame:
    """(band, node, size, m): the buckets of several texts; m is the number of their texts."""
    rows = signed.select("node", "size", F.explode("bands").alias("band"))
    # stored, so that a frequent band's rows can be split among tasks by the joins
    buckets = stored(rows.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    return stored(rows.join(counted(buckets), "band").select("band", "node", "size", "m"), "bands")


def _candidates(rows: DataFrame) -> DataFrame:
    """Pairs a < b of nodes, each once: all of small buckets, those with a hub of large ones."""
    small = rows.where(F.col("m") <= PAIRWISE)
    x, y = small.select("band", F.col("node").alias("a"), F.col("size").alias("na")), small.select("band", F.col("node").alias("b"), F.col("size").alias("nb"))
    pairs = x.join(y, "band").where("a < b").select("a", "b", "na", "nb")
    ties = rows.groupBy("node").agg(F.sum("m").alias("ties"))
    large = rows.where(F.col("m") > PAIRWISE)
    first = F.max(F.struct("ties", (-F.col("node")).alias("least"), "node", "size"))
    second = F.min(F.struct(F.xxhash64("node", "band").alias("by"), "node", "size"))
    hubs = large.join(ties, "node").groupBy("band").agg(first.alias("first"), second.alias("second"))
    hubs = stored(hubs.select("band", F.explode(F.array(F.struct("first.node", "first.size"), F.struct("second.node", "second.size"))).alias("x")).select("band", F.col("x.node").alias("h"), F.col("x.size").alias("nh")), "hubs")
    spokes = large.join(counted(hubs), "band").where("node <> h")
    least = F.col("node") < F.col("h")
    spokes = spokes.select(F.when(least, F.col("node")).otherwise(F.col("h")).alias("a"), F.when(least, F.col("h")).otherwise(F.col("node")).alias("b"), F.col("size").alias("na"), F.col("nh").alias("nb"))
    small_enough = F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")
    return pairs.union(spokes).where(small_enough).select("a", "b").distinct()


def _sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, elements) of the nodes in `rows`."""
    needed = stored(rows.select("node").distinct(), "needed")
    texts = docs.join(counted(needed), "node", "left_semi").dropDuplicates(["node"]).select("node", "text")
    return stored(texts.mapInArrow(_elements, "node long, elements binary"), "sets")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs whose texts have SIMILARITY or more."""
    compared = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    return stored(compared.select("a", "b", _jaccard("ea", "eb").alias("similarity")).where(F.col("similarity") >= SIMILARITY).select("a", "b"), "links")


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of `a` shares with each of `b`: product of 0/1 matrices, STRIP elements at a time."""
    x, y = np.concatenate(a), np.concatenate(b)
    names = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(names):
        return out
    sides = []
    for values, sets in ((x, a), (y, b)):
        owner = np.repeat(np.arange(len(sets)), [len(e) for e in sets])
        at = np.minimum(np.searchsorted(names, values), len(names) - 1)
        hit = names[at] == values
        order = np.argsort(at[hit], kind="stable")
        sides.append((owner[hit][order], at[hit][order], len(sets)))
    for lo in range(0, len(names), STRIP):
        width = min(STRIP, len(names) - lo)
        parts = []
        for owner, at, n in sides:
            i, j = np.searchsorted(at, [lo, lo + width])
            one = np.zeros((n, width), np.float32)
            one[owner[i:j], at[i:j] - lo] = 1
            parts.append(one)
        out += parts[0] @ parts[1].T
    return out


def _tile(df: pd.DataFrame) -> pd.DataFrame:
    """Links between classes of a tile: of all that there are, enough to connect the same classes."""
    sides = [df[df["side"] == k] for k in (0, 1)]
    out: list[tuple[int, int]] = []
    if len(sides[0]) and len(sides[1]):
        a, b = ([np.frombuffer(e, U64) for e in side["elements"]] for side in sides)
        ca, cb = (side["class"].to_numpy() for side in sides)
        both = common_counts(a, b).astype(float)
        total = np.array([len(e) for e in a])[:, None] + np.array([len(e) for e in b])[None, :] - both
        i, j = np.nonzero((both / np.maximum(total, 1) >= SIMILARITY) & (ca[:, None] != cb[None, :]))
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        for x, y in sorted(set(zip(ca[i].tolist(), cb[j].tolist()))):
            p, q = top(x), top(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((x, y))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _across(rows: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of classes that a link of two texts of one large bucket connects. Of two texts in different classes one is
    outside of the bucket's largest class. A tile has about TILE texts of either side, fewer where they are long."""
    rows = rows.where(F.col("m") > PAIRWISE).select("band", "node", "size").join(classes, "node", "left")
    rows = stored(rows.withColumn("class", F.coalesce("class", "node")), "classed")
    held = rows.groupBy("band", "class").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    held = held.groupBy("band").agg(F.max(F.struct("n", "class", "s")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("classes")).where("classes > 1")
    parts = lambda n, s: F.ceil(F.greatest(n / TILE, s * 8 / TILE_BYTES)).cast("int")
    mixed = held.select("band", F.col("main.class").alias("main"), parts(F.col("n"), F.col("s")).alias("wide"), parts(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("high"))
    rows = rows.join(counted(stored(mixed, "mixed")), "band").join(sets, "node")
    own = lambda of, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    outside = rows.where("class <> main").select("band", "class", "elements", F.lit(0).alias("side"), own("high", 1).alias("i"), every("wide").alias("j"))
    whole = rows.select("band", "class", "elements", F.lit(1).alias("side"), own("wide", 2).alias("j"), every("high").alias("i"))
    return outside.unionByName(whole).groupBy("band", "i", "j").applyInPandas(_tile, "a long, b long").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, class): the least node that a node is connected with. Labels spread along links, then each label takes
    its own label; a round is stored, and no row of links or labels goes to the driver."""
    both = stored(links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("class")), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("class").alias("near"))
        hop = labels.join(near, labels["node"] == near["x"]).select("node", "class", F.least("class", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("class").alias("then"))
        new = stored(hop.join(jump, "to", "left").select("node", F.col("class").alias("old"), F.least("to", F.coalesce("then", "to")).alias("class")), "labels")
        labels = new.select("node", "class")
        if new.where("old <> class").isEmpty():
            return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node, class_id, is_first): one row for each distinct pair of id and text of `df`. `node` is the key of
    the text. Texts are in one class if a chain of links of SIMILARITY or more, or equality, connects them; `class_id` is
    the class's least id and `is_first` marks the one document of it that stays.

    Ids are of type long. A null or wordless text is in a class of its own, like its equals (empty texts are no
    copies of each other). Repeated rows count once. Several texts under one id are linked through their texts only,
    and the id has a row for each. Only `id_col` and `text_col` are read, so other columns can have any name.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("node", text_key(F.col("text")))
    signed = stored(docs.mapInArrow(_sign, "node long, doc_id long, size long, bands array<long>"), "signed")
    # one node for each text, so that exact copies are of no more weight than one
    nodes = signed.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    rows = _banded(nodes)
    sets = _sets(docs, rows)
    classes = components(_links(_candidates(rows), sets))
    across = stored(_across(rows, classes, sets), "across")
    members = signed.select("doc_id", "node", (F.col("size") > 0).alias("worded")).distinct().join(classes, "node", "left")
    members = members.withColumn("group", F.coalesce("class", "node"))
    if not across.isEmpty():
        merged = components(across).select(F.col("node").alias("group"), F.col("class").alias("merged"))
        members = members.join(merged, "group", "left").withColumn("group", F.coalesce("merged", "group"))
    first = members.where("worded").groupBy("group").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("top"))
    # stored, so that a large class's rows can be split among tasks
    out = members.join(counted(stored(first, "firsts")), "group", "left")
    is_first = F.coalesce(F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("node") == F.col("top.node")), F.lit(False)) | ~F.col("worded")
    return out.select("doc_id", "node", F.when(F.col("worded"), F.col("least")).otherwise(F.col("doc_id")).alias("class_id"), is_first.alias("is_first"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each row of `documents`, and whether it is the one of its class that stays."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "is_first")
