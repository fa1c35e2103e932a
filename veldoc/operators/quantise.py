"""Product quantisation of vectors: a codebook for each piece of a vector, codes of one small number a piece, and search
by tables of distances from the query's pieces to the codebooks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Rows that codebooks are fitted to at most, those of least hash of their key.
FIT_ROWS = 50_000


def codebooks(df: DataFrame, pieces: int, size: int, vector: str = "embedding", key: str = "vec_id", seed: int = 1) -> list[np.ndarray]:
    """For each piece the centres of its clusters: pieces * size short vectors, which the driver can hold."""
    width = len(df.select(vector).first()[0]) // pieces
    sample = df.orderBy(F.xxhash64(key), key).limit(FIT_ROWS).select(F.col(vector).cast("array<double>").alias("v")).persist()
    out = []
    for i in range(pieces):
        piece = sample.select(array_to_vector(F.slice("v", i * width + 1, width)).alias("features"))
        out.append(np.array(KMeans(k=size, seed=seed, maxIter=10).fit(piece).clusterCenters()))
    sample.unpersist()
    return out


def encoded(df: DataFrame, books: list[np.ndarray], vector: str = "embedding", out: str = "codes") -> DataFrame:
    @F.pandas_udf(ArrayType(IntegerType()))
    def codes(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), float)
        width = x.shape[1] // len(books)
        near = [((x[:, None, i * width : (i + 1) * width] - b[None]) ** 2).sum(axis=2).argmin(axis=1) for i, b in enumerate(books)]
        return pd.Series(list(np.stack(near, axis=1).astype(np.int32)))

    return df.withColumn(out, codes(F.col(vector)))


def search(df: DataFrame, books: list[np.ndarray], query: list[float], k: int, codes: str = "codes", key: str = "vec_id") -> DataFrame:
    """The k rows whose codes stand for the nearest vectors: each piece's distance is read from the query's table."""
    width = len(query) // len(books)
    tables = [((b - np.array(query[i * width : (i + 1) * width])) ** 2).sum(axis=1) for i, b in enumerate(books)]
    parts = [F.get(F.array(*[F.lit(float(x)) for x in t]), F.get(codes, F.lit(i))) for i, t in enumerate(tables)]
    return df.withColumn("distance", F.sqrt(sum(parts, F.lit(0.0)))).orderBy("distance", key).limit(k)
