"""Exact top-k by inner product with vector-approximation files.

Vectors are dealt into blocks by hash; each block keeps its vectors once as cells (a few bits per dimension) and once
exactly. A query scans a block's cells for an upper and a lower bound of each score, then reads exact vectors in falling
order of the upper bound until the k-th best score found is certain. Blocks give k rows per query, which are then ranked.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 5
BITS = 5              # bits of a cell number per dimension
BLOCK_VECTORS = 8192  # vectors of a block, on average
BLOCK_QUERIES = 1024  # queries met with a block at a time, on average
EXACT = float(1 << 53)


def quantised(embedding: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component as double; NULL for vectors that are NULL, or hold NULL or non-finite values."""
    x = F.transform(embedding, lambda v: F.floor(v.cast("double") * factor).cast("double"))
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(False)), x)


class ApproximationFile:
    """One block: cell numbers per dimension and the exact vectors."""

    def __init__(self, vectors: np.ndarray, bits: int = BITS):
        self.vectors = vectors
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.low, self.width = low, np.floor((high - low) / (1 << bits)) + 1
        self.cells = ((vectors - low) // self.width).astype(np.uint8)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each query's score with each vector."""
        base = queries @ (self.cells * self.width + self.low).T
        below = (np.minimum(queries, 0) * (self.width - 1)).sum(axis=1)[:, None]
        above = (np.maximum(queries, 0) * (self.width - 1)).sum(axis=1)[:, None]
        return base + below, base + above

    def search(self, query: np.ndarray, ids: np.ndarray, own, low: np.ndarray, high: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id), ties to the smaller id, and how many exact vectors were read."""
        other = np.flatnonzero(ids != own)
        if not len(other):
            return [], 0
        kth = np.partition(low[other], -k)[-k] if len(other) > k else -np.inf
        left = other[high[other] >= kth]
        left = left[np.argsort(-high[left], kind="stable")]
        score = np.zeros(0)
        read = 0
        for step in range(0, len(left), 64):
            if read >= k and high[left[step]] < np.partition(score, -k)[-k]:
                break  # no unread vector can reach the k-th best
            score = np.concatenate([score, self.vectors[left[step:step + 64]] @ query])
            read = len(score)
        best = np.lexsort([ids[left[:read]], -score])[:k]
        return [(int(score[i]), int(ids[left[i]])) for i in best], read


def _wide(vectors: np.ndarray, queries: np.ndarray, ids, own, k: int) -> list[tuple[int, int]]:
    """Scores beyond exact doubles, in Python's whole numbers, brought into 64 bits at the end."""
    score = vectors.astype(object) @ queries
    top = sorted((-int(s), int(i)) for s, i in zip(score, ids) if i != own)[:k]
    return [(max(-(1 << 63), min((1 << 63) - 1, -s)), i) for s, i in top]


def top_k(vectors: DataFrame, query_set: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best others of each vector in the query set (all, if fewer).

    Rows without id take no part, nor do vectors that are NULL or hold NULL or non-finite components. Rows equal in id and
    vector count once; rows that share an id are not candidates of each other. Vectors meet only those of their own length.
    An empty table gives an empty result; other columns are not looked at. Scores are whole numbers, kept within 64 bits. Every query meets every block, whole; nothing is left out by sampling.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), query_set.alias("asks")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()).distinct()
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, turns = max(1, -(-sizes["n"] // BLOCK_VECTORS)), max(1, -(-sizes["q"] // BLOCK_QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.withColumn("d", F.size("v"))
    stored = base.select("d", deal(blocks).alias("block"), every(turns).alias("turn"), "id", "v")
    asked = base.where("asks").select("d", every(blocks).alias("block"), deal(turns).alias("turn"), "id", "v")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            x, q, ids = np.stack(left["v"]), np.stack(right["v"]), left["id"].to_numpy()
            wide = x.shape[1] * max(1.0, np.abs(x).max(initial=0)) * max(1.0, np.abs(q).max(initial=0)) * 4 >= EXACT
            file = None if wide else ApproximationFile(x)
            for at in range(0, len(q), 128):
                part, owners = q[at:at + 128], right["id"].to_numpy()[at:at + 128]
                low, high = (None, None) if wide else file.bounds(part)
                for i, own in enumerate(owners):
                    best = _wide(x, part[i].astype(object), ids, own, k) if wide else file.search(part[i], ids, own, low[i], high[i], k)[0]
                    found += [(own, s, i) for s, i in best]
        return pd.DataFrame(found, columns=["query_id", "score", "vec_id"]).astype("int64")

    keys = ["d", "block", "turn"]
    local = asked.groupBy(*keys)
    pairs = stored.groupBy(*keys).cogroup(local).applyInPandas(run, "query_id long, score long, vec_id long").distinct()
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
