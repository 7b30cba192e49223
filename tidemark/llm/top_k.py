"""Exact top-k inner products over an impact-ordered index, score at a time, in blocks.

Components are quantised to integer impacts.  A block of vectors is indexed as posting segments: a
segment holds, for every dimension, the postings whose impact has one magnitude class (a power of
two), and segments are processed in descending class.  After each segment a query has a partial
score for every vector and, by Cauchy-Schwarz on what the vector has left, proven bounds on its
final score.  A query stops as soon as the bounds prove which few vectors can still be among its
best; these possible members alone are then scored exactly over the rest of the segments.

Queries and vectors meet block by block: (query block, vector block) is one group of bounded size,
whatever the table holds.  Each group keeps its best k per query; the best of these are the result.

Vectors that are null, empty or hold a null or non-finite component take no part.  Ties go to the
smaller id.  An id is one vector: of rows that repeat it, the smallest vector counts.  Vectors of another length than the query's have no product with it and are no candidates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

K = 20
SCALE = 64
VECTOR_BLOCK = 8192
QUERY_BLOCK = 1024
#: Queries whose scores against one block of vectors are held at a time.
STEP = 64
#: Bounds are tried once this share of the vectors' norm is left, and after each later segment.
TIGHT = 0.3
#: Share of all pairs that may be possible members when they are scored one by one.
FEW = 0.02


class ImpactIndex:
    """Posting segments of a block of quantised vectors, by descending magnitude class."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.impacts = ids[order], impacts[order]
        magnitude = np.abs(self.impacts)
        self.top = int(magnitude.max(initial=0))
        self.segments: list[np.ndarray] = []
        #: Norm of what is left of each vector behind each segment.
        self.left: list[np.ndarray] = []
        rest = self.impacts
        for bits in range(self.top.bit_length(), 0, -1):
            inside = magnitude >> (bits - 1) == 1
            if inside.any():
                self.segments.append(np.where(inside, self.impacts, 0))
                rest = np.where(inside, 0, rest)
                self.left.append(np.sqrt((rest.astype(np.float64) ** 2).sum(axis=1)))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids of vectors and exact scores: each query's best k."""
        largest = float(self.top) * float(np.abs(queries).max(initial=0)) * queries.shape[1]
        if largest >= 1 << 53:
            pairs = np.nonzero(query_ids[:, None] != self.ids[None, :])
            scores = np.concatenate([self.impacts @ q for q in queries]).reshape(len(queries), -1)[pairs]
            return self._ranked(*pairs, scores, k)
        # Sums of integers below these bounds are exact in floats of 24 and 53 bits.
        kind = np.float32 if largest < 1 << 24 else np.float64
        plain = queries.astype(kind)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        own = np.nonzero(query_ids[:, None] == self.ids[None, :])
        scores = np.zeros((len(queries), len(self.ids)), kind)
        whole = np.sqrt((self.impacts.astype(np.float64) ** 2).sum(axis=1)).mean() if len(self.ids) else 0.0
        for depth, (segment, left) in enumerate(zip(self.segments, self.left, strict=True)):
            scores += plain @ segment.astype(kind).T
            if depth + 1 == len(self.segments) or left.mean() > TIGHT * whole:
                continue
            # A hair more than the norm, so that rounding can't make a bound false.
            bound = (norms[:, None] * left[None, :] * (1 + 1e-6) + 1e-3).astype(kind)
            possible = scores + bound >= self._threshold(scores - bound, own, k)[:, None]
            possible[own] = False
            if possible.sum() <= FEW * possible.size:
                pairs = np.nonzero(possible)
                return self._ranked(*pairs, self._exact(queries, *pairs), k)
        possible = scores >= self._threshold(scores, own, k)[:, None]
        possible[own] = False
        pairs = np.nonzero(possible)
        return self._ranked(*pairs, scores[pairs].astype(np.int64), k)

    @staticmethod
    def _threshold(low: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
        """What k other vectors reach for certain, per query."""
        low = low.copy()
        low[own] = -np.inf
        if low.shape[1] <= k:
            return np.full(len(low), -np.inf)
        return np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]

    def _exact(self, queries: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *((queries[q[a : a + 65536]] * self.impacts[v[a : a + 65536]]).sum(axis=1) for a in range(0, len(q), 65536))])

    def _ranked(self, q: np.ndarray, v: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Vectors lie in ascending id, so ties go to the smaller id.
        order = np.lexsort((v, -score, q))
        q, v, score = q[order], v[order], score[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < k
        return q[keep], self.ids[v[keep]], score[keep]


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, impacts) of the vectors that take part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    impacts = F.transform(v, lambda x: F.floor(x * scale))
    return vectors.where(usable).groupBy("vec_id").agg(F.min(impacts).alias("impacts"))


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of the vectors for each query, both as ``quantised`` gives them."""
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.withColumn("size", F.size("impacts"))
    queries = queries.withColumnRenamed("vec_id", "query_id").withColumn("size", F.size("impacts"))
    n, m = vectors.count(), queries.count()
    v_blocks, q_blocks = -(-n // VECTOR_BLOCK) or 1, -(-m // QUERY_BLOCK) or 1
    block = lambda column, count: F.pmod(F.xxhash64(column, "impacts"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = vectors.withColumn("vb", block("vec_id", v_blocks)).withColumn("qb", every(q_blocks))
    right = queries.withColumn("qb", block("query_id", q_blocks)).withColumn("vb", every(v_blocks))

    def meet(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            index = ImpactIndex(vectors["vec_id"].to_numpy(np.int64), np.stack(vectors["impacts"].to_numpy()).astype(np.int64))
            ids, rows = queries["query_id"].to_numpy(np.int64), np.stack(queries["impacts"].to_numpy()).astype(np.int64)
            for a in range(0, len(ids), STEP):
                q, found, scores = index.best(ids[a : a + STEP], rows[a : a + STEP], k)
                out.append(pd.DataFrame({"query_id": ids[a + q], "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    # Equal vectors spread over blocks by id; a block holds about VECTOR_BLOCK of them.
    key = ["vb", "qb", "size"]
    best = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Spark keeps no more than k rows per query on either side of the shuffle.
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """Queries are the vectors whose id is divisible by ``every``; candidates are all others."""
    vectors = quantised(embeddings)
    return search(vectors.where(F.col("vec_id") % every == 0), vectors, k)
