"""Exact best inner products by an impact-ordered index, searched score at a time.

Vectors are dealt into blocks. A block's index has, for every dimension, its vectors ordered by component and cut
into segments of equal quantised impact. A query visits the segments of all dimensions by falling impact (its own
component times the segment's most favourable end) and adds each impact to the accumulators of the segment's
vectors. What a vector has not met yet can add no more than the impact reached, once for each dimension that it
still misses. The search of a block stops only when this bound leaves few vectors that could still
reach the k-th best exact score known so far; these are scored exactly. No vector is left out on an estimate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
#: Vectors in an index block and queries that meet it at a time.
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 4_096
#: Components of a block, so that wide vectors come in smaller blocks.
BLOCK_CELLS = 1 << 22
#: Segments of a dimension at most; the quantisation step is a power of two.
SEGMENTS = 16
#: Segments between two looks at the bound, and possible members at which a search goes over to exact scores.
LOOK_EVERY, FEW = 64, 128


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, with x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null, infinite or undefined component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


class ImpactIndex:
    """Index of one block: ids, components, and the segments (dimension, lowest, highest, members)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.dimension: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.members: list[np.ndarray] = []
        for d in range(vectors.shape[1]):
            column = vectors[:, d]
            span = int(column.max()) - int(column.min()) + 1
            step = max(0, math.ceil(math.log2(span / SEGMENTS))) if span > SEGMENTS else 0
            level = column >> step
            order = np.argsort(level, kind="stable")
            cuts = np.flatnonzero(np.diff(level[order])) + 1
            for part in np.split(order, cuts):
                own = column[part]
                self.dimension.append(d)
                self.low.append(int(own.min()))
                self.high.append(int(own.max()))
                self.members.append(part)
        self.dimension_of = np.array(self.dimension)
        self.low_of, self.high_of = np.array(self.low, np.int64), np.array(self.high, np.int64)

    def exact(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.vectors[at] @ query

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) but the query's own row; ties go to the smaller id."""
        n, dims = self.vectors.shape
        own = self.ids == query_id
        weight = query[self.dimension_of]
        impact = np.maximum(weight * self.low_of, weight * self.high_of)
        order = np.argsort(-impact, kind="stable")
        total, met = np.zeros(n, np.int64), np.zeros(n, np.int64)  # impacts so far, and of how many dimensions
        reached: np.ndarray | None = None
        for look in range(0, len(order), LOOK_EVERY):
            for s in order[look : look + LOOK_EVERY]:
                total[self.members[s]] += impact[s]
                met[self.members[s]] += 1
            after = look + LOOK_EVERY
            left = impact[order[after]] if after < len(order) else 0
            bound = total + (dims - met) * left
            bound[own] = np.iinfo(np.int64).min
            top = np.argpartition(-bound, min(k, n - 1))[: k + 1] if n > k else np.arange(n)
            top = top[~own[top]]
            seen = np.sort(self.exact(query, top))[::-1]
            if len(seen) < k:
                continue
            # Exact scores of k vectors: the k-th best overall is at least the least of them.
            floor = seen[k - 1]
            reached = floor if reached is None or floor > reached else reached
            if np.count_nonzero(bound >= reached) <= FEW + k:
                break
        possible = np.flatnonzero(~own if reached is None else (bound >= reached) & ~own)
        scores = self.exact(query, possible)
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible][best], scores[best]


def _search_group(keys, vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(vectors) and len(queries):
        width = max(map(len, [*vectors["v"], *queries["v"]]))
        full = lambda rows: np.array([np.pad(np.asarray(r, np.int64), (0, width - len(r))) for r in rows])
        index = ImpactIndex(vectors["vec_id"].to_numpy(np.int64), full(vectors["v"]))
        for query_id, query in zip(queries["query_id"].to_numpy(np.int64), full(queries["v"])):
            ids, scores = index.search(query_id, query, k)
            found["query_id"] += [query_id] * len(ids)
            found["vec_id"] += ids.tolist()
            found["score"] += scores.tolist()
    return pd.DataFrame(found)


def _blocks(table: DataFrame, rows: int) -> int:
    """Number of blocks of at most `rows` vectors and about BLOCK_CELLS components each.

    An error where an inner product of two vectors as large as the largest here would not fit into a long.
    """
    size, largest = F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    found = table.agg(F.count("*").alias("n"), size.alias("size"), largest.alias("largest")).first()
    width = max(1, found["size"] or 0)
    if width * (found["largest"] or 0.0) ** 2 >= 2.0**62:
        raise ValueError("the scaled components are too large for exact sums in 64 bits: choose a smaller scale")
    return max(1, math.ceil(found["n"] / max(1, min(rows, BLOCK_CELLS // width))))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k highest inner products of scaled vectors.

    Both tables have the columns `id` and `vector`; other columns play no part. A query's candidates are all
    rows but those with its id; with fewer than k, all are returned. Ties go to the smaller id; rows that repeat
    an id are candidates (and queries) once each. Vectors or ids that are null, or vectors with null or non-finite
    components, take no part; vectors of different length are filled up with zeros. Empty tables give an empty one.
    Any number of dimensions is allowed; scaled components whose sums of products could leave 63 bits are an error.

    Every block of queries meets every block of vectors once. A block's best k are ranked together afterwards.
    """
    ready = lambda df: df.where(F.col(id).isNotNull() & usable(F.col(vector)))
    held = ready(vectors).select(F.col(id).cast("long").alias("vec_id"), scaled(F.col(vector), scale).alias("v"))
    asked = ready(queries).select(F.col(id).cast("long").alias("query_id"), scaled(F.col(vector), scale).alias("v"))
    blocks, groups = _blocks(held, BLOCK_VECTORS), _blocks(asked, BLOCK_QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A hash of id and vector, so that rows repeating an id do not gather in one block.
    left = held.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("part", every(groups))
    right = asked.withColumn("part", F.pmod(F.xxhash64(F.lit("query"), "query_id"), F.lit(groups)).cast("int")).withColumn("block", every(blocks))
    schema = "query_id long, vec_id long, score long"
    near = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(
        lambda key, a, b: _search_group(key, a, b, k), schema
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
