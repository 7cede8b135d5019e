"""Exact top-k search by inner product with multi-resolution segment statistics.

Every vector is cut into segments. From the mean and the deviation of each segment follows a lower
bound of the Euclidean distance, ``sum m * ((mean_q - mean_v)^2 + (dev_q - dev_v)^2)``, which turns
into an upper bound of the inner product because the norms are known. Coarse segments are tried
first, finer ones on what is left, and only the survivors get their exact integer score.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.session import materialise

LEVELS = (4, 16)
#: Queries that one pass over the vectors serves: bounds what is broadcast (numbers, not rows).
BLOCK_NUMBERS = 1 << 21
#: Candidates whose scores give the first bounds: queries need not be candidates themselves.
FIRST_ROWS = 1 << 10
#: Doubles hold integers up to here exactly.
EXACT = float(1 << 53)


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, ints``: each component as ``floor(scale * x)``.

    Rows without an id, null vectors and vectors with a null or non-finite component are left out.
    """
    return (
        vectors.select("vec_id", "embedding")
        .filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
        .filter(
            "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x)"
            " AND abs(CAST(x AS DOUBLE)) < DOUBLE('Infinity'))"
        )
        .selectExpr("vec_id", f"transform(embedding, x -> floor({scale} * CAST(x AS DOUBLE))) AS ints")
    )


def segment_features(rows: np.ndarray, segments: int) -> np.ndarray:
    """Weighted means and deviations of ``segments`` segments, so that products are bounds."""
    edges = np.unique(np.linspace(0, rows.shape[1], min(segments, rows.shape[1]) + 1).astype(int))
    widths = np.diff(edges)
    sums = np.add.reduceat(rows, edges[:-1], axis=1)
    squares = np.add.reduceat(rows * rows, edges[:-1], axis=1)
    means = sums / widths
    spread = np.sqrt(np.maximum(squares / widths - means * means, 0.0))
    weight = np.sqrt(widths)
    return np.hstack([means * weight, spread * weight])


class QueryBlock:
    """Queries of one dimension with their features and current k-th best scores."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.features = [segment_features(rows.astype(float), s) for s in LEVELS]
        self.norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def scores(self, rows: np.ndarray, query: int) -> np.ndarray:
        one = self.rows[query]
        top = float(np.abs(rows).max(initial=0)) * float(np.abs(one).max(initial=0)) * max(1, len(one))
        if top < EXACT:
            return (rows.astype(float) @ one.astype(float)).astype(np.int64)
        return (rows * one).sum(axis=1)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take candidate rows in: bounds from coarse to fine, then exact scores."""
        if not len(ids):
            return
        numbers = rows.astype(float)
        norms = np.sqrt((numbers**2).sum(axis=1))
        coarse, *finer = [segment_features(numbers, s) for s in LEVELS]
        slack = 1e-6 * norms + 1e-6
        for q in range(len(self.ids)):
            allowed = self.least[q] - (1 + self.norms[q]) * slack
            left = np.flatnonzero(coarse @ self.features[0][q] >= allowed)
            for mine, theirs in zip(finer, self.features[1:], strict=True):
                left = left[mine[left] @ theirs[q] >= allowed[left]]
            left = left[ids[left] != self.ids[q]]
            if len(left):
                self._keep(q, ids[left], self.scores(rows[left], q))

    def _keep(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.r_[self.best[q][0], ids], np.r_[self.best[q][1], scores]
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], scores[order[-1]])


def _by_dimension(ids: list, ints: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.fromiter(map(len, ints), dtype=np.int64, count=len(ints))
    for size in np.unique(sizes):
        chosen = np.flatnonzero(sizes == size)
        rows = np.array([ints[i] for i in chosen], dtype=np.int64).reshape(len(chosen), size)
        yield np.array([ids[i] for i in chosen], dtype=np.int64), rows


def _search(queries: list, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = {}
        for ids, rows in _by_dimension([q[0] for q in queries], [q[1] for q in queries]):
            blocks[rows.shape[1]] = QueryBlock(ids, rows, k)
        for frame in frames:
            for ids, rows in _by_dimension(frame["vec_id"].tolist(), frame["ints"].tolist()):
                if rows.shape[1] in blocks and rows.shape[1]:
                    block = blocks[rows.shape[1]]
                    first = 0 if np.isfinite(block.least).all() else FIRST_ROWS
                    block.add(ids[:first], rows[:first])
                    block.add(ids[first:], rows[first:])
        for block in blocks.values():
            found = [(q, *pair) for q, (a, b) in zip(block.ids, block.best, strict=True) for pair in zip(a, b, strict=True)]
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def exact_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` highest integer inner products.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``; other columns are ignored. Ties go
    to the smaller ``vec_id``. Every vector is a candidate but those that bear the query's own id.
    Repeated candidate rows count each; a repeated query id with equal vector counts once. Vectors
    of different length are not compared; empty, null and non-finite ones take no part. Queries
    are taken in blocks of bounded size, each of which passes once over all vectors.
    """
    candidates = integer_vectors(vectors, scale)
    asked = materialise(integer_vectors(queries, scale).distinct(), "topk-queries")
    numbers = asked.agg(F.sum(F.size("ints") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(numbers / BLOCK_NUMBERS))
    parts = []
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        part = candidates.mapInPandas(
            _search([(r.vec_id, r.ints) for r in rows], k), "query_id long, vec_id long, score long"
        )
        parts.append(part if blocks == 1 else materialise(part, "topk-part"))
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
