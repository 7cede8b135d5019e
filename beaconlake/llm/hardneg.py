"""Hard negatives of anchors by segment summary filtering.

Every vector is stored with the mean and the deviation of each of its segments, coarse and fine. For
a segment of width w the inner product of two vectors lies within
``w * (mean_a * mean_b +- dev_a * dev_b)``, so the sum over the segments bounds the score from both
sides. Pairs whose coarse bounds cannot reach what is asked for go, the rest is tried with the
finer segments, and only the survivors get their exact integer score.

Two passes over the table for each block of anchors: the first finds the positives of an anchor, the
second the best rows of other labels within a band below each positive's score.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.session import materialise

LEVELS = (4, 16)
#: Numbers of one block of anchors: bounds what the driver and each task hold of them.
BLOCK_NUMBERS = 1 << 20
#: Pairs of rows and anchors that are bounded together; a task begins with fewer, to get thresholds early.
PAIRS, FIRST_PAIRS = 1 << 20, 1 << 16
EXACT, LONG = float(1 << 53), (1 << 63) - 1
SUMMARIES = "vec_id long, label long, ints array<long>, summary array<double>"


def summaries(rows: np.ndarray) -> np.ndarray:
    """Weighted segment means and deviations of all levels, side by side."""
    parts = []
    for segments in LEVELS:
        edges = np.unique(np.linspace(0, rows.shape[1], min(segments, rows.shape[1]) + 1).astype(int))
        widths = np.diff(edges)
        means = np.add.reduceat(rows, edges[:-1], axis=1) / widths
        squares = np.add.reduceat((rows - np.repeat(means, widths, axis=1)) ** 2, edges[:-1], axis=1)
        parts += [means * np.sqrt(widths), np.sqrt(squares)]
    return np.hstack(parts)


def level_slices(dimension: int) -> list[tuple[slice, slice]]:
    """Where the means and the deviations of each level stand in a summary."""
    found, at = [], 0
    for segments in LEVELS:
        n = min(segments, dimension)
        found.append((slice(at, at + n), slice(at + n, at + 2 * n)))
        at += 2 * n
    return found


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products of any size; what exceeds 64 bits ends at their limit."""
    wide = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([max(-LONG - 1, min(LONG, int(x))) for x in wide], dtype=np.int64)


def _matrix(values: list, dtype) -> np.ndarray:
    return np.array([np.asarray(v, dtype=dtype) for v in values], dtype=dtype)


def _by_dimension(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    sizes = frame["ints"].str.len()
    for _, part in frame[sizes > 0].groupby(sizes):
        yield part


def _summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in _by_dimension(frame):
            yield part.assign(summary=list(summaries(_matrix(part["ints"].tolist(), np.int64).astype(float))))


def summary_table(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, ints, summary`` of all usable rows, stored.

    Rows without an id or a label, null and empty vectors and those with a null or non-finite
    component are left out.
    """
    rows = (
        vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
        .filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
        .filter(
            "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x)"
            " AND abs(CAST(x AS DOUBLE)) < DOUBLE('Infinity'))"
        )
        .selectExpr("vec_id", "label", f"transform(embedding, x -> floor({scale} * CAST(x AS DOUBLE))) AS ints")
    )
    return materialise(rows.mapInPandas(_summarise, SUMMARIES), "hardneg-summaries")


class Anchors:
    """Anchors of one dimension, each with bands of scores whose best rows are wanted.

    ``low`` and ``high`` are arrays of anchors x bands; a band with ``low > high`` wants nothing.
    """

    def __init__(self, keys, ids, labels, rows, features, low, high, keep, same_label):
        self.keys, self.ids, self.labels, self.rows, self.features = keys, ids, labels, rows, features
        self.low, self.high, self.keep, self.same = low, high, keep, same_label
        self.norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
        self.levels = level_slices(rows.shape[1])
        self.best = {}  # (anchor, band) -> ids and scores
        # What a row must be able to reach: the band's lower end, then its last kept score; a
        # float's width aside, because large integers are rounded.
        self.least = np.nextafter(np.where(low <= high, low, np.inf).astype(float), -np.inf)
        self.most = np.nextafter(np.where(low <= high, high, -np.inf).astype(float), np.inf)

    def add(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, features: np.ndarray) -> None:
        """Take rows in, compared with all anchors at once, level by level."""
        left = ((labels[:, None] == self.labels) == self.same) & (ids[:, None] != self.ids)
        slack = np.outer(1e-9 * np.sqrt((rows.astype(float) ** 2).sum(axis=1)), self.norms) + 1e-6
        floor, ceiling = self.least.min(axis=1), self.most.max(axis=1)
        kept = np.arange(len(rows))  # rows that some anchor may still want
        for means, devs in self.levels:
            middle = features[kept][:, means] @ self.features[:, means].T
            spread = features[kept][:, devs] @ self.features[:, devs].T + slack[kept]
            left &= (middle + spread >= floor) & (middle - spread <= ceiling)
            some = left.any(axis=1)
            kept, left = kept[some], left[some]
        if not len(kept):
            return
        scores = self.scores(rows[kept], left)
        wanted = np.zeros_like(left)
        for band in range(self.low.shape[1]):
            wanted |= (scores >= self.least[:, band]) & (scores <= self.most[:, band])
        q, i = np.nonzero((left & wanted).T)
        starts = np.flatnonzero(np.r_[True, np.diff(q) != 0]) if len(q) else q
        for at, end in zip(starts, np.r_[starts[1:], len(q)] if len(q) else q, strict=True):
            self._keep(q[at], ids[kept[i[at:end]]], scores[i[at:end], q[at]])

    def scores(self, rows: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Exact scores, where ``left`` asks for them."""
        top = float(np.abs(rows.astype(float)).max()) * float(np.abs(self.rows.astype(float)).max()) * rows.shape[1]
        if top < EXACT:  # then a product of matrices is exact, and faster than pair by pair
            return (rows.astype(float) @ self.rows.astype(float).T).astype(np.int64)
        found = np.zeros(left.shape, dtype=np.int64)
        i, q = np.nonzero(left)
        found[i, q] = exact_scores(rows[i], self.rows[q])
        return found

    def _keep(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        for band in range(self.low.shape[1]):
            inside = (scores >= self.low[q, band]) & (scores <= self.high[q, band]) & (scores >= self.least[q, band])
            if not inside.any():
                continue
            mine = self.best.get((q, band), (np.empty(0, np.int64), np.empty(0, np.int64)))
            some, values = np.concatenate([mine[0], ids[inside]]), np.concatenate([mine[1], scores[inside]])
            order = np.lexsort((some, -values))[: self.keep]
            self.best[q, band] = some[order], values[order]
            if len(order) == self.keep:
                self.least[q, band] = max(self.least[q, band], np.nextafter(float(values[order[-1]]), -np.inf))

    def found(self) -> Iterator[tuple[int, int, int, int, int]]:
        for (q, band), (ids, scores) in self.best.items():
            for one, score in zip(ids.tolist(), scores.tolist(), strict=True):
                yield int(self.keys[q]), int(self.ids[q]), band, one, score


def _search(asked: list[tuple], keep: int, same_label: bool):
    """Best rows of each band; ``asked``: key, id, label, ints, summary, lower and upper ends of bands."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = {}
        for size in sorted({len(a[3]) for a in asked}):
            keys, ids, labels, ints, features, low, high = zip(*(a for a in asked if len(a[3]) == size), strict=True)
            blocks[size] = Anchors(
                keys, np.array(ids), np.array(labels), _matrix(ints, np.int64), _matrix(features, float),
                np.array(low, dtype=np.int64), np.array(high, dtype=np.int64), keep, same_label,
            )
        pairs = FIRST_PAIRS
        for frame in frames:
            for part in _by_dimension(frame):
                if (block := blocks.get(len(part["ints"].iloc[0]))) is None:
                    continue
                at = 0
                while at < len(part):
                    step = max(1, pairs // len(block.ids))
                    some = part.iloc[at : at + step]
                    block.add(
                        some["vec_id"].to_numpy(dtype=np.int64), some["label"].to_numpy(dtype=np.int64),
                        _matrix(some["ints"].tolist(), np.int64), _matrix(some["summary"].tolist(), float),
                    )
                    at, pairs = at + step, PAIRS
        rows = [row for block in blocks.values() for row in block.found()]
        yield pd.DataFrame(rows, columns=["key", "anchor_id", "band", "vec_id", "score"]).astype("int64")

    return run


FOUND = "key long, anchor_id long, band long, vec_id long, score long"


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("key", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column | str, positives: int = 5, negatives: int = 5,
    least_percent: int = 80, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` has ``vec_id``, ``label`` (integer) and ``embedding``; other columns are ignored.
    ``is_anchor`` is a condition on ``vec_id`` and ``label``. Scores are integer inner products of
    components ``floor(scale * x)``. An anchor's positives are its highest other rows of the same label;
    for each of them, the highest rows of other labels follow whose score is at most the positive's and
    at least ``least_percent`` hundredths of it. Ties go to the smaller ``vec_id``.

    Rows without id or label, and null, empty or non-finite vectors take no part. "Other" means another
    id; repeated rows count each, a repeated anchor counts once, and anchors that share an id but differ
    in vector or label are mined apart. Vectors of different length are not
    compared. A positive below zero has no negatives, one without any in its band gives no row, and an
    empty table gives none. Anchors are taken in blocks of bounded size; every block passes twice over all rows.
    """
    table = summary_table(vectors, scale)
    anchors = table.filter(is_anchor).distinct().withColumn("key", F.monotonically_increasing_id())
    anchors = materialise(anchors, "hardneg-anchors")
    numbers = anchors.agg(F.sum(F.size("ints") + F.size("summary") + 2 * positives + 2)).first()[0] or 0
    blocks = max(1, math.ceil(numbers / BLOCK_NUMBERS))
    parts = []
    for block in range(blocks):
        here = anchors.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        asked = [(a.key, a.vec_id, a.label, a.ints, a.summary) for a in here.collect()]
        search = _search([(*a, [-LONG - 1], [LONG]) for a in asked], positives, True)
        near = _best(table.mapInPandas(search, FOUND), positives)
        near = materialise(near.selectExpr("key", "rank - 1 AS band", "vec_id", "score"), "hardneg-positives")
        tops = {}
        for r in near.select("key", "band", "score").collect():
            tops.setdefault(r.key, {})[r.band] = r.score
        wanted = []
        for a in asked:
            high = [tops.get(a[0], {}).get(band, -1) for band in range(positives)]
            low = [-(-least_percent * p // 100) if p >= 0 else 0 for p in high]
            if max(high) >= 0:
                wanted.append((*a, low, high))
        found = _best(table.mapInPandas(_search(wanted, negatives, False), FOUND), negatives)
        part = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(
            near.withColumnsRenamed({"vec_id": "positive_id", "score": "positive_score"}), ["key", "band"]
        )
        parts.append(part if blocks == 1 else materialise(part, "hardneg-part"))
    return reduce(DataFrame.unionByName, parts).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
