"""Approximate nearest neighbours: stable projections, kd-trees, and a chi-square stopping test."""

from __future__ import annotations

from math import ceil, exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.shared import cut, ship
from sluice.llm.vectors import directions, unit

NEIGHBOURS = 5
#: Dimensions of the projection; even, so that the chi-square distribution has a closed form.
PROJECTED = 8
#: Probability that a nearer neighbour, if there were one, would have been seen before the search ends.
CONFIDENCE = 0.97
SEED = 42
#: Vectors of a shard on average.
SHARD = 8192
LEAF = 32
LEAVES_AT_ONCE = 8
QUERIES_AT_ONCE = 256
#: Slack for rounding, so that equal vectors are all looked at.
SLACK = 1e-9


def chi_square(x: float, degrees: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(degrees // 2))


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


def projection(dim: int, projected: int = PROJECTED, seed: int = SEED) -> np.ndarray:
    """A Gaussian matrix, the 2-stable projection; the same in every task."""
    return np.random.default_rng([seed, dim, projected]).standard_normal((dim, projected))


class KDTree:
    """A kd-tree over projected points: halved at the median of the widest side, down to leaves."""

    def __init__(self, points: np.ndarray) -> None:
        leaves, todo = [], [np.arange(len(points))] if len(points) else []
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            axis = np.ptp(points[part], axis=0).argmax()
            half = len(part) // 2
            part = part[np.argpartition(points[part, axis], half)]
            todo += [part[half:], part[:half]]
        self.members = np.full((len(leaves), LEAF), -1)
        for i, part in enumerate(leaves):
            self.members[i, : len(part)] = part
        self.low = np.array([points[p].min(axis=0) for p in leaves]).reshape(len(leaves), -1)
        self.high = np.array([points[p].max(axis=0) for p in leaves]).reshape(len(leaves), -1)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query from each leaf's box."""
        out = np.zeros((len(queries), len(self.low)))
        for axis in range(queries.shape[1]):
            at = queries[:, axis, None]
            out += np.maximum(0, np.maximum(self.low[None, :, axis] - at, at - self.high[None, :, axis])) ** 2
        return out


class Shard:
    """Candidates with a kd-tree over their projection; unit rows, ids sorted."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, projected: int = PROJECTED) -> None:
        self.points, self.ids, self.projected = points, ids, projected
        self.matrix = projection(points.shape[1], projected)
        self.flat = points @ self.matrix
        self.tree = KDTree(self.flat)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray, int]:
        """Best ``k`` points of each query, by cosine.

        Leaves come in the order of their distance in the projection.  With d
        the distance of the k-th best so far, a point at the projected
        distance r is verified, by its cosine, only while chi-square(r^2 / d^2)
        is at most the confidence; a search ends at the first leaf beyond that
        radius.  A nearer point would have been seen with that probability.

        Returns indexes of points (-1: none) and cosines, best first, ties to
        the smaller index, and how many points were verified.
        """
        points, ids, flat, tree = self.points, self.ids, self.flat, self.tree
        limit = chi_square_quantile(confidence, self.projected)
        best = np.full((len(queries), k), -1)
        score = np.full((len(queries), k), -np.inf)
        verified = 0
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            part = np.arange(at, min(len(queries), at + QUERIES_AT_ONCE))
            start = queries[part] @ self.matrix
            bound = tree.bounds(start)
            order = np.argsort(bound, axis=1, kind="stable")
            bound = np.take_along_axis(bound, order, axis=1)
            for leaf in range(0, order.shape[1], LEAVES_AT_ONCE):
                part = part[bound[part - at, leaf] <= limit * (2 - 2 * score[part, -1]) + SLACK]
                if not len(part):
                    break
                radius = limit * (2 - 2 * score[part, -1]) + SLACK
                found = tree.members[order[part - at, leaf : leaf + LEAVES_AT_ONCE]].reshape(len(part), -1)
                away = sum((start[part - at, axis, None] - flat[found, axis]) ** 2 for axis in range(self.projected))
                row, column = np.nonzero((found >= 0) & (away <= radius[:, None]) & (ids[found] != query_ids[part, None]))
                cosine = np.full(found.shape, -np.inf)
                cosine[row, column] = np.einsum("pd,pd->p", queries[part[row]], points[found[row, column]])
                verified += len(row)
                some = cosine.max(axis=1) >= score[part, -1]  # only where a point is as near as the k-th best
                rows, found, cosine = part[some], found[some], cosine[some]
                every, cosines = np.concatenate([best[rows], found], 1), np.concatenate([score[rows], cosine], 1)
                every[np.isneginf(cosines)] = -1
                first = np.lexsort((every, -cosines), axis=1)[:, :k]
                best[rows], score[rows] = np.take_along_axis(every, first, 1), np.take_along_axis(cosines, first, 1)
        return best, score, verified


def search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, confidence: float = CONFIDENCE, projected: int = PROJECTED) -> tuple[np.ndarray, np.ndarray, int]:
    """``Shard.search`` on a shard made for it."""
    return Shard(points, ids, projected).search(queries, query_ids, k, confidence)


def _search(k: int, confidence: float, projected: int):
    """Rows of a partition come sorted by dimension, shard and kind: a shard's points, then its queries, which stream past its tree."""

    def run(batches):
        key, waiting, shard = None, [], None
        for batch in batches:
            for this, rows in batch.groupby(["dim", "shard", "query"], sort=False):
                if this[:2] != key:
                    key, waiting, shard = this[:2], [], None
                if not this[2]:
                    waiting.append(rows[["id", "v"]])
                    continue
                if shard is None:
                    if not waiting:
                        continue
                    points = pd.concat(waiting).sort_values("id", kind="stable", ignore_index=True)
                    shard, waiting = Shard(unit(points["v"]), points["id"].to_numpy(), projected), []
                ids = rows["id"].to_numpy()
                best, score, _ = shard.search(unit(rows["v"]), ids, k, confidence)
                query, nth = np.nonzero(best >= 0)
                yield pd.DataFrame({"query": ids[query], "id": shard.ids[best[query, nth]], "score": score[query, nth]})

    return run


def nearest(
    embeddings: DataFrame,
    is_query: Column,
    k: int = NEIGHBOURS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    confidence: float = CONFIDENCE,
    projected: int = PROJECTED,
) -> DataFrame:
    """The ``k`` nearest vectors, by cosine, of each row for which ``is_query`` holds.

    Every vector is a candidate.  Candidates are dealt into shards by a hash,
    each with one kd-tree over its projection, built once; the queries of all
    blocks stream past it, so a task holds one shard and a batch of queries
    whatever the table's size.  Vectors are shuffled once, queries once per
    shard.  The few results per query are merged by a ranking that Spark
    limits per group before the shuffle.

    Returns ``query_id``, ``rank`` (from 1), the id column and ``score`` (the
    cosine, in double precision).  Ties go to the smaller id.  Cases: vectors
    that are null, empty, zero or hold null or non-finite components and rows
    with a null id take no part; a query's candidates have its dimension and
    another id; with fewer candidates all are returned; rows with the same id
    and vector are one; a query id with several vectors gets the nearest of
    any of them, and a candidate id its best score; no rows give no rows.
    """
    ship(embeddings.sparkSession)
    every = cut(directions(embeddings, id_col, vector_col).distinct())
    asks = cut(directions(embeddings.where(is_query), id_col, vector_col).distinct())
    shards = max(1, ceil(every.count() / SHARD))
    home = F.pmod(F.xxhash64("id", "v", F.lit(SEED)), F.lit(shards)).cast("int")
    points = every.select("dim", home.alias("shard"), F.lit(False).alias("query"), "id", "v")
    queries = asks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "id", "v")
    rows = points.unionByName(queries).repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", "query")
    kind = every.schema["id"].dataType.simpleString()
    found = rows.mapInPandas(_search(k, confidence, projected), f"query {kind}, id {kind}, score double")
    best = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
