"""Approximate nearest neighbours by inner product with vantage-point trees.

Vectors are dealt by hash into shards of a bounded size, and a tree is built over each shard. A vector
gets one more component, ``sqrt(M**2 - |x|**2)`` with M the largest norm, and a query a zero there: then
the Euclidean order of candidates is their inner-product order, and the triangle inequality bounds what a
subtree can hold. A subtree is passed over when its bound times ``factor`` exceeds the distance of the
query's worst hit so far; factor 1 searches exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Scratch

#: Room for rounding in distances, so that equal ones are never passed over.
SLACK = 1e-6


@dataclass
class Tree:
    """Points in leaf order, and for each leaf its bounds: distances of its points from the vantage points above it."""

    order: np.ndarray
    leaf_at: np.ndarray
    vantage: np.ndarray
    paths: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build(points: np.ndarray, leaf: int) -> Tree:
    """Halves the points by their distance from a vantage point, down to leaves. Equal distances may fall on either side."""
    order, leaves, vantage = [], [], []

    def split(own: np.ndarray, path: list[tuple[int, float, float]]) -> None:
        if len(own) <= leaf:
            order.append(own)
            leaves.append(path)
            return
        far = np.linalg.norm(points[own] - points[own[0]], axis=1)
        at = points[own[int(np.argmax(far))]]
        vantage.append(at)
        n = len(vantage) - 1
        d = np.linalg.norm(points[own] - at, axis=1)
        by = np.argsort(d, kind="stable")
        half = len(own) // 2
        for part in (by[:half], by[half:]):
            split(own[part], [*path, (n, d[part[0]], d[part[-1]])])

    split(np.arange(len(points)), [])
    depth = max(map(len, leaves), default=0)
    paths = np.full((len(leaves), depth), -1, np.int64)
    low, high = np.zeros((len(leaves), depth)), np.full((len(leaves), depth), np.inf)
    for i, path in enumerate(leaves):
        for j, (n, a, b) in enumerate(path):
            paths[i, j], low[i, j], high[i, j] = n, a, b
    sizes = [len(x) for x in order]
    return Tree(np.concatenate(order) if order else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.array(vantage).reshape(len(vantage), points.shape[1]), paths, low, high)


def bounds(tree: Tree, queries: np.ndarray) -> np.ndarray:
    """For each query and leaf the least distance that a point of the leaf can have, by the triangle inequality."""
    out = np.zeros((len(queries), len(tree.paths)))
    if not len(tree.vantage):
        return out
    square = (queries**2).sum(1)[:, None] + (tree.vantage**2).sum(1)[None] - 2 * queries @ tree.vantage.T
    far = np.sqrt(np.maximum(square, 0))
    for j in range(tree.paths.shape[1]):
        has = tree.paths[:, j] >= 0
        d = far[:, np.maximum(tree.paths[:, j], 0)]
        out = np.maximum(out, np.where(has, np.maximum(tree.low[:, j] - d, d - tree.high[:, j]), 0))
    return np.maximum(out - SLACK, 0)


def search(tree: Tree, points: np.ndarray, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, flat: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of query, id, score) of each query's k nearest of these points but itself. Leaves are visited nearest first."""
    least = bounds(tree, queries)
    turn = np.argsort(least, axis=1, kind="stable")
    n = len(queries)
    best = np.full((n, k), -np.inf)
    names = np.full((n, k), np.iinfo(np.int64).max)
    ordered, ordered_ids = vectors[tree.order], ids[tree.order]
    norm = (points[:1] ** 2).sum() if len(points) else 0.0  # all points have the same norm M
    square = (queries**2).sum(1)
    live = np.arange(n)
    for r in range(least.shape[1]):
        leaf = turn[live, r]
        worst = np.sqrt(np.maximum(norm + square[live] - 2 * best[live, -1], 0))
        keep = least[live, leaf] * factor <= worst
        live, leaf = live[keep], leaf[keep]
        if not len(live):
            break
        by = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.append(True, leaf[by][1:] != leaf[by][:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(by))):
            rows = live[by[a:b]]
            at = slice(tree.leaf_at[leaf[by[a]]], tree.leaf_at[leaf[by[a]] + 1])
            # summed alike for every pair, so that equal vectors have equal scores
            scores = np.einsum("qd,cd->qc", flat[rows], ordered[at], optimize=False)
            found = np.broadcast_to(ordered_ids[at], scores.shape)
            scores = np.where(found == query_ids[rows][:, None], -np.inf, scores)
            s, i = np.concatenate([best[rows], scores], 1), np.concatenate([names[rows], found], 1)
            top = np.lexsort((i, -s), axis=1)[:, :k]
            best[rows], names[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    row, col = np.nonzero(np.isfinite(best))
    return row, names[row, col], best[row, col]


def usable(vec) -> F.Column:
    """Whether a vector takes part: not null, not zero, and all its components finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, factor: float = 1.0, shard: int = 4096, block: int = 2048, leaf: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row for which ``is_query`` holds.

    Null ids and ids that aren't whole numbers take no part; of rows with the same id each is a candidate.
    Vectors of other lengths than a query's are no candidates of it. Ties go to the smaller id. Fewer candidates than k give them all; no rows give none.
    Extra columns are left out, whatever their names.
    Every shard meets every block of queries: with S shards and B blocks, vectors are copied B times and
    queries S times, and a task holds one shard and one block.
    """
    scratch = Scratch(vectors.sparkSession, "vptree")
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).try_cast("long").alias("id"), vec.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = scratch.keep(rows, "vectors")
    n, asked, most = rows.agg(F.count("*"), F.count_if("q"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    shards, parts = max(1, -(-n // shard)), max(1, -(-asked // block))
    top = float(most or 0.0)
    index = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("q"))
    asks = rows.where("q").select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"), "q")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf["q"].to_numpy(bool)
        mine, theirs = pdf[~asked].sort_values("id", kind="stable"), pdf[asked]
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, y = np.stack(mine["v"].to_numpy()), np.stack(theirs["v"].to_numpy())
        extra = np.sqrt(np.maximum(top - (x**2).sum(1), 0))
        points = np.concatenate([x, extra[:, None]], 1)
        wide = np.concatenate([y, np.zeros((len(y), 1))], 1)
        q = theirs["id"].to_numpy(np.int64)
        row, ids, scores = search(build(points, leaf), points, mine["id"].to_numpy(np.int64), x, wide, q, y, k, factor)
        return pd.DataFrame({"query_id": q[row], "vec_id": ids, "score": scores})

    found = index.unionByName(asks).groupBy("shard", "part", F.size("v").alias("dims")).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
