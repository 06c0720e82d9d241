"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

Vectors are dealt into shards of bounded size, query vectors into blocks of bounded size, and every (shard, block) is
one group: it builds the shard's tree and searches the block through it. The best of all shards are ranked in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.llm import common

LEAF = 48


def distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distance of every query (rows) to every point (columns), in double precision."""
    out = np.empty((len(queries), len(points)))
    step = max(1, 2_000_000 // max(1, points.size))
    for i in range(0, len(queries), step):
        gap = queries[i : i + step, None, :] - points[None, :, :]
        out[i : i + step] = np.sqrt((gap * gap).sum(axis=2))
    return out


def build(points: np.ndarray, members: np.ndarray, rng: np.random.Generator):
    """A tree: a leaf is an array of members, a node (vantage, radius, inner, outer).

    Points that all lie equally far from the vantage point cannot be parted and stay one leaf.
    """
    if len(members) <= LEAF:
        return members
    members = members.copy()
    at = rng.integers(len(members))
    members[[0, at]] = members[[at, 0]]
    far = distances(points[members[1:]], points[members[:1]])[0]
    radius = float(np.median(far))
    inner, outer = members[1:][far <= radius], members[1:][far > radius]
    if not len(outer):
        inside = far < radius
        if not inside.any():
            return members
        radius = float(far[inside].max())
        inner, outer = members[1:][inside], members[1:][~inside]
    return members[0], radius, build(points, inner, rng), build(points, outer, rng)


class Search:
    """The ``k`` nearest of each query so far, nearest first, ties to the smaller id."""

    def __init__(self, ids, points, query_ids, queries, k: int, factor: float):
        self.ids, self.points, self.query_ids, self.queries, self.factor = ids, points, query_ids, queries, factor
        self.far = np.full((len(queries), k), np.inf)
        self.who = np.full((len(queries), k), np.iinfo(np.int64).max)

    def offer(self, active: np.ndarray, members: np.ndarray, far: np.ndarray) -> None:
        ids = self.ids[members]
        far = np.where(ids[None, :] == self.query_ids[active][:, None], np.inf, far)
        k = self.far.shape[1]
        hit = (far <= self.far[active, -1][:, None]).any(axis=1)
        if not hit.any():
            return
        active, far = active[hit], far[hit]
        all_far = np.hstack([self.far[active], far])
        all_who = np.hstack([self.who[active], np.broadcast_to(ids, far.shape)])
        all_who[np.isinf(all_far)] = np.iinfo(np.int64).max
        best = np.lexsort((all_who, all_far), axis=1)[:, :k]
        self.far[active] = np.take_along_axis(all_far, best, axis=1)
        self.who[active] = np.take_along_axis(all_who, best, axis=1)

    def visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if not isinstance(node, tuple):
            self.offer(active, node, distances(self.points[node], self.queries[active]))
            return
        vantage, radius, inner, outer = node
        far = distances(self.points[[vantage]], self.queries[active])
        self.offer(active, np.array([vantage]), far)
        far = far[:, 0]
        near_inner = far <= radius
        self.visit(inner, active[near_inner])
        self.visit(outer, active[~near_inner])
        # What the triangle inequality leaves of the other side; rounding must not prune a tie.
        least = (np.abs(far - radius) - 1e-12 * (far + radius)) * self.factor
        open_ = least <= self.far[active, -1]
        self.visit(outer, active[near_inner & open_])
        self.visit(inner, active[~near_inner & open_])


def usable(v: Column) -> Column:
    """Not NULL, no NULL or non-finite component, not all zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & ok & F.exists(v, lambda x: x != 0)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = 2_048,
    block_rows: int = 4_096,
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for every row of ``queries``: query_id, rank, vec_id, score.

    ``factor`` 1 is exact. A larger one prunes a branch already when ``factor`` times its least possible distance is
    beyond the k-th best. Rows with the query's own id are no candidates. Vectors that are NULL, zero or hold NULL or
    non-finite components take no part, nor do rows without id; vectors of different length are never compared.
    Repeated rows are candidates of their own; a repeated query id is asked once. Fewer than ``k`` candidates give fewer rows; empty tables give none.
    """
    if factor < 1:
        raise ValueError("factor: 1 is exact, larger prunes more")

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        return df.where(usable(v) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim")
        )

    base = clean(vectors)
    asked = clean(queries).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.*")
    shards = max(1, math.ceil(base.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / block_rows))
    row = F.xxhash64(F.monotonically_increasing_id())
    base = base.withColumn("shard", F.pmod(row, F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    asked = asked.withColumn("block", F.pmod(row, F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    )

    def nearest(points: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(block):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        matrix, ids = np.vstack(points["v"].to_numpy()), points["id"].to_numpy(np.int64)
        query_ids = block["id"].to_numpy(np.int64)
        found = Search(ids, matrix, query_ids, np.vstack(block["v"].to_numpy()), k, factor)
        found.visit(build(matrix, np.arange(len(ids)), np.random.default_rng(7)), np.arange(len(query_ids)))
        got = np.isfinite(found.far)
        return pd.DataFrame(
            {
                "query_id": np.broadcast_to(query_ids[:, None], got.shape)[got],
                "vec_id": found.who[got],
                "score": found.far[got],
            }
        )

    keys = ("shard", "block", "dim")
    found = (
        base.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(nearest, "query_id bigint, vec_id bigint, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def brute_force(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple]:
    """What an exact search must find."""
    for q in query_ids:
        far = distances(points, points[ids == q][:1])[0]
        order = np.lexsort((ids, far))
        for rank, i in enumerate(order[ids[order] != q][:k], 1):
            yield int(q), rank, int(ids[i]), float(far[i])


def query(spark, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every row whose id is divisible by 100, against all rows; exact."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0))
