"""Nearest neighbours through a few stable projections and kd-trees.

Gaussian (2-stable) projections to ``dims`` dimensions carry a distance d to d times the root of a chi-square variable
with ``dims`` degrees of freedom. Vectors are indexed by a kd-tree over their projections: its upper part deals them to
shards of bounded size, its lower part is built inside each. A query takes up leaves in the order of their projected
distance and verifies the original distances of their vectors. With d_k the k-th least distance verified so far, a
vector nearer than d_k lies beyond projected distance r with probability below ``1 - chi2(r^2 / d_k^2)``: once that is
at most ``1 - confidence`` the search stops.

Two rounds keep shards apart: each query is answered by the shard that its own projection falls in, and then by all
shards whose box is near enough by the same test; the answers are merged. The splits of the upper part are fitted
on at most ``sample`` vectors chosen by hash; every vector is indexed.

Equal vectors are one: a query can't need more than the k + 1 least ids of a vector, so only those are kept, and a vector
that a third of all rows have is no heavier than another.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do those
of another length than the most common one; a query is no neighbour of itself; with fewer than k candidates all are
returned; equal distances go by smaller id. Rows that repeat a vec_id with the same vector count once. Other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.llm.staging import staged

LEAF = 32


def chi_square_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """For an even number of degrees of freedom."""
    half, term = x / 2, np.ones_like(x)
    total = term.copy()
    for i in range(1, dims // 2):
        term = term * half / i
        total += term
    return 1 - np.exp(-half) * total


def stop_ratio(confidence: float, dims: int) -> float:
    """The least r^2 / d_k^2 at which the search may stop."""
    low, high = 0.0, 400.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(np.array([mid]), dims)[0] < confidence else (low, mid)
    return high


def projections(width: int, dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


def kd_leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: halves along the widest side until at most ``most`` rows are left."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        own = points[rows]
        side = int(np.ptp(own, axis=0).argmax())
        order = np.argsort(own[:, side], kind="stable")
        half = len(rows) // 2
        todo += [rows[order[half:]], rows[order[:half]]]
    return done


class Splits:
    """The upper part of the tree: where each shard's half-space splits are."""

    def __init__(self, points: np.ndarray, shards: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # side, value, left, right; a leaf is -1 - its number
        self.leaves = 0
        self.root = self._grow(points, shards)

    def _grow(self, points: np.ndarray, shards: int) -> int:
        if shards <= 1 or len(points) < 2:
            self.leaves += 1
            return -self.leaves
        side = int(np.ptp(points, axis=0).argmax())
        value = float(np.quantile(points[:, side], (shards // 2) / shards))
        low = points[:, side] <= value
        node = len(self.nodes)
        self.nodes.append((side, value, 0, 0))
        left, right = self._grow(points[low], shards // 2), self._grow(points[~low], shards - shards // 2)
        self.nodes[node] = (side, value, left, right)
        return node

    def shard(self, points: np.ndarray) -> np.ndarray:
        out = np.full(len(points), self.root)
        while (inner := np.flatnonzero(out >= 0)).size:
            nodes = np.array(self.nodes)[out[inner]]
            low = points[inner, nodes[:, 0].astype(int)] <= nodes[:, 1]
            out[inner] = np.where(low, nodes[:, 2], nodes[:, 3]).astype(int)
        return -1 - out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from each point to each box."""
    gap = np.maximum(np.maximum(low[None] - points[:, None], points[:, None] - high[None]), 0)
    return (gap * gap).sum(axis=2)


def search(vectors: np.ndarray, ids: list[list[int]], queries: np.ndarray, own: np.ndarray, k: int, ratio: float, project: np.ndarray, bound: np.ndarray) -> list[list[tuple[float, int]]]:
    """Each query's k nearest (distance, id) in one shard; ``bound`` are distances already known to hold k others."""
    points, asked = vectors @ project, queries @ project
    leaves = kd_leaves(points, LEAF)
    low, high = np.array([points[x].min(axis=0) for x in leaves]), np.array([points[x].max(axis=0) for x in leaves])
    out = []
    for i in range(len(queries)):
        away = box_distance(asked[i : i + 1], low, high)[0]
        found: list[tuple[float, int]] = []
        limit = float(bound[i])
        for j in np.argsort(away, kind="stable").tolist():
            if away[j] >= ratio * limit * limit and math.isfinite(limit):
                break
            rows = leaves[j]
            distances = np.sqrt(((vectors[rows] - queries[i]) ** 2).sum(axis=1))
            near = np.flatnonzero(distances <= limit)
            if near.size:
                found += [(float(distances[x]), other) for x in near.tolist() for other in ids[rows[x]] if other != own[i]]
                found.sort()
                del found[k:]
                if len(found) == k:
                    limit = min(limit, found[-1][0])
        out.append(found)
    return out


def usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in column]) if len(column) else np.zeros((0, 0))


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, dims: int = 8, confidence: float = 0.99, shard_rows: int = 20_000, sample: int = 100_000) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of each row whose vec_id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], out)
    width, n = sizes[0]["width"], sizes[0]["count"]
    rows = rows.where(F.size("v") == width)
    project, ratio = projections(width, dims), stop_ratio(confidence, dims)
    # Equal vectors: the k + 1 least ids, first among each part of the rows, then among what is left.
    parted = rows.distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = parted.withColumn("r", F.row_number().over(Window.partitionBy("v", "part").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(sample, n)).select("v").toPandas()  # bounded by ``sample``
    splits = Splits(stacked(chosen["v"]) @ project, -(-n // shard_rows))

    def place(batches):
        for batch in batches:
            points = stacked(batch["v"]) @ project if len(batch) else np.zeros((0, dims))
            yield batch.assign(shard=splits.shard(points).astype(np.int64), p=list(points))

    index = staged(distinct.mapInPandas(place, "v array<double>, ids array<long>, shard long, p array<double>"), "index")
    asked = staged(rows.where(F.col("vec_id") % every == 0).distinct().mapInPandas(place, "vec_id long, v array<double>, shard long, p array<double>"), "queries")
    extent = [f(F.col("p")[i]).alias(f"{s}{i}") for s, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    boxes = index.groupBy("shard").agg(*extent).orderBy("shard").toPandas()  # at most one row for each shard of the fitted splits
    low, high = (boxes[[f"{s}{i}" for i in range(dims)]].to_numpy() for s in ("low", "high"))
    numbers = boxes["shard"].to_numpy()

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(left) and len(right):
            found = search(stacked(left["v"]), list(left["ids"]), stacked(right["v"]), right["vec_id"].to_numpy(), k, ratio, project, right["bound"].to_numpy())
            made = [(q, other, d) for q, own in zip(right["vec_id"], found, strict=True) for d, other in own]
        return pd.DataFrame(made, columns=["query_id", "vec_id", "score"])

    found_as = "query_id long, vec_id long, score double"

    def ask(queries: DataFrame) -> DataFrame:
        return index.groupBy("shard").cogroup(queries.groupBy("shard")).applyInPandas(answer, found_as)

    first = staged(ask(asked.withColumn("bound", F.lit(float("inf")))), "found")
    limits = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))

    def others(batches):
        for batch in batches:
            made = []
            if len(batch):
                away = box_distance(stacked(batch["p"]), low, high)
                bound = batch["bound"].to_numpy()
                near = away < ratio * np.where(np.isfinite(bound), bound, np.inf)[:, None] ** 2
                near[:, :] &= numbers[None] != batch["shard"].to_numpy()[:, None]
                which, shard = np.nonzero(near)
                made = batch.iloc[which].assign(shard=numbers[shard])
            yield made if len(batch) else batch

    visiting = asked.join(limits.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").fillna({"bound": float("inf")})
    second = ask(visiting.mapInPandas(others, "vec_id long, v array<double>, shard long, p array<double>, bound double"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
