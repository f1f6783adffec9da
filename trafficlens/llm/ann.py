"""Nearest neighbours by inner product with vantage-point trees, one tree per shard.

Inner products become distances by one more coordinate: with M the largest length, a vector x is stored as
(x, sqrt(M^2 - |x|^2)) and a query as (q, 0); the nearest stored vector then has the largest inner product.

Each shard splits its vectors by the median distance to a vantage point, down to leaves, and keeps the range of
distances on either side of every split. For a query the triangle inequality bounds the distance to each leaf
from below; leaves are visited from the smallest bound up, until the bound reaches `factor` times the distance
of the worst neighbour found. Factor one is exact search, smaller factors prune more. Scores are then
computed on the original vectors in double precision.

Shards and blocks of queries form a grid, each cell of which is one task of bounded size. Equal vectors of a
shard are one point of its tree, which holds their smallest ids, as many as may be asked for.

Defined cases: vectors that are null, zero, of another length than most, or that hold nulls or non-finite
numbers take no part, nor do rows without an id; of rows with one id one is kept; a query never finds
itself; equal scores are in order of id; fewer candidates than asked for are all returned.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.schema import require_positive
from trafficlens.session import written

FACTOR = 0.25
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 4096, 128
# Candidates kept beyond those asked for, so that rounding cannot decide which of them is returned.
SPARE = 8


class VantageTree:
    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS, seed: int = 0):
        """`points`: distinct rows."""
        self.points = points
        rng = np.random.default_rng(seed)
        self.vantage, self.leaves, self.paths = [], [], []
        open_nodes = [(np.arange(len(points)), [])]
        while open_nodes:
            rows, path = open_nodes.pop()
            if len(rows) <= leaf_rows:
                self.leaves.append(rows)
                self.paths.append(path)
                continue
            vantage = int(rng.choice(rows))
            away = np.sqrt(np.maximum(((points[rows] - points[vantage]) ** 2).sum(axis=1), 0))
            order = np.argsort(away, kind="stable")
            half = len(rows) // 2
            node = len(self.vantage)
            self.vantage.append(vantage)
            for part in (order[:half], order[half:]):
                open_nodes.append((rows[part], [*path, (node, away[part[0]], away[part[-1]])]))

    def bounds(self, to_vantage: np.ndarray) -> np.ndarray:
        """Least distance of each query (row) to the points of each leaf (column)."""
        out = np.zeros((len(to_vantage), len(self.leaves)))
        for leaf, path in enumerate(self.paths):
            for node, low, high in path:
                d = to_vantage[:, node]
                np.maximum(out[:, leaf], np.maximum(low - d, d - high), out=out[:, leaf])
        return out

    def search(self, queries: np.ndarray, k: int, factor: float) -> np.ndarray:
        """Rows of the `k` nearest points of each query, -1 where there are fewer."""
        distances = lambda q, p: np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * q @ p.T, 0))
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1, dtype=np.int64)
        to_vantage = distances(queries, self.points[self.vantage]) if self.vantage else np.zeros((len(queries), 0))
        bound = self.bounds(to_vantage)
        order = np.argsort(bound, axis=1, kind="stable")
        active = np.arange(len(queries))
        for step in range(len(self.leaves)):
            leaf = order[active, step]
            # Rounding may lift a bound by a little: equal distances are looked at.
            near = bound[active, leaf] <= factor * best[active, -1] + 1e-9
            active, leaf = active[near], leaf[near]  # later leaves have larger bounds
            if not active.size:
                break
            by_leaf = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
            for group in np.split(by_leaf, cuts):
                who, rows = active[group], self.leaves[leaf[group[0]]]
                both = np.concatenate([best[who], distances(queries[who], self.points[rows])], axis=1)
                ids = np.concatenate([found[who], np.broadcast_to(rows, (len(who), len(rows)))], axis=1)
                keep = np.argpartition(both, k - 1, axis=1)[:, :k] if both.shape[1] > k else np.arange(k)[None].repeat(len(who), 0)
                both, ids = np.take_along_axis(both, keep, 1), np.take_along_axis(ids, keep, 1)
                worst = np.argmax(both, axis=1)
                last = np.arange(len(who))
                both[last, worst], both[last, -1] = both[last, -1], both[last, worst].copy()
                ids[last, worst], ids[last, -1] = ids[last, -1], ids[last, worst].copy()
                best[who], found[who] = both, ids
        return found


def _search_cell(longest: float, k: int, factor: float, leaf_rows: int):
    def run(key, shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if shard.empty or asked.empty:
            return empty
        shard = shard.sort_values("vec_id")
        ids, vectors = shard["vec_id"].to_numpy(), np.stack(shard["vector"].to_numpy())
        _, first, same = np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_index=True, return_inverse=True)
        points = vectors[first]
        # Ids of equal vectors in order; more than k + 1 of them are never asked for.
        by_point = np.argsort(same, kind="stable")
        start = np.searchsorted(same[by_point], np.arange(len(points)))
        count = np.minimum(np.diff(np.append(start, len(ids))), k + 1)

        extra = np.sqrt(np.maximum(longest**2 - (points**2).sum(axis=1), 0))
        tree = VantageTree(np.column_stack([points, extra]), leaf_rows, seed=int(key[0]))
        query_ids, queries = asked["query_id"].to_numpy(), np.stack(asked["vector"].to_numpy())
        near = tree.search(np.column_stack([queries, np.zeros(len(queries))]), k + 1 + SPARE, factor)
        who, slot = np.nonzero(near >= 0)
        rows = near[who, slot]
        score = (points[rows] * queries[who]).sum(axis=1)
        # Every pair of query and point stands for the ids of the point.
        times = count[rows]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        found = ids[by_point[np.repeat(start[rows], times) + nth]]
        who, score = np.repeat(who, times), np.repeat(score, times)
        other = found != query_ids[who]
        found, who, score = found[other], who[other], score[other]
        order = np.lexsort([found, -score, who])
        found, who, score = found[order], who[order], score[order]
        top = np.arange(who.size) - np.searchsorted(who, who) < k
        return pd.DataFrame({"query_id": query_ids[who[top]], "vec_id": found[top], "score": score[top]})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`vec_id, vector` in double precision of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & some).dropDuplicates(["vec_id"])


def nearest(
    vectors: DataFrame, *, queries, k: int, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` nearest rows of each row that meets `queries`, a condition on
    `vec_id`."""
    require_positive("k", k)
    if not 0 < factor <= 1:
        raise ValueError("factor must be over 0 and at most 1")
    rows = written(usable(vectors, id_col, vector_col), "ann-vectors")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"), F.max(length).alias("longest"))
    most = sizes.orderBy(F.desc("rows"), "n").first()
    if most is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == most["n"])
    asked = rows.where(queries).select(F.col("vec_id").alias("query_id"), "vector")
    shards, blocks = -(-most["rows"] // shard_rows), -(-asked.count() // QUERY_ROWS)
    if not blocks:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    held = rows.withColumn("shard", dealt("vec_id", shards)).withColumn("block", every(blocks))
    asks = asked.withColumn("block", dealt("query_id", blocks)).withColumn("shard", every(shards))
    cells = held.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block"))
    search = _search_cell(float(most["longest"]), k, factor, leaf_rows)
    found = cells.applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
