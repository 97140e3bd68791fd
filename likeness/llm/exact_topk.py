"""Operator 7: exact search of the largest inner products, by ball trees.

The rows are dealt into shards of bounded size. Each shard builds a ball tree
over its integer vectors; the inner product of a query with anything in a ball
is at most query . centre + |query| * radius. For a block of queries the tree
is descended level by level, balls whose bound is below a query's current k-th
score are dropped, and the leaves that remain are searched in the order of
their bounds, each raising the k-th score for the rest.

Two rounds: a query is first searched in one shard, its own; the k-th score it
finds there is shared with all other shards, where it prunes from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from likeness.llm.vectors import EVERY, both, shards_of, usable
from likeness.runtime import cut, ship

LEAF = 64


class BallTree:
    """Halved along the direction of the two far points until a leaf is small; nodes by level."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x = x
        self.order = np.arange(len(x))
        self.levels: list[list[tuple[int, int]]] = [[(0, len(x))]]
        while True:
            nxt, split = [], False
            for a, b in self.levels[-1]:
                if b - a <= leaf:
                    nxt.append((a, b))
                    continue
                split = True
                own = x[self.order[a:b]]
                mid = own.mean(0)
                p = own[((own - mid) ** 2).sum(1).argmax()]
                q = own[((own - p) ** 2).sum(1).argmax()]
                k = np.argsort(own @ (q - p), kind="stable")
                self.order[a:b] = self.order[a:b][k]
                m = (a + b) // 2
                nxt += [(a, m), (m, b)]
            if not split:
                break
            self.levels.append(nxt)
        self.centre, self.radius, self.children = [], [], []
        for d, level in enumerate(self.levels):
            c = np.stack([x[self.order[a:b]].mean(0) for a, b in level])
            # the slack covers rounding in the bound
            r = np.array([np.sqrt(((x[self.order[a:b]] - ci) ** 2).sum(1).max()) for (a, b), ci in zip(level, c)])
            self.centre.append(c)
            self.radius.append(r)
            if d + 1 < len(self.levels):
                below = {a: i for i, (a, _) in enumerate(self.levels[d + 1])}
                kids = []
                for a, b in level:
                    i = below[a]
                    kids.append((i, i + 1) if self.levels[d + 1][i][1] < b else (i, -1))
                self.children.append(np.array(kids))

    def search(self, q: np.ndarray, k: int, least: np.ndarray, ids: np.ndarray, own_ids: np.ndarray, dot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best of each query among rows of another id, by score and then smaller id.

        ``least``: scores below it are of no use to a query. ``dot(a, b)``: exact inner products.
        """
        n = len(q)
        size = np.sqrt((q.astype(float) ** 2).sum(1))
        who, node = np.arange(n), np.zeros(n, np.int64)
        for d in range(len(self.levels)):
            reach = size[who] * self.radius[d][node]
            bound = (q[who].astype(float) * self.centre[d][node]).sum(1) + reach
            # the slack covers rounding: it follows the size of the terms, not of their sum
            bound += 1e-6 + 1e-12 * (size[who] * np.sqrt((self.centre[d] ** 2).sum(1))[node] + reach)
            keep = bound >= least[who]
            who, node, bound = who[keep], node[keep], bound[keep]
            if d + 1 < len(self.levels):
                kids = self.children[d][node]
                two = kids[:, 1] >= 0
                who, node = np.append(who, who[two]), np.append(kids[:, 0], kids[two, 1])
        order = np.lexsort((-bound, who))
        who, node, bound = who[order], node[order], bound[order]
        first = np.searchsorted(who, np.arange(n))
        turn = np.arange(len(who)) - first[who]
        exact = dot(q[:1], self.x[:1]).dtype  # doubles hold every sum, or Python's integers
        best_s = np.full((n, k), -np.inf).astype(exact)
        best_i = np.full((n, k), -1, np.int64)
        kth = least.astype(exact)
        for t in range(int(turn.max()) + 1 if len(turn) else 0):
            at = np.flatnonzero(turn == t)
            at = at[(bound[at] >= kth[who[at]]).astype(bool)]
            by = np.argsort(node[at], kind="stable")
            at = at[by]
            cuts = np.flatnonzero(np.diff(node[at])) + 1
            for part in np.split(at, cuts) if len(at) else []:
                a, b = self.levels[-1][node[part[0]]]
                rows = self.order[a:b]
                w = who[part]
                s = dot(q[w], self.x[rows])
                s = np.where((ids[rows][None, :] == own_ids[w][:, None]), np.array(-np.inf).astype(exact), s)
                all_s = np.hstack([best_s[w], s])
                all_i = np.hstack([best_i[w], np.broadcast_to(rows, s.shape)])
                key = np.where(all_i >= 0, ids[np.maximum(all_i, 0)], np.iinfo(np.int64).max)
                pick = _top(all_s, key, k)
                best_s[w] = np.take_along_axis(all_s, pick, 1)
                best_i[w] = np.take_along_axis(all_i, pick, 1)
                kth[w] = np.maximum(kth[w], best_s[w, k - 1])
        hit = (best_i >= 0) & (best_s > -np.inf).astype(bool) & (best_s >= least[:, None]).astype(bool)
        i, j = np.nonzero(hit)
        return i, best_i[i, j], best_s[i, j]


def _top(s: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best in each row: by score, then smaller key."""
    by_key = np.argsort(key, axis=1, kind="stable")
    by_score = np.argsort(-np.take_along_axis(s, by_key, 1), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(by_key, by_score, 1)


def exact_dot(a: np.ndarray, b: np.ndarray, largest: float | None = None) -> np.ndarray:
    """Integer inner products, exact: doubles where no sum can reach 2^53 (by ``largest``, a bound of it, else by the values), else Python's integers."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if largest is None:
        largest = np.abs(a).max() * np.abs(b).max() * a.shape[1] if a.size and b.size else 0.0
    if largest < 2**53:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return whole(a) @ whole(b).T


def as_longs(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; what a long cannot hold becomes the nearest that it can."""
    if scores.dtype != object:
        return scores.astype(np.int64)
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in scores], np.int64)


def search(rows: DataFrame, k: int = 5, scale: int = 256, shard_rows: int = 4096, block: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query's integers floor(scale * x) with those of other ids.

    Queries are the rows whose id EVERY divides; ties go to the smaller id.
    Rows with a null id, a null or empty vector, or null or non-finite
    components take no part; components that a shorter vector lacks count as 0.
    Of rows that repeat an id each counts, but never for its own id. An empty
    table gives no rows; other columns are not read. Inner products are exact; a
    component or a score beyond a long is cut to a long's range, and such scores tie.
    """
    spark = rows.sparkSession
    ship(spark)
    own = usable(rows, id_col, vec_col, nonzero=False).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    n = own.count()
    shards = shards_of(n, shard_rows)
    blocks = shards_of(n, block * EVERY)
    deal = lambda seed, m: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    own = own.select("vec_id", "v", deal(11, shards).alias("shard"))
    queries = own.where(F.col("vec_id") % EVERY == 0).withColumn("block", deal(12, blocks))
    blocked = own.withColumn("block", F.explode(F.array(*[F.lit(i) for i in range(blocks)]))) if blocks > 1 else own.withColumn("block", F.lit(0))

    def best(key, left, right):
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        x, q = both(left.column("v"), right.column("q"))
        ids, own_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        least = np.nextafter(right.column("least").to_numpy(), -np.inf)  # a long, rounded to a double, may have grown
        largest = float(np.abs(x).max() * np.abs(q).max() * x.shape[1])  # one kind of number for the whole block
        i, j, s = BallTree(x).search(q, k, least, ids, own_ids, lambda a, b: exact_dot(a, b, largest))
        return pa.table([pa.array(own_ids[i]), pa.array(ids[j]), pa.array(as_longs(s), pa.int64())], names=names)

    def round_(against: DataFrame) -> DataFrame:
        against = against.select(F.col("block").alias("at_block"), F.col("shard").alias("at_shard"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "least")
        return blocked.groupBy("block", "shard").cogroup(against.groupBy("at_block", "at_shard")).applyInArrow(best, "query_id long, vec_id long, score long")

    first = cut(round_(queries.withColumn("least", F.lit(float("-inf")))))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    others = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").select("vec_id", "v", "block", F.col("shard").alias("home"), F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf"))).alias("least"))
    others = others.withColumn("shard", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(shards - 1)), F.col("home")))).drop("home")
    found = first.unionByName(round_(others)) if shards > 1 else first
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
