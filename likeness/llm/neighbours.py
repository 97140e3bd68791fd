"""Operator 4: approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are indexed once, with the smallest ids that have them, so a
crowd of copies cannot fill every list. The distinct vectors are dealt into
shards of bounded size. In each, a graph of near neighbours is grown from
random lists: a Spark join of every node's neighbours, in either direction,
with those neighbours' own lists brings its neighbours' neighbours, of which
the nearest are kept; a few rounds of it bring the lists near to the true ones.

A query starts from spread entry nodes of each shard and moves, greedily, to
the unvisited neighbours of the best nodes it has met, until the best of its
beam are all expanded. The scores returned are computed anew on the original
vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from likeness.llm.vectors import EVERY, both, cosine, matrix, shards_of, usable
from likeness.runtime import cut, ship


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in single precision; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def random_lists(n: int, k: int, seed: int) -> np.ndarray:
    """k other nodes for each of n nodes (n > k)."""
    rng = np.random.default_rng(seed)
    steps = np.sort(rng.permuted(np.broadcast_to(np.arange(1, n), (n, n - 1)), axis=1)[:, :k]) if n <= 4 * k else rng.integers(1, n, (n, k))
    return (np.arange(n)[:, None] + steps) % n


def nearest(x: np.ndarray, node: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest distinct others of each node, among (node, other) pairs: (node, other), nodes in order, nearest first."""
    n = len(x)
    key = np.unique(node.astype(np.int64) * n + other)
    node, other = key // n, key % n
    own = node != other
    node, other = node[own], other[own]
    sim = np.empty(len(node), np.float32)
    for lo in range(0, len(node), 1 << 16):
        sim[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", x[node[lo : lo + (1 << 16)]], x[other[lo : lo + (1 << 16)]])
    order = np.lexsort((-sim, node))
    node, other = node[order], other[order]
    rank = np.arange(len(node)) - np.searchsorted(node, node)
    keep = rank < k
    return node[keep], other[keep]


def adjacency(node: np.ndarray, other: np.ndarray, n: int, degree: int) -> np.ndarray:
    """Lists of both directions, padded with -1; of a node that many have in theirs, the first ``degree`` by their rank in those."""
    rank = np.arange(len(node)) - np.searchsorted(node, node)
    a, b, r = np.append(node, other), np.append(other, node), np.append(rank, rank)
    order = np.lexsort((r, a))
    a, b = a[order], b[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
    a, b = a[first], b[first]
    turn = np.arange(len(a)) - np.searchsorted(a, a)
    ok = turn < degree
    out = np.full((n, degree), -1, np.int64)
    out[a[ok], turn[ok]] = b[ok]
    return out


def greedy(x: np.ndarray, adj: np.ndarray, q: np.ndarray, beam: int, entries: int = 32, width: int = 4) -> np.ndarray:
    """The ``beam`` nearest nodes met for each query, nearest first (-1: fewer). ``width`` nodes are expanded at a time."""
    n, m = len(x), len(q)
    start = np.unique(np.linspace(0, n - 1, min(entries, n)).astype(np.int64))
    beam_i = np.full((m, beam), -1, np.int64)
    beam_s = np.full((m, beam), -np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n), bool)
    seen[:, start] = True
    s = q @ x[start].T
    take = min(beam, len(start))
    best = np.argsort(-s, 1, kind="stable")[:, :take]
    beam_i[:, :take], beam_s[:, :take], done[:, :take] = start[best], np.take_along_axis(s, best, 1), False
    live = np.arange(m)
    while len(live):
        turn = np.argsort(done[live], 1, kind="stable")[:, :width]  # the first ones not expanded
        open_ = ~np.take_along_axis(done[live], turn, 1)
        has = open_.any(1)
        live, turn, open_ = live[has], turn[has], open_[has]
        if not len(live):
            break
        nodes = np.where(open_, np.take_along_axis(beam_i[live], turn, 1), -1)
        np.put_along_axis(d := done[live], turn, True, 1)
        done[live] = d
        near = np.where(nodes[:, :, None] >= 0, adj[nodes], -1).reshape(len(live), -1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = (near >= 0) & ~seen[live[:, None], near]
        r, c = np.nonzero(fresh)
        cand = near[r, c]
        seen[live[r], cand] = True
        sim = np.full(near.shape, -np.inf, np.float32)
        for lo in range(0, len(r), 1 << 16):
            p = slice(lo, lo + (1 << 16))
            sim[r[p], c[p]] = np.einsum("ij,ij->i", q[live[r[p]]], x[cand[p]])
        all_s = np.hstack([beam_s[live], sim])
        all_i = np.hstack([beam_i[live], np.where(fresh, near, -1)])
        all_d = np.hstack([done[live], ~fresh])
        pick = np.argsort(-all_s, 1, kind="stable")[:, :beam]
        beam_s[live], beam_i[live], done[live] = (np.take_along_axis(a, pick, 1) for a in (all_s, all_i, all_d))
        done[live] |= beam_i[live] < 0
    return beam_i


def build(nodes: DataFrame, k: int, rounds: int) -> DataFrame:
    """The graph (shard, node, near) of nodes (shard, vec_id, v): each node's k nearest others of its shard, as found."""

    def start(key, t):
        ids = np.sort(t.column("vec_id").to_numpy())
        n = len(ids)
        near = [ids[r].tolist() for r in (random_lists(n, k, 17) if n > k + 1 else [np.delete(np.arange(n), i) for i in range(n)])]
        return pa.table({"shard": pa.array(np.full(n, key[0].as_py()), pa.int32()), "node": pa.array(ids), "near": pa.array(near, pa.list_(pa.int64()))})

    def step(key, left, right):
        ids = left.column("vec_id").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], unit(matrix(left.column("v"))[order])
        lists = right.column("near")
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
        lens = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
        node = np.repeat(np.searchsorted(ids, right.column("node").to_numpy()), lens)
        other = np.searchsorted(ids, lists.flatten().to_numpy())
        a, b = nearest(x, node, other, k)
        counts = np.bincount(a, minlength=len(ids))
        near = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids[b]))
        return pa.table({"shard": pa.array(np.full(len(ids), key[0].as_py()), pa.int32()), "node": pa.array(ids), "near": near})

    schema = "shard int, node long, near array<long>"
    graph = cut(nodes.groupBy("shard").applyInArrow(start, schema))
    for _ in range(rounds):
        edge = graph.select("shard", "node", F.explode("near").alias("other"))
        either = edge.unionByName(edge.select("shard", F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
        lists = graph.select("shard", F.col("node").alias("other"), "near")
        beyond = either.join(lists, ["shard", "other"]).select("shard", "node", "near")
        ways = beyond.unionByName(graph).unionByName(either.groupBy("shard", "node").agg(F.collect_list("other").alias("near")))
        graph = cut(nodes.groupBy("shard").cogroup(ways.groupBy("shard")).applyInArrow(step, schema))
    return graph


def search(rows: DataFrame, k: int = 5, shard_rows: int = 8192, list_size: int = 20, rounds: int = 3, beam: int = 256, block: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query by cosine, ties to the smaller id.

    Queries are the rows whose id EVERY divides. Rows with a null id, a null,
    empty or all-zero vector, or null or non-finite components take no part;
    components that a shorter vector lacks count as 0. Of rows that repeat an id each counts, but never for its own id.
    An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    ship(spark)
    own = usable(rows, id_col, vec_col, nonzero=True)
    w = Window.partitionBy("v").orderBy("vec_id")
    few = cut(own.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= k + 1).withColumn("rep", F.min("vec_id").over(Window.partitionBy("v"))))
    reps = few.where(F.col("turn") == 1)
    n = reps.count()
    shards, blocks = shards_of(n, shard_rows), shards_of(n, block * EVERY)
    nodes = reps.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(21)), F.lit(shards)).cast("int").alias("shard"))
    graph = build(nodes, list_size, rounds)
    queries = own.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id", F.lit(22)), F.lit(blocks)).cast("int").alias("at_block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("at_shard"))
    indexed = nodes.join(graph, (nodes["shard"] == graph["shard"]) & (nodes["vec_id"] == graph["node"])).select(nodes["shard"], "vec_id", "v", "near")
    indexed = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def find(key, left, right):
        names = ["query_id", "rep", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        left = left.sort_by("vec_id")
        x, q = both(left.column("v"), right.column("q"))
        ids, own_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        lists = pa.concat_arrays(left.column("near").chunks)
        node = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        adj = adjacency(node, np.searchsorted(ids, lists.flatten().to_numpy()), len(ids), 2 * list_size)
        met = greedy(unit(x), adj, unit(q), max(beam, 2 * (k + 1)))[:, : 2 * (k + 1)]
        i, j = np.nonzero(met >= 0)
        return pa.table([pa.array(own_ids[i]), pa.array(ids[met[i, j]]), pa.array(cosine(q[i], x[met[i, j]]))], names=names)

    found = indexed.groupBy("block", "shard").cogroup(queries.groupBy("at_block", "at_shard")).applyInArrow(find, "query_id long, rep long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    found = found.dropDuplicates(["query_id", "rep"]).withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= 2 * (k + 1)).drop("turn")
    out = found.join(few.select("rep", "vec_id"), "rep").where(F.col("vec_id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
