"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard of the vectors.

Vectors are dealt to shards of bounded size. A shard's graph starts at random; then, twice over, each vector is searched for greedily, and
of what the search meets, relaxed distance pruning keeps edges that lead in different directions, and ties them back. A beam search over every shard's graph
answers a query; the shards' answers are merged.

Inner products become distances by one more coordinate that gives all vectors of a shard the same length. Equal vectors of a
shard are one node, with all their ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainweave.llm.common import stored

#: Shards that vectors are dealt to, as long as a shard has FEWEST vectors or more; beyond MOST vectors or NUMBERS components a shard, which bound the memory of
#: a task, there are more shards.
SHARDS, FEWEST, MOST, NUMBERS = 8, 4096, 1 << 16, 1 << 22
#: Queries that one task searches a shard for, on average.
QUERY_BLOCK = 1 << 15
#: Edges of a node, beam of the searches that build and of those that answer (of FEWEST nodes; it grows with the root of their number), nodes expanded at a time.
DEGREE, BUILD_BEAM, BEAM, WIDE = 24, 48, 128, 4
#: Relaxation of the two passes: an edge goes if another one leads this many times nearer to its end.
RELAX = (1.0, 1.2)
BATCH = 256


def beam_search(vectors: np.ndarray, edges: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances), nearest first, of the nodes that a beam search from `starts` ends with for each query; -1 and infinity where there are fewer.

    vectors all have the same length, so 1 minus the inner product orders them as their distance does. edges: -1 for none.
    """
    n = len(queries)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    k = min(beam, starts.shape[-1])
    first = np.broadcast_to(starts, (n, starts.shape[-1]))[:, :k]
    ids[:, :k] = first
    dist[:, :k] = -np.einsum("nd,nkd->nk", queries, vectors[first])
    done[:, :k] = False
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist, done = (np.take_along_axis(x, order, 1) for x in (ids, dist, done))
    live = np.arange(n)
    while len(live):
        i, d, e = ids[live], dist[live], done[live]
        rank = np.cumsum(~e, axis=1)
        pick = ~e & (rank <= WIDE)
        e |= pick
        near = np.full((len(live), WIDE, edges.shape[1]), -1, np.int64)
        r, c = np.nonzero(pick)
        near[r, rank[r, c] - 1] = edges[i[r, c]]
        near = np.sort(near.reshape(len(live), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        known = (near[:, :, None] == i[:, None, :]).any(axis=2) | (near < 0)
        new = np.where(known, np.float32(np.inf), -np.einsum("nd,nkd->nk", queries[live], vectors[np.maximum(near, 0)]))
        all_d = np.concatenate([d, new], axis=1)
        all_i = np.concatenate([i, np.where(known, -1, near)], axis=1)
        all_e = np.concatenate([e, known], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live], done[live] = (np.take_along_axis(x, order, 1) for x in (all_i, all_d, all_e))
        live = live[~done[live].all(axis=1)]
    return ids, dist


def prune(vectors: np.ndarray, own: np.ndarray, near: np.ndarray, relax: float) -> np.ndarray:
    """(nodes, DEGREE) edges for nodes `own` out of candidates `near` (-1: none).

    The nearest candidate becomes an edge; candidates that are `relax` times nearer to it than to the node go; then the nearest of the rest, and so on.
    """
    near = np.where(near == own[:, None], -1, near)
    ordered = np.sort(near, axis=1)
    again = np.zeros_like(ordered, bool)
    again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    near = np.where(again, -1, ordered)
    v = vectors[np.maximum(near, 0)]
    length = float(vectors[0] @ vectors[0])
    d = np.where(near < 0, np.float32(np.inf), 2 * (length - np.einsum("nd,nkd->nk", vectors[own], v)))
    order = np.argsort(d, axis=1, kind="stable")
    near, d, v = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    between = 2 * (length - v @ v.transpose(0, 2, 1))
    open_, out = near >= 0, np.full((len(own), DEGREE), -1, np.int64)
    rows = np.arange(len(own))
    for k in range(DEGREE):
        if not open_.any():
            break
        at = open_.argmax(axis=1)
        has = open_[rows, at]
        out[has, k] = near[rows[has], at[has]]
        open_ &= relax * relax * between[rows, at] > d
        open_[rows, at] = False
    return out


def build_graph(vectors: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(edges, starts) of nodes with these vectors of equal length."""
    rnd = np.random.default_rng(seed)
    n = len(vectors)
    edges = np.full((n, DEGREE), -1, np.int64)
    if n > 1:
        k = min(DEGREE // 2, n - 1)
        edges[:, :k] = (np.arange(n)[:, None] + rnd.integers(1, n, (n, k))) % n
    middle = int(np.argmax(vectors @ vectors.mean(axis=0)))
    starts = np.unique(np.concatenate([[middle], rnd.integers(0, n, 3)]))
    for relax in RELAX:
        order = rnd.permutation(n)
        for lo in range(0, n, BATCH):
            own = order[lo : lo + BATCH]
            met, _ = beam_search(vectors, edges, vectors[own], starts, BUILD_BEAM)
            edges[own] = prune(vectors, own, np.concatenate([met, edges[own]], axis=1), relax)
            _tie_back(vectors, edges, own, relax)
    return edges, starts


def _tie_back(vectors: np.ndarray, edges: np.ndarray, own: np.ndarray, relax: float) -> None:
    """Gives the ends of the edges of `own` edges back, pruned where they are too many."""
    ends = edges[own]
    source = np.repeat(own, edges.shape[1])[ends.ravel() >= 0]
    target = ends.ravel()[ends.ravel() >= 0]
    have = (edges[target] == source[:, None]).any(axis=1)
    source, target = source[~have], target[~have]
    if not len(target):
        return
    gain = np.einsum("nd,nd->n", vectors[source], vectors[target])
    order = np.lexsort((-gain, target))
    source, target = source[order], target[order]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(begin, count)
    wide = int(min(2 * DEGREE, count.max()))
    new = np.full((len(nodes), wide), -1, np.int64)
    fits = place < wide
    new[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = source[fits]
    both = np.concatenate([edges[nodes], new], axis=1)
    full = (both >= 0).sum(axis=1) > DEGREE
    room = np.sort(both[~full], axis=1)[:, ::-1]
    edges[nodes[~full]] = room[:, :DEGREE]
    for lo in range(0, int(full.sum()), BATCH):
        part = np.flatnonzero(full)[lo : lo + BATCH]
        edges[nodes[part]] = prune(vectors, nodes[part], both[part], relax)


def _leveled(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a coordinate that gives them the length of the longest. They are scaled first, so that no square is infinite or lost."""
    vectors = vectors / np.abs(vectors).max()
    square = np.einsum("nd,nd->n", vectors, vectors)
    more = np.sqrt(np.maximum(0, square.max() - square))
    out = np.concatenate([vectors, more[:, None]], axis=1)
    return (out / np.sqrt(square.max())).astype(np.float32)


_INDEX = "dim int, shard bigint, node int, start boolean, ids array<bigint>, vector array<double>, edges array<int>"


def _build(rows: pa.Table) -> pa.Table:
    dim, shard = rows.column("dim")[0].as_py(), rows.column("shard")[0].as_py()
    flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    vectors, ids = flat.reshape(-1, dim) + 0.0, rows.column("vec_id").to_numpy().astype(np.int64)
    distinct, node = np.unique(vectors, axis=0, return_inverse=True)
    node = node.ravel()
    edges, starts = build_graph(_leveled(distinct))
    order = np.lexsort((ids, node))
    begin = np.searchsorted(node[order], np.arange(len(distinct) + 1))
    n = len(distinct)
    return pa.table(
        {
            "dim": pa.array([dim] * n, pa.int32()),
            "shard": pa.array([shard] * n, pa.int64()),
            "node": pa.array(np.arange(n), pa.int32()),
            "start": pa.array(np.isin(np.arange(n), starts)),
            "ids": pa.array([np.unique(ids[order[begin[i] : begin[i + 1]]]) for i in range(n)], pa.list_(pa.int64())),
            "vector": pa.array(list(distinct), pa.list_(pa.float64())),
            "edges": pa.array([e[e >= 0] for e in edges], pa.list_(pa.int32())),
        }
    )


_FOUND = "query_id bigint, vec_id bigint, score double"


def _answer(top: int, beam: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if index.num_rows and queries.num_rows:
            index = index.sort_by("node")
            vectors = np.asarray(index.column("vector").combine_chunks().flatten()).reshape(index.num_rows, -1)
            ids = index.column("ids").to_pylist()
            edges = np.full((len(vectors), DEGREE), -1, np.int64)
            for i, e in enumerate(index.column("edges").to_pylist()):
                edges[i, : len(e)] = e
            wide = math.ceil(beam * max(1.0, math.sqrt(len(vectors) / FEWEST)))
            starts = np.flatnonzero(index.column("start").to_numpy(zero_copy_only=False))
            asked = np.asarray(queries.column("vector").combine_chunks().flatten()).reshape(queries.num_rows, -1)
            names = queries.column("query_id").to_numpy()
            level = _leveled(vectors)
            even = asked / np.abs(asked).max(axis=1, keepdims=True)
            length = np.sqrt(np.einsum("nd,nd->n", even, even))[:, None]
            longer = np.concatenate([even / length, np.zeros((len(asked), 1))], axis=1).astype(np.float32)
            for lo in range(0, len(asked), BATCH):
                met, _ = beam_search(level, edges, longer[lo : lo + BATCH], starts, max(wide, top + 1))
                for q, nodes in enumerate(met, lo):
                    nodes = nodes[nodes >= 0]
                    # Summed row by row, so that equal vectors have equal scores in all shards.
                    score = (vectors[nodes] * asked[q]).sum(axis=1)
                    found = [(-s, v) for s, node in zip(score.tolist(), nodes.tolist(), strict=True) for v in ids[node][: top + 1] if v != names[q]]
                    found.sort()
                    for s, v in found[:top]:
                        out_q.append(names[q])
                        out_v.append(v)
                        out_s.append(-s)
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    v = vectors.select(vectors[f"`{key}`"].cast("bigint").alias("vec_id"), vectors[f"`{vector}`"].cast("array<double>").alias("vector"))
    return v.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))


def shard_size(vectors: int, numbers: int) -> int:
    """Vectors of a shard: grows with their number, so that the shards that every query visits don't, up to what a task holds. numbers: components of the longest vector."""
    return max(1, min(max(FEWEST, -(-vectors // SHARDS)), MOST, max(FEWEST // 4, NUMBERS // max(1, numbers))))


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", shard: int | None = None) -> DataFrame:
    """An index of all usable vectors: a row for each distinct vector of a shard, with its ids and edges. Vectors of different numbers of components have graphs of their own.

    shard: vectors of a shard on average, see shard_size. Null ids, and vectors that are null, zero or have null or non-finite components, are left out; equal vectors of
    a shard are one node, repeated rows count once, and an empty table gives an empty index. Only key and vector are read.
    """
    v = clean(vectors, key, vector)
    n, numbers = v.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    shards = max(1, math.ceil(n / (shard or shard_size(n, numbers))))
    v = v.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), "vec_id", "vector")
    # Partitions of a given number aren't joined to larger ones, so that shards are built side by side.
    return stored(v.repartition(4 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build, _INDEX), "ann-index")


def search(index: DataFrame, queries: DataFrame, top: int = 20, beam: int = BEAM, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found of each usable query, nearest first, ties to the smaller id; rows of the query's own id aside.

    Score is the inner product in double precision. Null ids, null and zero vectors, and vectors with null or non-finite components take no part on
    either side; queries meet vectors of their own number of components. Repeated queries are answered once, repeated rows of an id and vector count once. No rows
    on either side give an empty result; with fewer candidates than `top`, all of them are returned. Only key and vector are read.
    """
    asked = clean(queries, key, vector).withColumnRenamed("vec_id", "query_id").dropDuplicates(["query_id", "vector"])
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    shards = index.select(F.col("dim").alias("dim"), F.col("shard").alias("shard")).distinct()
    asked = asked.withColumn("dim", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    asked = asked.join(shards, "dim")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by = ["dim", "shard", "block"]
    parts = 4 * blocks * max(1, shards.count())
    found = held.repartition(parts, *by).groupBy(*by).cogroup(asked.repartition(parts, *by).groupBy(*by)).applyInArrow(_answer(top, beam), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def recall(index: DataFrame, vectors: DataFrame, found: DataFrame, top: int = 20, sample: int = 200) -> float:
    """Share of the exact nearest that `found` has, over at most `sample` queries of it, by brute force over all vectors."""
    some = found.select("query_id").distinct().orderBy(F.xxhash64("query_id")).limit(sample)
    v = clean(vectors, "vec_id", "embedding")
    asked = v.join(F.broadcast(some), v["vec_id"] == some["query_id"]).select("query_id", F.col("vector").alias("q"))
    if found.isEmpty():
        return 1.0
    ids, matrix = (np.asarray(x) for x in zip(*[(r["query_id"], r["q"]) for r in asked.collect()], strict=True))

    def best(batches):
        for b in batches:
            vec, own = np.asarray(b.column("vector").flatten()).reshape(b.num_rows, -1), b.column("vec_id").to_numpy()
            s = matrix @ vec.T
            for k, q in enumerate(ids):
                s_k = np.where(own == q, -np.inf, s[k])
                at = np.argsort(-s_k, kind="stable")[: top + 1]
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(at), pa.int64()), pa.array(own[at]), pa.array(s_k[at])], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    exact = v.mapInArrow(best, _FOUND).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    hit = exact.join(found, ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, exact.count())
