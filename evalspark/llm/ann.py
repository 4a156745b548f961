"""Approximate nearest neighbours (largest inner product) on robust-pruned directed graphs, one per shard.

Each shard of about ``SHARD_ROWS`` vectors gets a graph: nodes enter in growing batches, a greedy beam search from the
central node proposes neighbours, and relaxed distance pruning keeps diverse edges (a candidate goes when a kept one is
``RELAX`` times closer to it than the node is); reverse edges are pruned the same way, the nearest 64 where a batch offers a
node more. Inner products become distances by one extra component that gives all vectors one length. Equal vectors of a shard are one node with its smallest ids. Query blocks meet every shard's
graph; a beam search finds candidates, exact scores on the original vectors rank them, and a tree merges the lists.

Defined cases: vectors null, zero or holding null or non-finite components take no part; shards with few vectors are
searched fully; a query's own id is never its candidate; rows sharing a query's id are one query, with the smallest of their
vectors; shorter vectors count as padded with zeros; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored
from evalspark.llm.vectors import deal, matrix, merge_top, one_per_id, parts, spread, valid

SHARD_ROWS = 4096
QUERY_ROWS = 1024
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
RELAX = 1.2


def beam_search(points: np.ndarray, graph: np.ndarray, start: int, targets: np.ndarray, beam: int) -> np.ndarray:
    """Ids of the ``beam`` nearest nodes met by greedy search from ``start``, for many targets at once; -1 fills up.

    ``graph`` holds neighbour ids, -1 where a list is shorter. Every step opens the nearest unopened node of each beam.
    """
    q = len(targets)
    norms = (points * points).sum(axis=1)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, points.dtype)
    opened = np.zeros((q, beam), bool)
    seen = np.zeros((q, len(points)), bool)
    ids[:, 0] = start
    dist[:, 0] = norms[start] - 2 * targets @ points[start]
    seen[:, start] = True
    live = np.arange(q)
    while len(live):
        waiting = np.where(opened[live] | (ids[live] < 0), np.inf, dist[live])
        at = waiting.argmin(axis=1)
        go = waiting[np.arange(len(live)), at] < np.inf
        live, at = live[go], at[go]
        if not len(live):
            break
        opened[live, at] = True
        near = graph[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        row, col = np.nonzero(fresh)
        node = near[row, col]
        seen[live[row], node] = True
        new = np.full(near.shape, np.inf, points.dtype)
        new[row, col] = norms[node] - 2 * np.einsum("ij,ij->i", targets[live[row]], points[node])
        all_dist = np.concatenate([dist[live], new], axis=1)
        all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
        all_open = np.concatenate([opened[live], np.zeros(near.shape, bool)], axis=1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        dist[live], ids[live], opened[live] = (np.take_along_axis(x, order, 1) for x in (all_dist, all_ids, all_open))
    return ids


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Diverse neighbours of many nodes at once from their candidates (-1 where none)."""
    own = candidates == nodes[:, None]
    ok = (candidates >= 0) & ~own
    at = np.where(ok, candidates, 0)
    d = ((points[at] - points[nodes][:, None, :]) ** 2).sum(axis=2)
    d[~ok] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    at, d = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)
    repeat = np.zeros(at.shape, bool)  # a candidate may be proposed twice; its copies have one distance and lie together
    repeat[:, 1:] = (at[:, 1:] == at[:, :-1]) & np.isfinite(d[:, 1:])
    d[repeat] = np.inf
    x = points[at]
    square = (x * x).sum(axis=2)
    between = square[:, :, None] + square[:, None, :] - 2 * x @ x.transpose(0, 2, 1)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        best = d.argmin(axis=1)
        some = np.isfinite(d[rows, best])
        if not some.any():
            break
        out[some, k] = at[rows[some], best[some]]
        near = between[rows, best]
        d[some[:, None] & (relax * relax * near <= d)] = np.inf
        d[rows, best] = np.inf
    return out


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 5) -> tuple[np.ndarray, int]:
    """Neighbour table and the central node where searches start."""
    n = len(points)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done = 1
    while done < n:
        batch = order[done: done + max(1, min(done, 512))]
        found = beam_search(points, graph, start, points[batch], beam)
        # Nodes of one batch don't see each other in the search: the nearest of them are proposed as well.
        inside = points[batch] @ points[batch].T * -2 + (points[batch] ** 2).sum(axis=1)[None, :]
        np.fill_diagonal(inside, np.inf)
        few = min(8, len(batch) - 1)
        peers = batch[np.argpartition(inside, few, axis=1)[:, :few]] if few > 0 else np.zeros((len(batch), 0), np.int64)
        graph[batch] = robust_prune(points, batch, np.concatenate([found, peers], axis=1), degree, relax)
        done += len(batch)
        row, col = np.nonzero(graph[batch] >= 0)
        to, back = graph[batch][row, col], batch[row]
        sort = np.argsort(to, kind="stable")
        to, back = to[sort], back[sort]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 1024):
            some = slice(lo, lo + 1024)
            wide = int(count[some].max())
            extra = np.full((len(nodes[some]), wide), -1, np.int64)
            r = np.repeat(np.arange(len(nodes[some])), count[some])
            c = np.arange(len(r)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            extra[r, c] = back[np.repeat(first[some], count[some]) + c]
            if wide > 64:  # far more than any list keeps: the nearest stay
                gap = np.where(extra >= 0, ((points[np.maximum(extra, 0)] - points[nodes[some]][:, None, :]) ** 2).sum(axis=2), np.inf)
                extra = np.take_along_axis(extra, np.argsort(gap, axis=1, kind="stable")[:, :64], 1)
            merged = np.concatenate([graph[nodes[some]], extra], axis=1)
            graph[nodes[some]] = robust_prune(points, nodes[some], merged, degree, relax)
    return graph, start


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, longest ** 2 - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1).astype(np.float32)


def _index(longest: float, k: int):
    def fn(group: pa.Table) -> pa.Table:
        ids, x = group.column("vec_id").to_numpy(), matrix(group)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        points, member = np.unique(x, axis=0, return_inverse=True)
        member = member.ravel()
        sort = np.argsort(member, kind="stable")  # members of each point by id
        place = np.arange(len(sort)) - np.searchsorted(member[sort], member[sort])
        sort = sort[place <= k]  # a further equal vector has k smaller ids before it in any list
        offsets = np.searchsorted(member[sort], np.arange(len(points) + 1))
        scaled = points / longest
        graph, start = build_graph(_lifted(scaled, 1.0)) if len(points) > 1 else (np.full((1, 1), -1, np.int64), 0)
        return pa.table({"shard": group.column("shard").slice(0, 1).cast(pa.int32()), "width": pa.array([points.shape[1]], pa.int32()), "start": pa.array([start], pa.int32()),
                         "points": pa.array([points.tobytes()], pa.binary()), "graph": pa.array([graph.astype(np.int32).tobytes()], pa.binary()),
                         "ids": pa.array([ids[sort].astype(np.int64).tobytes()], pa.binary()), "offsets": pa.array([offsets.astype(np.int64).tobytes()], pa.binary())})
    return fn


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("tile", pa.int32())])


def _search(longest: float, k: int, beam: int):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        width = right.column("width")[0].as_py()
        points = np.frombuffer(right.column("points")[0].as_py(), np.float64).reshape(-1, width)
        graph = np.frombuffer(right.column("graph")[0].as_py(), np.int32).reshape(len(points), -1).astype(np.int64)
        ids, offsets = (np.frombuffer(right.column(c)[0].as_py(), np.int64) for c in ("ids", "offsets"))
        start, shard = right.column("start")[0].as_py(), right.column("shard")[0].as_py()
        queries, x = left.column("vec_id").to_numpy(), matrix(left, width=width)
        lifted, out = _lifted(points / longest, 1.0), []
        length = np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
        for lo in range(0, len(queries), 256):
            some = slice(lo, lo + 256)
            target = np.concatenate([x[some] / length[some], np.zeros((len(x[some]), 1))], axis=1).astype(np.float32)
            if len(points) <= beam:
                near = np.tile(np.arange(len(points)), (len(target), 1))
            else:
                near = beam_search(lifted, graph, start, target, beam)
            score = np.where(near >= 0, np.einsum("ij,ikj->ik", x[some], points[np.maximum(near, 0)]), -np.inf)
            for query, row, s in zip(queries[some].tolist(), near, score):
                order = np.argsort(-s, kind="stable")
                order = order[s[order] > -np.inf]
                hit, value = row[order], s[order]
                count = offsets[hit + 1] - offsets[hit]
                at = np.repeat(offsets[hit], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                found, value = ids[at], np.repeat(value, count)
                other = found != query
                found, value = found[other], value[other]
                best = np.lexsort((found, -value))[:k]
                out.append((np.full(len(best), query), found[best], value[best]))
        q, c, s = (np.concatenate(p) for p in zip(*out))
        return pa.table([pa.array(q), pa.array(c), pa.array(s), pa.array(np.full(len(q), shard, np.int32))], schema=_FOUND)
    return fn


def search(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) with score the inner product of the original vectors in double precision."""
    rows = valid(vectors).filter(F.exists("v", lambda x: x != 0)).withColumn("is_query", is_query)
    rows = stored(rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), "ann-rows")
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_query").alias("queries"), F.max("norm").alias("longest")).first()
    shards, blocks, longest = parts(n["rows"], shard_rows), parts(n["queries"], query_rows), n["longest"] or 1.0
    graphs = deal(rows.select("vec_id", "v"), shards, "shard", 3).groupBy("shard").applyInArrow(
        _index(longest, k), "shard int, width int, start int, points binary, graph binary, ids binary, offsets binary")
    graphs = stored(graphs, "ann-graphs")
    queries = spread(deal(one_per_id(rows.filter("is_query")), blocks, "block", 4), shards, "shard")
    found = queries.groupBy("shard", "block").cogroup(spread(graphs, blocks, "block").groupBy("shard", "block")).applyInArrow(
        _search(longest, k, beam), "query_id long, vec_id long, score double, tile int")
    return merge_top(found, k)
