"""Exact top-k inner products of a query set against all vectors: tiled matrix products, partial selection, tree merge.

Every (query block, candidate shard) tile is one matrix product; the k best of each query leave the tile, and a two-level
tree merges the lists. Integer scores are exact: products run in doubles while every sum stays below 2**53 and in whole
Python numbers beyond.

Defined cases: vectors null or holding null or non-finite components take no part; a query has fewer rows when there are
fewer candidates; shorter vectors count as padded with zeros; repeated rows are candidates each, and a query's own id is
never its candidate; rows sharing a query's id are one query, with the smallest of their vectors; an empty table gives no
rows. A score beyond 64 bits is reported as the largest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import stored
from evalspark.llm.vectors import TILE_ROWS, deal, matrix, merge_top, one_per_id, parts, spread, top_rows, valid

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("tile", pa.int32())])
_LARGEST = (1 << 63) - 1


def _tile(k: int, scale: float):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        a, b = matrix(left), matrix(right, "w")
        width = max(a.shape[1], b.shape[1])
        a, b = (np.floor(scale * np.pad(x, ((0, 0), (0, width - x.shape[1])))) for x in (a, b))
        queries, ids = left.column("vec_id").to_numpy(), right.column("id").to_numpy()
        top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
        if top < 2.0 ** 53:
            q, c, s = top_rows(queries, ids, a @ b.T, k)
            s = s.astype(np.int64)
        else:
            q, c, s = _whole_numbers(queries, ids, a, b, k)
        tile = np.full(len(q), right.column("shard")[0].as_py(), np.int32)
        return pa.table([pa.array(q), pa.array(c), pa.array(s, pa.int64()), pa.array(tile)], schema=_FOUND)
    return fn


def _whole_numbers(queries, ids, a, b, k):
    """The same with unbounded integers, a query at a time."""
    exact = np.vectorize(int, otypes=[object])
    b = exact(b)
    out = []
    for query, row in zip(queries.tolist(), exact(a)):
        scores = (b * row).sum(axis=1).tolist() if len(row) else [0] * len(ids)
        ranked = sorted((-s, i) for s, i in zip(scores, ids.tolist()) if i != query)[:k]
        out += [(query, i, max(-_LARGEST, min(_LARGEST, -s))) for s, i in ranked]
    return tuple(np.array([r[j] for r in out], np.int64) for j in range(3))


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) with score the inner product of floor(scale * x)."""
    rows = stored(valid(vectors).withColumn("is_query", is_query), "search-rows")
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_query").alias("queries")).first()
    shards, blocks = parts(n["rows"], tile_rows), parts(n["queries"], tile_rows)
    queries = spread(deal(one_per_id(rows.filter("is_query")), blocks, "block", 1), shards, "shard")
    candidates = spread(deal(rows.select("vec_id", "v"), shards, "shard", 2), blocks, "block")
    candidates = candidates.select(F.col("vec_id").alias("id"), F.col("v").alias("w"), "shard", "block")
    found = queries.groupBy("shard", "block").cogroup(candidates.groupBy("shard", "block")).applyInArrow(
        _tile(k, scale), "query_id long, vec_id long, score long, tile int")
    return merge_top(found, k)
