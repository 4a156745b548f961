"""Tiles of vectors for searching a stated query set against all rows.

A tile is one block of queries against one shard of candidates. Both sides are dealt to (shard, block) pairs: the work
is what the search asks for, the rows shipped are queries x shards + candidates x blocks. Shards and blocks have
``TILE_ROWS`` rows on average whatever the table's size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_ROWS = 4096


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows whose vector is not null and has no null or non-finite component."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~odd))


def one_per_id(queries: DataFrame) -> DataFrame:
    """(vec_id, v): rows that share an id are one query, with the smallest of their vectors."""
    return queries.groupBy("vec_id").agg(F.min("v").alias("v"))


def parts(n: int, rows: int = TILE_ROWS) -> int:
    return max(1, math.ceil(n / rows))


def deal(df: DataFrame, n: int, name: str, salt: int) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int"))


def spread(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def matrix(table: pa.Table, name: str = "v", width: int | None = None) -> np.ndarray:
    """Rows of a list column of doubles; missing trailing components are 0."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    lengths = np.diff(np.asarray(column.offsets))
    width = width if width is not None else int(lengths.max(initial=0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    columns = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows[columns < width], columns[columns < width]] = flat[columns < width]
    return out


def top_rows(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among scores[query, candidate] without itself; ties to the smaller id.

    Partial selection finds the k-th score; everything equal to it stays for the tie rule.
    """
    scores[queries[:, None] == ids[None, :]] = -np.inf
    order = min(k, scores.shape[1])
    if order == 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    least = np.partition(scores, scores.shape[1] - order, axis=1)[:, scores.shape[1] - order]
    q, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    s = scores[q, c]
    sort = np.lexsort((ids[c], -s, q))
    q, c, s = q[sort], c[sort], s[sort]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    q, c, s = q[rank < k], c[rank < k], s[rank < k]
    return queries[q], ids[c], s


def merge_top(found: DataFrame, k: int, fan: int = 16) -> DataFrame:
    """Tree merge: lists of ``fan`` tiles at a time, then the rest; (query_id, tile, vec_id, score) to ranked rows."""
    def best(lists: DataFrame, *key: str) -> DataFrame:
        ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
        return lists.groupBy(*key).agg(ranked.alias("top"))

    first = best(found.withColumn("branch", F.floor(F.col("tile") / fan)), "query_id", "branch")
    merged = best(first.select("query_id", F.inline("top")).withColumn("score", -F.col("minus")), "query_id")
    return (merged.select("query_id", F.posexplode("top").alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score")))
