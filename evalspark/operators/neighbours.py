"""Exact nearest neighbours between two tables of vectors.

Vectors are assigned to the nearest of a few pivots. From the per-cell radii and the k smallest pivot distances an
upper bound on the k-th neighbour distance follows for every query cell, and by the triangle inequality a training
row can matter to a cell only when its pivot distance lies in a known interval; only those rows are sent there. Cells
are cut into query chunks and candidate blocks, so one crowded cell is spread over many tasks; each task emits the k
best per query, never its pairs. Where the intervals let most rows through, all rows are cut into one such grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.operators.ordering import top_rows
from evalspark.session import durable

QUERY_CHUNK = 16_384
CANDIDATE_BLOCK = 16_384
UNPARTED = 0.5  # share of all pairs from which on cells only repeat rows
_BATCH_CELLS = 4_000_000
_GROUP = 64
_SINGLE_LIMIT = 1e30


def _matrix(col: pd.Series) -> np.ndarray:
    return np.asarray(col.to_list(), dtype=np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by plain differences (no cancellation), in batches of bounded size."""
    out = np.empty((len(a), len(b)))
    step = max(1, _BATCH_CELLS // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _open_double(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b) of the pairs that products in double precision cannot rule out as one of the k nearest."""
    sa, sb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    near = sa[:, None] + sb - 2 * (a @ b.T)
    if not np.isfinite(near).all():
        return tuple(x.ravel() for x in np.indices(near.shape))
    error = 4 * (b.shape[1] + 8) * np.finfo(float).eps * (sa + sb.max())
    last = np.partition(near, k - 1, axis=1)[:, k - 1]
    return np.nonzero(near <= (last + 2 * error)[:, None])


def _open_single(a: np.ndarray, sides: np.ndarray, sb: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by single precision. ``sides`` holds the rows of b and their squared lengths as columns, padded to whole groups.

    The k-th smallest of the groups' minima is at least the k-th smallest value, so only groups below it are looked into.
    """
    groups = sides.shape[1] // _GROUP
    near = np.column_stack([-2 * a, np.ones(len(a))]).astype(np.float32) @ sides
    near = near.reshape(len(a), _GROUP, groups)
    least = near.min(axis=1)
    single = np.finfo(np.float32)
    error = (len(sides) + 8) * (float(single.eps) * (np.einsum("ij,ij->i", a, a) + sb) + 4 * float(single.tiny))
    limit = np.partition(least, k - 1, axis=1)[:, k - 1] + 2 * error
    r, g = np.nonzero(least <= limit[:, None])
    hit, place = np.nonzero(near[r, :, g] <= limit[r][:, None])
    r, c = r[hit], place * groups + g[hit]
    return r[c < n], c[c < n]


def _nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of b for every row of a; ties go to the earlier row.

    Products give squared distances up to a known error, first in single precision and, where that leaves too many pairs,
    in double; only pairs that this error leaves open are measured by plain differences. Works in tiles of bounded size.
    """
    k, width = min(k, len(b)), b.shape[1]
    sa, sb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    step, pairs = max(1, _BATCH_CELLS // len(b)), max(1, _BATCH_CELLS // max(1, width))
    sides = None
    if len(b) >= _GROUP * k and sa.max(initial=0) + sb.max() < _SINGLE_LIMIT:  # false if a value is not finite
        sides = np.zeros((width + 1, -(-len(b) // _GROUP) * _GROUP), dtype=np.float32)
        sides[:-1, :len(b)], sides[-1, :len(b)], sides[-1, len(b):] = b.T, sb, np.inf
    found = []
    for i in range(0, len(a), step):
        tile = a[i:i + step]
        r, c = _open_single(tile, sides, float(sb.max()), len(b), k) if sides is not None else ((), ())
        if sides is None or len(r) > len(tile) * (4 * k + 32):
            r, c = _open_double(tile, b, k)
        dist = np.empty(len(r))
        for j in range(0, len(r), pairs):
            diff = a[i + r[j:j + pairs]] - b[c[j:j + pairs]]
            dist[j:j + pairs] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        order = np.lexsort((c, dist, r))
        r, c, dist = r[order], c[order], dist[order]
        kept = np.arange(len(r)) - np.searchsorted(r, r) < k
        found.append((i + r[kept], c[kept], dist[kept]))
    return tuple(np.concatenate(x) for x in zip(*found))


def choose_pivots(train: DataFrame, row_id: str, features: str, n: int) -> np.ndarray:
    """A fixed number of vectors, picked by hash of (id, vector).

    Each task offers its n smallest, so nothing is shuffled and n vectors reach the driver; copies among them merge.
    """
    rows = train.select(features, row_id).orderBy(F.xxhash64(row_id, features), row_id).limit(n).collect()
    return np.unique(np.asarray([r[0] for r in rows], dtype=np.float64), axis=0)


def assign_cells(df: DataFrame, features: str, pivots: np.ndarray) -> DataFrame:
    """Add ``cell`` and ``pivot_distance``."""
    schema = T.StructType(list(df.schema.fields) + [T.StructField("cell", T.IntegerType()),
                                                    T.StructField("pivot_distance", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                dist = _distances(_matrix(pdf[features]), pivots)
                cell = dist.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), pivot_distance=dist[np.arange(len(pdf)), cell])
    return df.mapInPandas(run, schema)


def _bounds(pivots: np.ndarray, radius: dict[int, float], nearest: dict[int, list[float]], k: int):
    """(query cell, training cell, lowest, highest pivot distance that can hold a neighbour)."""
    gap = _distances(pivots, pivots)
    slack = 1e-9
    rows = []
    for i, u in radius.items():
        upper = np.sort(np.concatenate([u + gap[i, j] + np.asarray(ds) for j, ds in nearest.items()]))
        theta = upper[min(k, len(upper)) - 1]
        for j in nearest:
            lo, hi = gap[i, j] - u - theta, gap[i, j] + u + theta
            rows.append((int(i), int(j), float(lo * (1 - slack) - slack), float(hi * (1 + slack) + slack)))
    return rows


def nearest_neighbours(queries: DataFrame, train: DataFrame, query_id: str, train_id: str, features: str, k: int,
                       n_pivots: int = 32, chunk: int = QUERY_CHUNK, block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id, neighbour_id, distance, neighbour_rank`` with the k nearest training rows of every query.

    Ties go to the smaller training id. The driver sees n_pivots vectors, n_pivots * k distances and the cell sizes.
    """
    spark = queries.sparkSession
    q0 = queries.select(F.col(query_id).alias("qid"), F.col(features).cast("array<double>").alias("v"))
    t0 = train.select(F.col(train_id).alias("tid"), F.col(features).cast("array<double>").alias("v"))
    pivots = choose_pivots(t0, "tid", "v", n_pivots)
    # Stored once: both sides are read by the bounds, the counts and the final join.
    q, t = durable(assign_cells(q0, "v", pivots)), durable(assign_cells(t0, "v", pivots))
    near = top_rows(t.select("cell", "tid", "pivot_distance"), ["cell"], [F.col("pivot_distance"), F.col("tid")], k)
    nearest: dict[int, list[float]] = {}
    for row in near.select("cell", "pivot_distance").collect():
        nearest.setdefault(row[0], []).append(row[1])
    cells = {r[0]: (r[1], r[2]) for r in q.groupBy("cell").agg(F.max("pivot_distance"), F.count(F.lit(1))).collect()}
    rows = _bounds(pivots, {c: v[0] for c, v in cells.items()}, nearest, k)
    bounds = F.broadcast(spark.createDataFrame(rows, "qcell int, cell int, lo double, hi double"))  # n_pivots^2 rows
    sent = t.join(bounds, "cell").where(F.col("pivot_distance").between(F.col("lo"), F.col("hi"))).select("qcell", "tid", "v")
    counts = {r[0]: r[1] for r in sent.groupBy("qcell").count().collect()}
    n_q, n_t = sum(n for _, n in cells.values()), t.count()
    if sum(n * counts.get(c, 0) for c, (_, n) in cells.items()) > UNPARTED * n_q * n_t:
        # The pivots part little: one cell of all rows, so that a row travels once a block and not once a cell.
        q, sent = q.withColumn("cell", F.lit(0)), t.select(F.lit(0).alias("qcell"), "tid", "v")
        cells, counts = {0: (None, n_q)}, {0: n_t}
    plan = [(c, -(-n // chunk), -(-counts.get(c, 0) // block)) for c, (_, n) in cells.items()]
    grid = F.broadcast(spark.createDataFrame(plan, "qcell int, chunks long, blocks long"))  # n_pivots rows
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.select(F.col("cell").alias("qcell"), "qid", "v").join(grid, "qcell").select(
        "qcell", part("qid", "chunks").alias("chunk"), spread("blocks").alias("block"), "qid", "v")
    right = sent.join(grid, "qcell").select("qcell", spread("chunks").alias("chunk"), part("tid", "blocks").alias("block"),
                                            "tid", "v")
    types = {f.name: f.dataType for f in (*q.schema.fields, *t.schema.fields)}
    schema = T.StructType([T.StructField("qid", types["qid"]), T.StructField("tid", types["tid"]),
                           T.StructField("distance", T.DoubleType())])

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"qid": a["qid"].iloc[:0], "tid": b["tid"].iloc[:0], "distance": pd.Series(dtype=float)})
        b = b.sort_values("tid", kind="stable")
        mine, other, dist = _nearest(_matrix(a["v"]), _matrix(b["v"]), k)
        return pd.DataFrame({"qid": a["qid"].to_numpy()[mine], "tid": b["tid"].to_numpy()[other], "distance": dist})

    by = ["qcell", "chunk", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, schema)
    top = top_rows(found, ["qid"], [F.col("distance"), F.col("tid")], k)
    return top.select(F.col("qid").alias(query_id), F.col("tid").alias("neighbour_id"), "distance",
                      F.col("rank_in_group").alias("neighbour_rank"))


def knn_predict(queries: DataFrame, train: DataFrame, query_id: str, train_id: str, features: str, target: str,
                k: int = 15) -> DataFrame:
    """Distance-weighted mean of the neighbours' targets; exact matches, if any, decide alone."""
    nn = nearest_neighbours(queries, train, query_id, train_id, features, k)
    y = train.select(F.col(train_id).alias("neighbour_id"), F.col(target).cast("double").alias("_y"))
    j = nn.join(y, "neighbour_id")
    zero = F.col("distance") == 0
    g = j.groupBy(query_id).agg(F.avg(F.when(zero, F.col("_y"))).alias("_exact"),
                                F.try_divide(F.sum(F.when(~zero, F.col("_y") / F.col("distance"))),
                                             F.sum(F.when(~zero, 1 / F.col("distance")))).alias("_weighted"))
    return g.select(query_id, F.coalesce("_exact", "_weighted").alias("predicted"))


def adaptive_k(smallest_fit_rows: int, limit: int = 15) -> int:
    return max(1, min(limit, smallest_fit_rows))


def vector_width(df: DataFrame, features: str) -> int:
    return int(df.select(F.max(F.size(features))).first()[0])


