"""Exact ranks, quantiles and row numbers when one group may hold a large share of all rows.

A plain ``Window.partitionBy(dataset)`` sorts a whole dataset in one task. Here every group is cut into value
buckets first: splitter values are picked by hash from the group's own values (so the choice depends on the data
only, never on task order or retries), rows go to the bucket between two splitters, and a running total over the
short bucket table gives each bucket its offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import durable

ROWS_PER_BUCKET = 1_000_000
MAX_SPLITTERS = 1_024  # the array rides along with every row of its group up to the bucket lookup
BROADCAST_ROWS = 200_000
_SEARCH_STEPS = [1 << i for i in range(10, -1, -1)]


def key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
             bounded: bool = False) -> DataFrame:
    """Join on equal keys with null equal to null. ``bounded`` marks a right side whose size has a proven limit."""
    names = {k: f"__r{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    if bounded:
        right = F.broadcast(right)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()])
    out = left.join(right, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def checked_join(left: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "inner",
                 limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join wide rows with a per-group summary without moving the rows, if the summary is really small.

    The summary is stored first (it is read again by the join in any case) and counted; up to ``limit`` rows it is
    broadcast, beyond that the join shuffles and AQE splits hot keys.
    """
    stored = durable(summary)
    return key_join(left, stored, keys, how, bounded=stored.count() <= limit)


def _bucketed(d: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_bucket: int,
              source: DataFrame | None = None) -> DataFrame:
    """Add ``_b``: an order-preserving bucket number within each key group.

    A value becomes a splitter when its hash falls on one of ``rows_per_bucket`` residues, so a group of n distinct
    values gets about n / rows_per_bucket of them and most groups below that size get none. The splitter table
    therefore holds about (rows / rows_per_bucket) values in all, however the rows are spread over groups, and at most
    ``MAX_SPLITTERS`` per group; it grows with the data, so AQE decides on its broadcast by measured bytes.
    ``source`` may be a cheaper frame holding the same (keys, order) tuples as ``d``.
    """
    here = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    # Keys are hashed along, so that one value shared by many groups does not become a splitter in all of them.
    picked = (source if source is not None else d).where(F.pmod(F.xxhash64(*keys, *order), F.lit(rows_per_bucket)) == 0)
    splits = picked.groupBy(*keys).agg(F.array_sort(F.collect_set(here)).alias("_splits"))
    step = F.ceil(F.size("_splits") / MAX_SPLITTERS)  # thinning only widens buckets; it never changes a result
    splits = splits.withColumn("_splits", F.when(step > 1, F.filter("_splits", lambda x, i: i % step == 0))
                               .otherwise(F.col("_splits")))
    out = key_join(d, splits, keys, "left")
    found = F.aggregate(
        F.array(*[F.lit(s) for s in _SEARCH_STEPS]), F.lit(0),
        lambda acc, step: F.when(F.get(F.col("_splits"), acc + step - 1) <= here, acc + step).otherwise(acc))
    return out.withColumn("_b", F.when(F.col("_splits").isNull(), F.lit(0)).otherwise(found)).drop("_splits")


def prefix_sums(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column],
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per (keys, value): each sum, ``<name>_before`` over smaller values, ``<name>_total`` over the group.

    Equal values are merged map-side, so a value shared by many rows costs one row here.
    """
    d = df.groupBy(*keys, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    b = _bucketed(d, keys, [value], rows_per_bucket, df.select(*keys, value))
    by_bucket = Window.partitionBy(*keys).orderBy("_b")
    earlier, whole = by_bucket.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    offsets = (b.groupBy(*keys, "_b").agg(*[F.sum(n).alias(n) for n in sums])
               .select(*keys, "_b",
                       *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
                       *[F.sum(n).over(whole).alias(f"{n}_total") for n in sums]))
    within = (Window.partitionBy(*keys, "_b").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    joined = key_join(b, offsets, [*keys, "_b"])
    return joined.select(
        *keys, value, *sums,
        *[(F.coalesce(F.sum(n).over(within), F.lit(0)) + F.col(f"_o_{n}")).alias(f"{n}_before") for n in sums],
        *[f"{n}_total" for n in sums])


def ranks(df: DataFrame, keys: Sequence[str], value: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per (keys, value): ``n`` copies, lowest rank ``rank_min``, tie-averaged ``rank_avg``, group size."""
    p = prefix_sums(df.where(F.col(value).isNotNull()), keys, value, {"_c": F.lit(1)}, rows_per_bucket)
    return p.select(*keys, value, F.col("_c").alias("n"), (F.col("_c_before") + 1).alias("rank_min"),
                    (F.col("_c_before") + (F.col("_c") + 1) / 2).alias("rank_avg"), F.col("_c_total").alias("n_rows"))


def descending(rank: Column | str, n_rows: Column | str) -> Column:
    """Tie-averaged rank counted from the top."""
    r, n = (F.col(x) if isinstance(x, str) else x for x in (rank, n_rows))
    return n + 1 - r


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              names: Sequence[str] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Exact linear-interpolated quantiles per group, without holding any group in one task."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    p = prefix_sums(df.where(F.col(value).isNotNull()), keys, value, {"_c": F.lit(1)}, rows_per_bucket)
    start, end = F.col("_c_before"), F.col("_c_before") + F.col("_c")
    aggs = []
    for i, q in enumerate(probs):
        at = F.lit(float(q)) * (F.col("_c_total") - 1)
        for tag, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((start <= idx) & (idx < end), F.col(value))).alias(f"_{tag}{i}"))
    g = p.groupBy(*keys).agg(F.max("_c_total").alias("n_rows"), *aggs)
    out = []
    for i, (q, name) in enumerate(zip(probs, names)):
        at = F.lit(float(q)) * (F.col("n_rows") - 1)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return g.select(*keys, "n_rows", *out)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos",
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Zero-based position of every row within its group. ``order`` must be unique within the group."""
    b = _bucketed(df, keys, order, rows_per_bucket)
    by_bucket = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
               .select(*keys, "_b", F.coalesce(F.sum("_c").over(by_bucket), F.lit(0)).alias("_o")))
    within = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (key_join(b, offsets, [*keys, "_b"])
            .withColumn(name, F.row_number().over(within) - 1 + F.col("_o")).drop("_b", "_o"))


def nth_smallest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: Column,
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per group the ``n``-th smallest ``order`` tuple as struct ``cut`` (``n`` may use ``n_rows``).

    Only keys and order columns are shuffled; callers compare full rows with the one cut per group.
    """
    slim = df.select(*keys, *order)
    numbered = row_numbers(slim, keys, order, "_pos", rows_per_bucket)
    sizes = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("_want", n)
    hit = key_join(numbered, sizes, keys).where(F.col("_pos") == F.col("_want") - 1)
    return hit.select(*keys, "n_rows", F.struct(*order).alias("cut"))


def neighbours_known(df: DataFrame, keys: Sequence[str], order: str, column: str,
                     rows_per_block: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``_pos`` and the nearest known value before and after each row with their positions."""
    work = row_numbers(df, keys, [order], "_pos", rows_per_block)
    work = work.withColumn("_blk", F.floor(F.col("_pos") / rows_per_block))
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(column).alias("v")))
    ends = work.groupBy(*keys, "_blk").agg(F.max(known).alias("_last"), F.min(known).alias("_first"))
    before = lambda *order: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_blk", F.last("_last", True).over(before("_blk")).alias("_cp"),
                       F.last("_first", True).over(before(F.desc("_blk"))).alias("_cn"))
    # A frame that only grows: one from the current row to the end is scanned anew for every row.
    sofar = lambda *order: Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = (key_join(work, ends, [*keys, "_blk"])
           .withColumn("_lk", F.coalesce(F.last(known, True).over(sofar("_pos")),
                                         F.col("_cp")))
           .withColumn("_nk", F.coalesce(F.last(known, True).over(sofar(F.desc("_pos"))),
                                         F.col("_cn"))))
    return (out.withColumns({"_prev": F.col("_lk.v"), "_prev_pos": F.col("_lk.p"), "_next": F.col("_nk.v"),
                             "_next_pos": F.col("_nk.p")}).drop("_lk", "_nk", "_cp", "_cn", "_blk"))


# --- best and first rows through mergeable aggregates ----------------------------------------------------------

def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Whole first row per group in ``order`` (ascending; nulls sort first in structs, so map them beforehand).

    ``min_by`` merges map-side: a hot group sends one candidate row per task instead of all its rows.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def first_known(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                columns: Sequence[str] | None = None) -> DataFrame:
    """Per group and column the first non-null value in ``order``: the result may mix several source rows."""
    rest = list(columns or [c for c in df.columns if c not in keys])
    rank = F.struct(*order)
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in rest]
    return df.groupBy(*keys).agg(*aggs)


def dedupe(df: DataFrame, keys: Sequence[str], seq: Sequence[str], keep: str = "first") -> DataFrame:
    """Keep the first or last copy per key in the order of ``seq``."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    row = pick(F.struct(*rest), F.struct(*seq)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; Spark trims each task to ``k`` rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= k)


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Running maximum along ``order`` (unique within the group), carried over buckets."""
    b = _bucketed(df, keys, order, rows_per_bucket)
    by_bucket = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = b.groupBy(*keys, "_b").agg(F.max(value).alias("_m")).select(*keys, "_b", F.max("_m").over(by_bucket).alias("_carry"))
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    j = key_join(b, carry, [*keys, "_b"])
    return j.withColumn("running_max", F.greatest(F.max(value).over(within), F.col("_carry"))).drop("_b", "_carry")


def chained(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
            rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``pos`` (from 0), ``n_rows``, ``first_value`` of the group and ``next_value`` of the following row.

    ``order`` must be unique within the group. The first row of each bucket is carried to the end of the one before, so
    one group's sequence may span tasks.
    """
    b = _bucketed(df, keys, order, rows_per_bucket)
    whole, by_bucket = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_b")
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    heads = b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"), F.min_by(F.struct(value), F.struct(*order)).alias("_h"))
    heads = heads.select(*keys, "_b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"), F.sum("_c").over(whole).alias("n_rows"),
                         F.first(f"_h.{value}").over(by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                         .alias("first_value"), F.lead(f"_h.{value}").over(by_bucket).alias("_next"))
    within = Window.partitionBy(*keys, "_b").orderBy(*order)
    is_last = F.lead(F.lit(1)).over(within).isNull()
    return (key_join(b, heads, [*keys, "_b"])
            .withColumns({"pos": F.row_number().over(within) - 1 + F.col("_o"),
                          "next_value": F.when(is_last, F.col("_next")).otherwise(F.lead(value).over(within))})
            .drop("_b", "_o", "_next"))
