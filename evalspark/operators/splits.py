"""Hold-out splits and folds: deterministic (hash order, never ``rand``), exact sizes, one job for all datasets.

Row-level splits shuffle only (dataset, hash, row id): the cut of every dataset is found first and rows are then
compared with it. Group-level splits fold over *distinct group sizes*: groups of one size are interchangeable for the
greedy rule, and a dataset of n rows has at most sqrt(2 n) distinct sizes, however many groups it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.taxonomy import predefined_side
from evalspark.operators.ordering import ROWS_PER_BUCKET, checked_join, key_join, nth_smallest, quantiles, row_numbers


def sha1_score(key: Column | str) -> Column:
    """Integer of the first 12 hex digits of sha1, the order used by the reproducible hash split."""
    return F.conv(F.substring(F.sha1(F.col(key) if isinstance(key, str) else key), 1, 12), 16, 10).cast("long")


def seeded_order(key: str, seed: int) -> Column:
    return sha1_score(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def _mark_below(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: Column, rows_per_bucket: int) -> DataFrame:
    """``_below``: true for the first ``n`` rows of the group in ``order``."""
    cuts = nth_smallest(df, keys, order, n, rows_per_bucket).drop("n_rows")
    j = checked_join(df, cuts, keys, "left")
    return j.withColumn("_below", F.coalesce(F.struct(*order) <= F.col("cut"), F.lit(False))).drop("cut")


def random_holdout(df: DataFrame, keys: Sequence[str], row_id: str, fraction: float, seed: int = 42,
                   rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Test side = first ceil(fraction * n) rows in seeded hash order."""
    work = df.withColumn("_h", seeded_order(row_id, seed))
    m = _mark_below(work, keys, ["_h", row_id], F.ceil(F.col("n_rows") * fraction), rows_per_bucket)
    return m.withColumn("split", F.when(F.col("_below"), "test").otherwise("train")).drop("_h", "_below")


def quartile_bins(df: DataFrame, keys: Sequence[str], target: str, name: str = "bin",
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Quartile bin of the target, right-closed with the lowest included; equal edges merge into one bin."""
    edges = quantiles(df.select(*keys, target), keys, target, [0.25, 0.5, 0.75], ["_e1", "_e2", "_e3"], rows_per_bucket)
    ends = df.groupBy(*keys).agg(F.min(target).alias("_e0"), F.max(target).alias("_e4"))
    j = checked_join(df, key_join(edges.drop("n_rows"), ends, keys), keys)
    inner = F.array_distinct(F.array("_e0", "_e1", "_e2", "_e3", "_e4"))
    above = F.size(F.filter(F.slice(inner, 2, 3), lambda e: (e < F.col(target)) & (e < F.col("_e4"))))
    return j.withColumn(name, above).drop("_e0", "_e1", "_e2", "_e3", "_e4")


def stratified_holdout(df: DataFrame, keys: Sequence[str], row_id: str, target: str, fraction: float, seed: int = 42,
                       rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Quartile-stratified hold-out; datasets with fewer than two bins or a bin below two rows fall back to random.

    ``split_strategy`` says which rule was used.
    """
    binned = quartile_bins(df, keys, target, "_bin", rows_per_bucket)
    sizes = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    ok = sizes.groupBy(*keys).agg((F.count(F.lit(1)).alias("k") >= 2).alias("_two"), (F.min("_n") >= 2).alias("_full"))
    j = checked_join(binned, ok, keys).withColumn("_use", F.col("_two") & F.col("_full"))
    j = j.withColumn("_bin", F.when(F.col("_use"), F.col("_bin")).otherwise(0)).drop("_two", "_full")
    out = random_holdout(j, [*keys, "_bin"], row_id, fraction, seed, rows_per_bucket)
    return (out.withColumn("split_strategy", F.when(F.col("_use"), "target_quartiles").otherwise("random"))
            .withColumnRenamed("_bin", "bin").drop("_use"))


def hash_split(df: DataFrame, keys: Sequence[str], key: str, row_id: str, fraction: float,
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Reproducible split by sha1 of the key: the highest scores are test.

    Fraction clamped to [0.05, 0.5]; test size = half-even rounded share, at least 1 and at most n - 1; a single row
    stays in train.
    """
    f = min(max(float(fraction), 0.05), 0.5)
    n = F.col("n_rows")
    size = F.least(F.greatest(F.bround(n * F.lit(f)), F.lit(1)), n - 1)
    work = df.withColumn("_neg", -sha1_score(key))
    m = _mark_below(work, keys, ["_neg", row_id], size, rows_per_bucket)
    return m.withColumn("split", F.when(F.col("_below"), "test").otherwise("train")).drop("_neg", "_below")


def predefined_split(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Rows of the given train/test labels; datasets lacking either side are left out and named ``missing_side``."""
    marked = df.withColumn("split", predefined_side(column))
    sides = marked.groupBy(*keys).agg((F.count_if(F.col("split") == "train") > 0).alias("_tr"),
                                      (F.count_if(F.col("split") == "test") > 0).alias("_te"))
    j = checked_join(marked, sides, keys).where(F.col("split").isNotNull())
    return j.withColumn("usable", F.col("_tr") & F.col("_te")).drop("_tr", "_te")


# --- group-aware -----------------------------------------------------------------------------------------------

def group_sizes(df: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    return df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("size"))


def _size_runs(sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per dataset the array of (size, number of groups of that size), largest size first."""
    runs = sizes.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("m"))
    neg = F.struct((-F.col("size")).alias("neg"), F.col("m").alias("m"))
    return runs.groupBy(*keys).agg(F.array_sort(F.collect_list(neg)).alias("runs"),
                                   F.sum(F.col("size") * F.col("m")).alias("n_rows"), F.sum("m").alias("n_groups"))


def group_holdout(df: DataFrame, keys: Sequence[str], group: str, fraction: float,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Whole groups to the test side, largest first, while that brings the test size closer to its target.

    Within a run of m groups of size s and a current test size c below the goal g, the rule takes
    floor((2g - 2c - s) / 2s) + 1 more groups (one at least while the test side is empty), so the fold needs one step
    per distinct size. Groups of equal size are taken in key order.
    """
    sizes = group_sizes(df, keys, group)
    runs = _size_runs(sizes, keys)
    n = F.col("n_rows")
    goal = F.least(F.greatest(F.bround(n * F.lit(float(fraction))), F.lit(1)), n - 1).cast("long")

    def step(acc, run):
        s, c, g = -run["neg"], acc["c"], acc["g"]
        more = F.floor((2 * g - 2 * c - s) / (2 * s)) + 1
        more = F.when((c == 0) & (g > 0), F.greatest(more, F.lit(1))).otherwise(more)
        take = F.greatest(F.least(more, run["m"]), F.lit(0)).cast("long")
        picks = F.concat(acc["picks"], F.array(F.struct(s.cast("long").alias("size"), take.alias("take"))))
        return F.struct((c + take * s).cast("long").alias("c"), g.alias("g"), picks.alias("picks"))

    start = F.struct(F.lit(0).cast("long").alias("c"), goal.alias("g"),
                     F.array().cast("array<struct<size:bigint,take:bigint>>").alias("picks"))
    folded = runs.withColumn("f", F.aggregate("runs", start, step))
    picks = folded.select(*keys, "n_groups", F.explode("f.picks").alias("p")).select(
        *keys, "n_groups", F.col("p.size").alias("size"), F.col("p.take").alias("take"))
    ordered = row_numbers(sizes, [*keys, "size"], [group], "_i", rows_per_bucket)
    sided = key_join(ordered, picks, [*keys, "size"]).withColumn(
        "split", F.when((F.col("_i") < F.col("take")) & (F.col("n_groups") > 1), "test").otherwise("train"))
    return key_join(df, sided.select(*keys, group, "split"), [*keys, group])


def _loads_before_runs(folds: int):
    """Fold loads before every size run, by the lightest-fold rule, for one dataset's (size, count) table."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False)
        k = int(min(folds, pdf["m"].sum()))
        loads, rows = np.zeros(k, dtype=np.int64), []
        for size, m in zip(pdf["size"].to_numpy(), pdf["m"].to_numpy()):
            rows.append(loads.tolist())
            loads = loads + size * _counts_after(loads, int(size), int(m))
        return pdf.assign(loads=rows)
    return run


def _counts_after(loads: np.ndarray, size: int, m: int) -> np.ndarray:
    """Groups each fold receives when m groups of one size go one by one to the lightest fold (ties: lowest number)."""
    if m <= 0:
        return np.zeros_like(loads)
    v = _level(loads[None, :], size, np.array([m - 1]))[0]
    below = np.where(loads < v, (v - 1 - loads) // size + 1, 0)
    left = m - int(below.sum())
    at = np.flatnonzero((loads <= v) & ((v - loads) % size == 0))[:left]
    below[at] += 1
    return below


def _level(loads: np.ndarray, size, rank: np.ndarray) -> np.ndarray:
    """Load level at which the ``rank``-th (0-based) assignment of each row happens: bisection over levels."""
    lo = loads.min(axis=1)
    hi = lo + (rank + 1) * size
    size = np.broadcast_to(np.asarray(size), lo.shape)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        count = np.where(loads <= mid[:, None], (mid[:, None] - loads) // size[:, None] + 1, 0).sum(axis=1)
        enough = count > rank
        hi = np.where(open_ & enough, mid, hi)
        lo = np.where(open_ & ~enough, mid + 1, lo)


def _fold_of(loads: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    v = _level(loads, size, rank)
    before = np.where(loads < v[:, None], (v[:, None] - 1 - loads) // size[:, None] + 1, 0).sum(axis=1)
    hits = (loads <= v[:, None]) & ((v[:, None] - loads) % size[:, None] == 0)
    nth = np.cumsum(hits, axis=1) == (rank - before + 1)[:, None]
    return np.argmax(nth & hits, axis=1)


def _assign_folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = np.zeros(len(pdf), dtype=np.int64)
        widths = pdf["loads"].map(len).to_numpy()
        for k in np.unique(widths):
            rows = np.flatnonzero(widths == k)
            part = pdf.iloc[rows]
            out[rows] = _fold_of(np.vstack(part["loads"].to_numpy()).astype(np.int64), part["size"].to_numpy(),
                                 part["_i"].to_numpy())
        yield pdf.assign(fold=out).drop(columns=["loads", "_i"])


def group_kfold(df: DataFrame, keys: Sequence[str], group: str, folds: int = 5,
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Group k-fold: groups largest first, each to the lightest fold (ties: lowest fold; equal sizes: key order).

    The sequential part runs over distinct sizes per dataset; the fold of a single group is then a closed form of its
    place within its size run, evaluated in Arrow batches. Datasets with one group keep fold 0 and ``folds`` = 1.
    """
    sizes = group_sizes(df, keys, group)
    runs = sizes.groupBy(*keys, "size").agg(F.count(F.lit(1)).alias("m"))
    schema = T.StructType([*runs.schema.fields, T.StructField("loads", T.ArrayType(T.LongType()))])
    loads = runs.groupBy(*keys).applyInPandas(_loads_before_runs(folds), schema).drop("m")
    ordered = row_numbers(sizes, [*keys, "size"], [group], "_i", rows_per_bucket)
    j = key_join(ordered, loads, [*keys, "size"])
    out = j.select(*keys, group, "size", "_i", "loads", F.size("loads").alias("folds"))
    schema = T.StructType([*out.drop("loads", "_i").schema.fields, T.StructField("fold", T.LongType())])
    assigned = out.mapInPandas(_assign_folds, schema)
    return key_join(df, assigned.drop("size"), [*keys, group])


# --- row folds -------------------------------------------------------------------------------------------------

def random_kfold(df: DataFrame, keys: Sequence[str], row_id: str, folds: int = 5, seed: int = 42,
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Fold = position in seeded hash order modulo the fold count (no more folds than rows)."""
    slim = df.select(*keys, row_id).withColumn("_h", seeded_order(row_id, seed))
    n = slim.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(folds)).alias("folds"))
    pos = key_join(row_numbers(slim, keys, ["_h", row_id], "_i", rows_per_bucket), n, keys)
    fold = pos.select(*keys, row_id, "folds", F.pmod(F.col("_i"), F.col("folds")).alias("fold"))
    return key_join(df, fold, [*keys, row_id])


def stratified_kfold(df: DataFrame, keys: Sequence[str], row_id: str, target: str, folds: int = 5, seed: int = 42,
                     rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Quartile-stratified folds, at most as many as the smallest bin has rows; random folds where that is below two."""
    slim = df.select(*keys, row_id, target)
    binned = quartile_bins(slim, keys, target, "_bin", rows_per_bucket)
    sizes = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    plan = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bins"), F.min("_n").alias("_small"), F.sum("_n").alias("_all"))
    good = (F.col("_bins") >= 2) & (F.least("_small", F.lit(folds)) >= 2)
    plan = plan.select(*keys, good.alias("_use"),
                       F.when(good, F.least("_small", F.lit(folds))).otherwise(F.least("_all", F.lit(folds))).alias("folds"))
    j = key_join(binned, plan, keys).withColumn("_bin", F.when(F.col("_use"), F.col("_bin")).otherwise(0))
    j = j.withColumn("_h", seeded_order(row_id, seed))
    pos = row_numbers(j, [*keys, "_bin"], ["_h", row_id], "_i", rows_per_bucket)
    fold = pos.select(*keys, row_id, F.col("_bin").alias("bin"), "folds", F.pmod(F.col("_i"), F.col("folds")).alias("fold"),
                      F.when(F.col("_use"), "target_quartiles").otherwise("random_fallback_from_target_quartiles")
                      .alias("cv_strategy"))
    return key_join(df, fold, [*keys, row_id])


def inner_folds(df: DataFrame, keys: Sequence[str], strategy: str, row_id: str, target: str | None = None,
                group: str | None = None, folds: int = 5, seed: int = 42) -> DataFrame:
    """Folds by strategy name; group folds without enough groups fall back to random folds."""
    if strategy == "target_quartiles":
        return stratified_kfold(df, keys, row_id, target, folds, seed)
    if strategy == "scaffold" and group:
        grouped = group_kfold(df, keys, group, folds)
        plain = random_kfold(df.select(*keys, row_id), keys, row_id, folds, seed).select(
            *keys, row_id, F.col("fold").alias("_rf"), F.col("folds").alias("_rn"))
        j = key_join(grouped, plain, [*keys, row_id])
        one = F.col("folds") < 2
        return (j.withColumn("cv_strategy", F.when(one, "random").otherwise("scaffold"))
                .withColumn("fold", F.when(one, F.col("_rf")).otherwise(F.col("fold")))
                .withColumn("folds", F.when(one, F.col("_rn")).otherwise(F.col("folds"))).drop("_rf", "_rn"))
    return random_kfold(df, keys, row_id, folds, seed).withColumn("cv_strategy", F.lit("random"))


def subgroup_plan(df: DataFrame, keys: Sequence[str], key: str, max_folds: int, min_rows: int = 30,
                  min_keys: int = 20) -> DataFrame:
    """Which subgroups get a model of their own, and with how many folds."""
    per_key = df.groupBy(*keys, key).agg(F.count(F.lit(1)).alias("n"))
    g = per_key.groupBy(*keys).agg(F.sum("n").alias("train_rows"), F.count(F.lit(1)).alias("unique_keys"))
    folds = F.least(F.lit(max_folds).cast("long"), F.col("unique_keys"), F.col("train_rows"))
    viable = (F.col("train_rows") >= min_rows) & (F.col("unique_keys") >= min_keys) & (folds >= 2)
    return g.select(*keys, "train_rows", "unique_keys", F.when(viable, "trained").otherwise("fallback_global").alias("status"),
                    F.when(viable, folds).otherwise(F.lit(0).cast("long")).alias("oof_folds"))


# --- derived subsets -------------------------------------------------------------------------------------------

def derive_subsets(df: DataFrame, keys: Sequence[str], first: dict[str, str], second: dict[str, str], key: str,
                   target: str, fraction: float, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Every pair of indicator columns (``first`` x ``second``: label -> column) as its own split dataset.

    One grouped job: active indicators become rows, duplicates collapse to their mean target, each subset gets the
    hash split. Empty subsets never appear.
    """
    def active(cols: dict[str, str]) -> Column:
        flags = [F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0, F.lit(label)) for label, c in cols.items()]
        return F.explode(F.array_compact(F.array(*flags)))

    rows = (df.select(*keys, F.trim(F.col(key)).alias(key), F.col(target).alias(target), active(first).alias("subset_a"),
                      *second.values())
            .select(*keys, key, target, "subset_a", active(second).alias("subset_b"))
            .where(F.col(target).isNotNull() & F.col(key).isNotNull() & (F.col(key) != "")))
    by = [*keys, "subset_a", "subset_b"]
    mean = rows.groupBy(*by, key).agg(F.avg(target).alias(target))
    return hash_split(mean, by, key, key, fraction, rows_per_bucket)


def pooled_subset(frames: dict[str, DataFrame], indicators: Sequence[str], key: str, fraction: float) -> DataFrame:
    """Union of tagged sources with missing indicators as 0, distinct rows, hash split over the pool."""
    parts = [df.withColumn("source_sheet", F.lit(name)) for name, df in frames.items()]
    pool = parts[0]
    for p in parts[1:]:
        pool = pool.unionByName(p, allowMissingColumns=True)
    pool = pool.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in indicators}).distinct()
    pool = pool.withColumns({"_all": F.lit(0), "_row": F.sha2(F.to_json(F.struct(*sorted(pool.columns))), 256)})
    return hash_split(pool, ["_all"], key, "_row", fraction).drop("_all", "_row")


def seeded_sample(df: DataFrame, keys: Sequence[str], row_id: str, n: int, seed: int = 42,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """First ``n`` rows per group in seeded hash order (a sampling operator: the row count is its purpose)."""
    work = df.withColumn("_h", seeded_order(row_id, seed))
    size = F.least(F.lit(n), F.col("n_rows"))
    return _mark_below(work, keys, ["_h", row_id], size, rows_per_bucket).where("_below").drop("_h", "_below")
