"""Paired statistics over result tables: diversity, Friedman, Wilcoxon with Holm, correlations, scaling fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.operators import metrics as M
from evalspark.operators.joins import model_pairs
from evalspark.operators.ordering import ROWS_PER_BUCKET, key_join
from evalspark.operators.reports import median


# --- prediction diversity --------------------------------------------------------------------------------------

def pair_spearman(pred: DataFrame, dataset: str, row: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Spearman of every model pair on the rows both predicted (ranks are taken per pair)."""
    mean = pred.groupBy(dataset, *row, "model").agg(F.avg("predicted").alias("predicted"))
    p = model_pairs(mean, [dataset], row)
    return M.spearman(p, [dataset, "model_a", "model_b"], "value_a", "value_b", rows_per_bucket).where("spearman IS NOT NULL")


def diversity_summary(pairs: DataFrame, dataset: str) -> DataFrame:
    a = F.abs("spearman")
    return pairs.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("pair_count"), F.avg(a).alias("mean_abs_spearman"), median(a).alias("median_abs_spearman"),
        F.max(a).alias("max_abs_spearman"), (1 - median(a)).alias("diversity_index"))


def pair_summary(pairs: DataFrame, dataset: str) -> DataFrame:
    a = F.abs("spearman")
    return pairs.groupBy(F.concat_ws(" / ", "model_a", "model_b").alias("pair")).agg(
        F.count_distinct(dataset).alias("datasets"), F.avg(a).alias("mean_abs_spearman"), F.max(a).alias("max_abs_spearman"))


# --- tail probabilities ----------------------------------------------------------------------------------------

def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-squared distribution: power series below, continued fraction above."""
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def signed_rank_sf(w: float, n: int) -> float:
    """P(W+ >= w) under the exact null distribution for n untied, non-zero differences."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for k in range(1, n + 1):
        counts[k:] = counts[k:] + counts[:-k]
    return float(counts[math.ceil(w - 1e-9):].sum() / counts.sum())


# --- Friedman ----------------------------------------------------------------------------------------------------

def complete_scores(df: DataFrame, block: str, model: str, score: str, min_blocks: int = 5, share: float = 0.5) -> DataFrame:
    """Mean score per (block, model) for models present in enough blocks, on blocks holding all of those models."""
    s = df.groupBy(block, model).agg(F.avg(score).alias("score"))
    n = s.select(block).distinct().agg(F.greatest(F.lit(min_blocks), F.ceil(F.count(F.lit(1)) * share)).alias("_need"))
    per = s.groupBy(model).agg(F.count(F.lit(1)).alias("_have")).crossJoin(n).where(F.col("_have") >= F.col("_need"))  # one-row side
    kept = s.join(per.select(model), model, "left_semi")
    k = per.agg(F.count(F.lit(1)).alias("_k"))
    full = kept.groupBy(block).agg(F.count(F.lit(1)).alias("_m")).crossJoin(k).where(F.col("_m") == F.col("_k"))  # one-row side
    return kept.join(full.select(block), block, "left_semi")


def friedman(scores: DataFrame, block: str, model: str) -> DataFrame:
    """One row: blocks, models, tie-corrected statistic and p-value.

    Ranks are taken inside blocks (one entry per model); the statistic needs only the rank sum per model and the tie
    total, so nothing but sums leaves the tasks.
    """
    w = Window.partitionBy(block).orderBy("score")
    tied = F.count(F.lit(1)).over(Window.partitionBy(block, "score"))
    r = scores.withColumns({"_t": tied, "_r": F.rank().over(w) + (tied - 1) / 2})
    by_model = r.groupBy(model).agg(F.sum("_r").alias("_sum"), F.count(F.lit(1)).alias("_b"))
    ties = r.agg((F.sum(F.col("_t") * F.col("_t") - 1)).alias("_ties"))
    g = by_model.agg(F.count(F.lit(1)).alias("models"), F.max("_b").alias("blocks"), F.sum(F.col("_sum") * F.col("_sum")).alias("_ss"))
    k, n = F.col("models"), F.col("blocks")
    corr = 1 - F.try_divide(F.col("_ties"), n * k * (k * k - 1))
    chi = F.try_divide(F.try_divide(F.lit(12.0), n * k * (k + 1)) * F.col("_ss") - 3 * n * (k + 1), corr)  # null below two models
    one = g.crossJoin(ties).select("blocks", "models", chi.alias("statistic"))  # one row each

    @F.pandas_udf("double")
    def tail(x: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else chi2_sf(float(a), float(b) - 1) for a, b in zip(x, m)], dtype="float64")
    return one.withColumn("p_value", tail("statistic", "models"))


# --- Wilcoxon + Holm ---------------------------------------------------------------------------------------------

def wilcoxon_vs_best(scores: DataFrame, block: str, model: str, alpha: float = 0.05, exact_up_to: int = 50) -> DataFrame:
    """Every model against the one with the lowest median: one-sided signed-rank test, Holm-adjusted.

    Zero differences are dropped. ``exact_up_to`` is the reference's automatic rule: exact tail up to that many untied,
    non-zero differences, otherwise the tie-corrected normal tail (0: always normal). ``tail_method`` says which was used.
    """
    med = scores.groupBy(model).agg(median("score").alias("median_score"))
    best = med.agg(F.min_by(model, F.struct("median_score", model)).alias("best_model"))
    base = scores.crossJoin(best).where(F.col(model) == F.col("best_model")).select(block, F.col("score").alias("_b"))  # one-row side
    j = scores.crossJoin(best).where(F.col(model) != F.col("best_model")).join(base, block)
    d = j.select(block, model, "best_model", (F.col("score") - F.col("_b")).alias("diff"))
    nz = d.where(F.abs("diff") > 0).withColumn("_a", F.abs("diff"))
    tied = F.count(F.lit(1)).over(Window.partitionBy(model, "_a"))
    r = nz.withColumns({"_t": tied, "_r": F.rank().over(Window.partitionBy(model).orderBy("_a")) + (tied - 1) / 2})
    sums = r.groupBy(model).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("diff") > 0, F.col("_r")).otherwise(0.0)).alias("statistic"),
                                F.sum((F.col("_t") * F.col("_t") - 1) / 48.0).alias("_ties"))
    all_ = d.groupBy(model).agg(F.max("best_model").alias("best_model"), F.count(F.lit(1)).alias("blocks"),
                                median("diff").alias("median_delta"))

    @F.pandas_udf("double")
    def tail(method: pd.Series, n: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for how, m, s, t in zip(method, n, w, ties):
            if how == "none":
                out.append(1.0)
            elif how == "exact":
                out.append(signed_rank_sf(s, int(m)))
            else:
                var = m * (m + 1) * (2 * m + 1) / 24.0 - t
                out.append(normal_sf((s - m * (m + 1) / 4.0) / math.sqrt(var)) if var > 0 else 1.0)
        return pd.Series(out, dtype="float64")

    t = all_.join(sums, model, "left").fillna(0, ["_n", "statistic", "_ties"])
    untied = (F.col("_ties") == 0) & (F.col("_n") == F.col("blocks"))
    method = F.when(F.col("_n") == 0, "none").when((F.col("_n") <= exact_up_to) & untied, "exact").otherwise("normal")
    t = t.withColumn("tail_method", method).withColumn("raw_p_value", tail("tail_method", "_n", "statistic", "_ties"))
    return holm(t.drop("_n", "_ties"), "raw_p_value", model, alpha)


def holm(df: DataFrame, p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjustment: running maximum of p * (m - rank + 1), capped at 1 (one row per compared model)."""
    w = Window.partitionBy(F.lit(0)).orderBy(p, tie)
    step = F.least(F.lit(1.0), F.col(p) * (F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))) - F.row_number().over(w) + 1))
    out = df.withColumn("_h", step)
    adj = F.max("_h").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("holm_p_value", adj).withColumn("significantly_worse", F.col("holm_p_value") < alpha).drop("_h")


# --- correlations and fits -----------------------------------------------------------------------------------------

def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    entries = [F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]
    return df.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, f"_e.{name}", f"_e.{value}").where(
        F.col(value).isNotNull())


def correlation_table(df: DataFrame, key: str, descriptors: Sequence[str], outcomes: Sequence[str], min_rows: int = 4) -> DataFrame:
    """Pearson and Spearman of every descriptor with every outcome where both vary on enough datasets."""
    a = unpivot(df, [key], descriptors, "descriptor", "x")
    b = unpivot(df, [key], outcomes, "outcome", "y")
    j = a.join(b, key)
    by = ["descriptor", "outcome"]
    p = j.groupBy(*by).agg(F.count(F.lit(1)).alias("datasets"), M.pearson("x", "y").alias("pearson"))
    s = M.spearman(j, by, "x", "y").select(*by, "spearman")
    return key_join(p, s, by).where((F.col("datasets") >= min_rows) & F.col("pearson").isNotNull())


def log_log_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, min_rows: int = 3) -> DataFrame:
    """Slope, intercept and correlation of log10 y on log10 x over positive pairs."""
    ok = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(*keys, F.log10(x).alias("_x"), F.log10(y).alias("_y"))
    g = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.regr_slope("_y", "_x").alias("slope"),
                              F.regr_intercept("_y", "_x").alias("intercept"), M.pearson("_x", "_y").alias("correlation"))
    return g.where(F.col("n_rows") >= min_rows)
