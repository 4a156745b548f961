"""Combining predictions of several models: filters, averages, weights and out-of-fold stacking."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.cleaning import finite
from evalspark.operators import linear as L
from evalspark.operators import metrics as M
from evalspark.operators.joins import model_pairs
from evalspark.operators.linear import fold_coefficients, linear_prediction
from evalspark.operators.ordering import best_row, key_join

# Penalties tried by the stacking ridge.
STACK_ALPHAS = tuple(np.logspace(-6, 3, 30))


def average(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean prediction over members (voting, and seed ensembles where the members are seeds)."""
    return pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.min("observed").alias("observed"),
                                   F.avg("predicted").alias("predicted"))


def poisson_weight(row_id: str, seed: int) -> Column:
    """How often a bootstrap of this seed draws the row: Poisson with mean 1, from the row's own hash (so reruns agree)."""
    u = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))), 1, 8), 16, 10).cast("double") / 2.0 ** 32
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])  # u never exceeds the last step but by rounding
    return reduce(lambda n, s: n + (u >= float(s)).cast("double"), steps, F.lit(0.0))


def seed_ensemble(df: DataFrame, keys: Sequence[str], row_id: str, features: str, target: str, train: Column,
                  seeds: Sequence[int], alpha: float = 0.0) -> DataFrame:
    """One linear model per seed and key, fitted on that seed's bootstrap of the train rows; the members' mean for every row.

    All members are fitted from one pass (weighted moment matrices). Rows without features or target are not trained on;
    a member whose bootstrap is empty takes no part; rows without features or without members get null.
    """
    if not seeds:
        raise ValueError("a seed ensemble needs a seed")
    whole = F.col(features).isNotNull() & F.col(target).isNotNull() & ~F.exists(features, lambda x: x.isNull() | F.isnan(x))
    fit = L.with_intercept(df.where(train & whole), features, target).withColumn(
        "_w", F.array(*[poisson_weight(row_id, s) for s in seeds]))
    grams = L.weighted_grams(fit, keys, "_x", "_w")
    schema = T.StructType([*[f for f in df.schema.fields if f.name in keys], T.StructField("coef", T.ArrayType(T.DoubleType()))])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = np.vstack(pdf.sort_values("i")["row"].to_list())
        rows = [[pdf[k].iloc[0] for k in keys] + [L.solve_ridge(gram, alpha)]] if gram[0, 0] > 0 else []
        return pd.DataFrame(rows, columns=[*keys, "coef"])

    members = grams.groupBy(*keys, "member").applyInPandas(solve, schema).groupBy(*keys).agg(F.collect_list("coef").alias("_coefs"))
    each = F.array_sort(F.transform("_coefs", lambda c: L.linear_prediction(features, c)))  # one order of summing
    out = key_join(df, members, keys, "left")
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("members", F.coalesce(F.size("_coefs"), F.lit(0)).cast("long")).withColumn(
        "predicted", F.when(F.col(features).isNotNull(), total / F.size("_coefs"))).drop("_coefs")


def aligned_rows(pred: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Predictions of the rows that every member of the dataset predicts; one row per member and row."""
    members = pred.select(*keys, "model").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_members"))
    full = pred.groupBy(*keys, *row).agg(F.count(F.lit(1)).alias("_n"))
    full = key_join(full, members, keys).where("_n = _members").select(*keys, *row)
    return pred.join(full, [*keys, *row], "left_semi")


def inverse_error_weights(pred: DataFrame, keys: Sequence[str], floor: float = 1e-8) -> DataFrame:
    """Weights proportional to 1 / train RMSE per dataset and model."""
    e = pred.where("split = 'train'").groupBy(*keys, "model").agg(
        (1 / F.greatest(M.rmse("observed", "predicted"), F.lit(floor))).alias("_w"))
    total = e.groupBy(*keys).agg(F.sum("_w").alias("_t"))
    return key_join(e, total, keys).select(*keys, "model", (F.col("_w") / F.col("_t")).alias("weight"))


def weighted_average(pred: DataFrame, weights: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Weighted sum per row; ``weights`` has one row per dataset and member."""
    j = key_join(pred, weights, [*keys, "model"])
    return j.groupBy(*keys, *row).agg(F.min("observed").alias("observed"),
                                      F.sum(F.col("weight") * F.col("predicted")).alias("predicted"))


def member_filter(pred: DataFrame, dataset: str = "dataset", row: str = "row_id", max_correlation: float = 0.995,
                  selection_split: str = "test") -> DataFrame:
    """Members kept per dataset: non-positive R2 out (if two or more remain), then the worse of each too similar pair.

    R2 and ties are judged on ``selection_split`` (the reference uses the test side); similarity is the absolute
    correlation of train predictions. The greedy loop runs per dataset over one row per model pair.
    """
    stats = pred.where(F.col("split") == selection_split).groupBy(dataset, "model").agg(
        M.r2("observed", "predicted").alias("r2"), M.rmse("observed", "predicted").alias("primary"))
    pairs = model_pairs(pred.where("split = 'train'"), [dataset], [row])
    corr = pairs.groupBy(dataset, "model_a", "model_b").agg(
        F.abs(F.coalesce(M.pearson("value_a", "value_b"), F.lit(0.0))).alias("c"))
    models = stats.groupBy(dataset).agg(F.collect_list(F.struct("model", "r2", "primary")).alias("models"))
    links = corr.groupBy(dataset).agg(F.collect_list(F.struct("model_a", "model_b", "c")).alias("links"))
    j = models.join(links, dataset, "left")
    schema = f"{dataset} {pred.schema[dataset].dataType.simpleString()}, model string, kept boolean, reason string"

    def run(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for _, rec in pdf.iterrows():
                rows += [(rec[dataset], *r) for r in _filter_members(rec["models"], rec["links"], max_correlation)]
            yield pd.DataFrame(rows, columns=[dataset, "model", "kept", "reason"])
    return j.mapInPandas(run, schema)


def _filter_members(models, links, limit):
    info = {m["model"]: (m["r2"], m["primary"]) for m in models}
    active, reason = sorted(info), {}
    good = [m for m in active if info[m][0] is not None and info[m][0] > 0]
    if len(good) >= 2:
        reason = {m: "non_positive_r2" for m in active if m not in good}
        active = good
    pairs = sorted(((-p["c"], p["model_a"], p["model_b"]) for p in (links if links is not None else [])))
    while len(active) > 2:
        worst = next(((a, b) for c, a, b in pairs if -c > limit and a in active and b in active), None)
        if worst is None:
            break
        a, b = worst
        drop = b if info[b][1] > info[a][1] else a
        reason[drop] = "highly_correlated"
        active = [m for m in active if m != drop]
    return [(m, m in active, reason.get(m)) for m in sorted(info)]


def member_vectors(pred: DataFrame, keys: Sequence[str], row: Sequence[str]) -> DataFrame:
    """Aligned rows with the members' predictions as one array in model-name order."""
    n = pred.select(*keys, "model").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    clean = pred.where(finite("predicted").isNotNull() & finite("observed").isNotNull())
    g = clean.groupBy(*keys, "split", *row).agg(
        F.count(F.lit(1)).alias("_have"), F.min("observed").alias("observed"),
        F.array_sort(F.collect_list(F.struct("model", "predicted"))).alias("_e"))  # one entry per model
    return key_join(g, n, keys).where(F.col("_have") == F.col("_n")).select(
        *keys, "split", *row, "observed", F.transform("_e", lambda e: e["model"]).alias("models"),
        F.transform("_e", lambda e: e["predicted"]).alias("features"))


def stack(pred: DataFrame, keys: Sequence[str], row: Sequence[str], fold: str,
          alphas: Sequence[float] = STACK_ALPHAS) -> tuple[DataFrame, DataFrame]:
    """Ridge stacking: (predictions, weights).

    Train rows are predicted by the coefficients that left their fold out, test rows by the fit on all train rows.
    ``fold`` is a column of ``pred`` (any value on test rows).
    """
    folds = pred.where("split = 'train'").select(*keys, *row, F.col(fold).cast("long").alias("_f")).distinct()
    x = member_vectors(pred, keys, row)
    train = key_join(x.where("split = 'train'"), folds, [*keys, *row])
    coef = fold_coefficients(train, keys, "_f", "features", "observed", alphas)
    coef = coef.withColumnRenamed("fold", "_f")
    tr = key_join(train, coef, [*keys, "_f"])
    te = key_join(x.where("split = 'test'"), coef.where("_f = -1"), keys)
    cols = [*keys, "split", *row, "observed", linear_prediction().alias("predicted")]
    w = F.slice("coef", F.lit(2), F.size("coef"))
    total = F.aggregate(F.transform(w, lambda c: F.abs(c)), F.lit(0.0), lambda a, c: a + c)
    models = x.groupBy(*keys).agg(F.max("models").alias("models"))
    named = key_join(coef.where("_f = -1"), models, keys)
    long = named.select(*keys, "alpha", total.alias("_t"), F.posexplode(F.arrays_zip("models", w.alias("w"))).alias("_i", "_e"))
    weights = long.select(*keys, "alpha", F.col("_e.models").alias("model"), F.col("_e.w").alias("weight"),
                          F.try_divide(F.abs("_e.w"), F.col("_t")).alias("abs_normalized_contribution"))
    return tr.select(*cols).unionByName(te.select(*cols)), weights


def best_per_workflow(metrics: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Fusion inputs: best finite row per workflow."""
    ok = metrics.where(finite(score).isNotNull())
    return best_row(ok, [*keys, "workflow"], [F.col(score), F.col("model")])
