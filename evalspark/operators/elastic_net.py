"""Elastic net with cross-validation from moment matrices: one pass over the rows serves the whole grid of every dataset.

The objective is half the mean squared error plus ``alpha`` times (``l1_ratio`` |w| + (1 - ``l1_ratio``) w.w / 2) on features
scaled by the spread of all training rows. Paths go down the penalties with warm starts; coordinate descent works on the
covariances, so its cost depends on the number of features, never on rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.cleaning import finite
from evalspark.operators.linear import grouped_gram, linear_prediction, squared_error, with_intercept
from evalspark.operators.ordering import ROWS_PER_BUCKET, key_join, quantiles
from evalspark.session import durable

# Penalty grid and mixing of the regression model table.
MODEL_ALPHAS = tuple(10 ** (-4 + 4 * i / 11) for i in range(12))
MODEL_L1_RATIOS = (0.4, 0.8)
MAX_SWEEPS = 15000


def centred(gram: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(covariance of scaled features, their covariance with y, feature means, mean of y) from the moments of (1, x, y)."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    return cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale, mean[:-1], float(mean[-1])


def spreads(gram: np.ndarray) -> np.ndarray:
    """Population standard deviation of each feature, 1 where it is constant."""
    n = gram[0, 0]
    mean = gram[0, 1:-1] / n
    second = np.diag(gram)[1:-1] / n
    var = second - mean * mean
    return np.sqrt(np.where(var > 1e-12 * np.maximum(second, 1e-300), var, 1.0))


def descend(cov: np.ndarray, xy: np.ndarray, alpha: float, l1_ratio: float, start: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Coordinate descent from ``start``: sweeps over the features in use until they rest, then over all, until none moves."""
    w = start.copy()
    slope = cov @ w
    diagonal, l1, l2 = np.diag(cov), alpha * l1_ratio, alpha * (1 - l1_ratio)
    limit = tolerance * max(1.0, float(np.abs(xy).max(initial=0.0)))

    def sweep(places) -> float:
        moved = 0.0
        for j in places:
            below = diagonal[j] + l2
            if below <= 1e-12:
                continue
            pull = xy[j] - slope[j] + diagonal[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / below
            step = new - w[j]
            if step:
                slope[:] += cov[:, j] * step
                w[j] = new
                moved = max(moved, abs(step))
        return moved

    for _ in range(MAX_SWEEPS):
        if sweep(range(len(w))) <= limit:
            return w
        active = np.flatnonzero(w)
        for _ in range(MAX_SWEEPS):
            if sweep(active) <= limit:
                break
    raise RuntimeError(f"coordinate descent did not settle in {MAX_SWEEPS} sweeps")


def path(gram: np.ndarray, scale: np.ndarray, alphas: Sequence[float], l1_ratio: float) -> np.ndarray:
    """Scaled coefficients for each of ``alphas`` (falling), each from the one before."""
    cov, xy, _, _ = centred(gram, scale)
    w, out = np.zeros(len(xy)), []
    for alpha in alphas:
        w = descend(cov, xy, alpha, l1_ratio, w)
        out.append(w)
    return np.array(out)


def raw_coefficients(gram: np.ndarray, scale: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    """(intercept, weights) on unscaled features."""
    _, _, mean, y = centred(gram, scale)
    w = scaled / scale
    return np.concatenate([[y - w @ mean], w])


def choose(folds: list[np.ndarray], alphas: Sequence[float], l1_ratios: Sequence[float]) -> tuple[float, float, float]:
    """(mean squared error, alpha, l1_ratio) of the best grid point; the errors of folds count alike, ties go to the first ratio and the larger penalty."""
    total = sum(folds)
    scale, falling = spreads(total), sorted(alphas, reverse=True)
    best = None
    for ratio in l1_ratios:
        errors = np.zeros(len(falling))
        for g in folds:
            train = total - g
            errors += [squared_error(g, raw_coefficients(train, scale, w)) / g[0, 0] for w in path(train, scale, falling, ratio)]
        errors /= len(folds)
        at = int(errors.argmin())
        if best is None or errors[at] < best[0]:
            best = (float(errors[at]), float(falling[at]), float(ratio))
    return best


def elastic_net_cv(df: DataFrame, keys: Sequence[str], fold: str, features: str, target: str, alphas: Sequence[float] = MODEL_ALPHAS,
                   l1_ratios: Sequence[float] = MODEL_L1_RATIOS) -> DataFrame:
    """Per dataset: cv_mse, alpha, l1_ratio, ``coef`` (intercept first, unscaled) and ``scaled`` coefficients of the refit.

    Only moment matrices (one per dataset and fold, features squared) meet in a task, never rows. A single fold takes the
    largest penalty and first ratio without an error.
    """
    gram = grouped_gram(with_intercept(df, features, target), [*keys, fold], "_x")
    key_fields = [f for f in df.schema.fields if f.name in keys]
    doubles = T.ArrayType(T.DoubleType())
    out = T.StructType([*key_fields, *[T.StructField(c, T.DoubleType()) for c in ("cv_mse", "alpha", "l1_ratio")], T.StructField("coef", doubles), T.StructField("scaled", doubles)])
    alphas, l1_ratios = list(alphas), list(l1_ratios)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mats = [np.vstack(g.sort_values("i")["row"].to_list()) for _, g in pdf.groupby(fold)]
        error, alpha, ratio = choose(mats, alphas, l1_ratios) if len(mats) > 1 else (None, max(alphas), l1_ratios[0])
        total = sum(mats)
        scale = spreads(total)
        scaled = path(total, scale, [a for a in sorted(alphas, reverse=True) if a >= alpha], ratio)[-1]
        row = {**{k: pdf[k].iloc[0] for k in keys}, "cv_mse": error, "alpha": alpha, "l1_ratio": ratio, "coef": raw_coefficients(total, scale, scaled), "scaled": scaled}
        return pd.DataFrame([row])[[f.name for f in out.fields]]

    return gram.groupBy(*keys).applyInPandas(run, out)


def impute_medians(df: DataFrame, train: DataFrame, keys: Sequence[str], features: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` with missing (null, NaN, infinite) features replaced by the exact median of the dataset's train rows, 0 where it has none."""
    long = train.select(*keys, F.posexplode(F.col(features).cast("array<double>")).alias("_pos", "_v")).withColumn("_v", finite("_v"))
    mid = quantiles(long, [*keys, "_pos"], "_v", [0.5], ["_m"], rows_per_bucket)
    rows = durable(mid.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_m"))).alias("_medians")))  # one entry per feature
    j = key_join(df, rows, keys, "left")
    value = F.transform(F.col(features).cast("array<double>"), lambda x, i: F.coalesce(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x), F.try_element_at("_medians", i), F.lit(0.0)))
    return j.withColumn(features, value).drop("_medians")


class ElasticNetCV(Estimator):
    """MLlib-style estimator on ``features`` and ``label``; rows are dealt to folds by a hash of their content."""

    def __init__(self, alphas: Sequence[float] = MODEL_ALPHAS, l1_ratios: Sequence[float] = MODEL_L1_RATIOS, folds: int = 3, seed: int = 42):
        super().__init__()
        self.alphas, self.l1_ratios, self.folds, self.seed = tuple(alphas), tuple(l1_ratios), folds, seed

    def _fit(self, dataset: DataFrame) -> ElasticNetCVModel:
        x = vector_to_array("features")
        rows = dataset.select(x.alias("_f"), F.col("label").cast("double").alias("_y")).withColumns(
            {"_all": F.lit(0), "_fold": F.pmod(F.xxhash64(F.lit(self.seed), "_f", "_y"), F.lit(self.folds))})
        best = elastic_net_cv(rows, ["_all"], "_fold", "_f", "_y", self.alphas, self.l1_ratios).first()
        if best is None:
            raise ValueError("no rows to fit")
        return ElasticNetCVModel(list(best["coef"]), best["alpha"], best["l1_ratio"], best["cv_mse"])


class ElasticNetCVModel(Model):
    def __init__(self, coef: list[float], alpha: float, l1_ratio: float, cv_mse: float | None):
        super().__init__()
        self.coef, self.alpha, self.l1_ratio, self.cv_mse = coef, alpha, l1_ratio, cv_mse

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumns({"_x": vector_to_array("features"), "_coef": F.array(*[F.lit(float(c)) for c in self.coef])})
        return out.withColumn("prediction", linear_prediction("_x", "_coef")).drop("_x", "_coef")
