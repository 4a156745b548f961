"""Ridge regression from mergeable second moments: one pass over the rows serves every fold, group and penalty."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grouped_gram(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Per key and row index ``i`` the array of sums of x_i * x_j, for vectors of equal width.

    Tasks add up their own rows per key first and emit one small matrix per key; a hot key costs one matrix per task.
    """
    key_fields = [f for f in df.schema.fields if f.name in keys]
    out = T.StructType([*key_fields, T.StructField("i", T.LongType()), T.StructField("row", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(list(keys), sort=False, dropna=False):
                x = np.asarray(part[vector].to_list(), dtype=np.float64)
                sums[key] = sums.get(key, 0.0) + x.T @ x
        for key, g in sums.items():
            named = {k: [v] * len(g) for k, v in zip(keys, key)}
            yield pd.DataFrame({**named, "i": np.arange(len(g)), "row": list(g)})

    return summed_rows(df.select(*keys, vector).mapInPandas(run, out), keys)


def weighted_grams(df: DataFrame, keys: Sequence[str], vector: str, weights: str) -> DataFrame:
    """As ``grouped_gram`` for every entry of the array ``weights``: per key, ``member`` and ``i`` the sums of w * x_i * x_j.

    All members come from one pass over the rows; a task emits one small matrix per key and member.
    """
    key_fields = [f for f in df.schema.fields if f.name in keys]
    out = T.StructType([*key_fields, T.StructField("member", T.LongType()), T.StructField("i", T.LongType()),
                        T.StructField("row", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf.groupby(list(keys), sort=False, dropna=False):
                x = np.asarray(part[vector].to_list(), dtype=np.float64)
                w = np.asarray(part[weights].to_list(), dtype=np.float64)
                sums[key] = sums.get(key, 0.0) + np.stack([x.T @ (x * w[:, [s]]) for s in range(w.shape[1])])
        for key, members in sums.items():
            for s, g in enumerate(members):
                yield pd.DataFrame({**{k: [v] * len(g) for k, v in zip(keys, key)}, "member": s, "i": np.arange(len(g)), "row": list(g)})

    return summed_rows(df.select(*keys, vector, weights).mapInPandas(run, out), [*keys, "member"])


def summed_rows(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds up the tasks' matrices: one array ``row`` per key and row index ``i``."""
    cells = parts.select(*keys, "i", F.posexplode("row").alias("j", "v")).groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"])  # one matrix row
    return cells.groupBy(*keys, "i").agg(rows.alias("row"))


def with_intercept(df: DataFrame, features: str, target: str, name: str = "_x") -> DataFrame:
    """Vector (1, features..., target) for moment sums."""
    return df.withColumn(name, F.concat(F.array(F.lit(1.0)), F.col(features).cast("array<double>"),
                                        F.array(F.col(target).cast("double"))))


def solve_ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, weights) of ridge on centred data from the moments of (1, x, y); the intercept is not penalised."""
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    d = len(mean) - 1
    w = np.linalg.lstsq(cov[:d, :d] + alpha * np.eye(d), cov[:d, d], rcond=None)[0]
    return np.concatenate([[mean[d] - w @ mean[:d]], w])


def squared_error(gram: np.ndarray, coef: np.ndarray) -> float:
    """Sum of squared residuals of ``coef`` on the rows behind ``gram``."""
    v = np.concatenate([coef, [-1.0]])
    return float(max(v @ gram @ v, 0.0))


def pick_alpha(folds: list[np.ndarray], alphas: Sequence[float]) -> float:
    """Penalty with the lowest k-fold squared error; a fold's training moments are the total minus its own."""
    total = sum(folds)
    errors = [sum(squared_error(g, solve_ridge(total - g, a)) for g in folds) for a in alphas]
    return float(alphas[int(np.argmin(errors))])


def fold_coefficients(df: DataFrame, keys: Sequence[str], fold: str, features: str, target: str,
                      alphas: Sequence[float]) -> DataFrame:
    """Per key: coefficients with each fold left out (``fold`` >= 0) and on all rows (``fold`` = -1).

    The penalty of a fit is chosen among the folds of that fit alone, so a fold left out takes no part in it. Only moment
    matrices (one per key and fold) meet in a task, never rows.
    """
    gram = grouped_gram(with_intercept(df, features, target), [*keys, fold], "_x")
    key_fields = [f for f in df.schema.fields if f.name in keys]
    out = T.StructType([*key_fields, T.StructField("fold", T.LongType()), T.StructField("alpha", T.DoubleType()),
                        T.StructField("coef", T.ArrayType(T.DoubleType()))])
    alphas = list(alphas)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mats = {f: np.vstack(g.sort_values("i")["row"].to_list()) for f, g in pdf.groupby(fold)}
        names, rows = list(mats), []
        for left_out in [-1, *(names if len(names) > 1 else [])]:
            used = [mats[f] for f in names if f != left_out]
            alpha = pick_alpha(used, alphas) if len(used) > 1 else alphas[0]
            rows.append((int(left_out), alpha, solve_ridge(sum(used), alpha)))
        res = pd.DataFrame(rows, columns=["fold", "alpha", "coef"])
        for k in keys:
            res.insert(0, k, pdf[k].iloc[0])
        return res[[*keys, "fold", "alpha", "coef"]]

    return gram.groupBy(*keys).applyInPandas(run, out)


def linear_prediction(features: str = "features", coef: Column | str = "coef"):
    """Intercept plus dot product, inside the JVM."""
    coef = F.col(coef) if isinstance(coef, str) else coef
    dot = F.aggregate(F.zip_with(F.col(features).cast("array<double>"), F.slice(coef, F.lit(2), F.size(coef)), lambda a, b: a * b),
                      F.lit(0.0), lambda acc, x: acc + x)
    return F.element_at(coef, 1) + dot
