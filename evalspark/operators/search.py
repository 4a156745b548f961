"""Evolutionary search over model parameters: a generation is scored as a whole, by any metric.

``generations`` is the loop. It hands the new individuals of a generation to a scorer at once, and a scorer answers with
one loss each. ``elastic_net_losses`` fits all of them on all folds from moment matrices that cost one pass over the rows
for the whole search; errors of squares follow from the held-out matrices, other metrics from one pass a generation.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators import metrics as M
from evalspark.operators.elastic_net import centred, descend, raw_coefficients, spreads
from evalspark.operators.linear import grouped_gram, linear_prediction, squared_error, with_intercept
from evalspark.session import durable

Space = dict[str, tuple[str, tuple]]
Losses = Callable[[list[dict]], list[float]]

MOMENT_METRICS = ("rmse", "mse", "r2")
ERROR_METRICS = ("rmse", "mse", "mae")
METRICS = (*ERROR_METRICS, "r2", "pearson", "spearman", "roc_auc", "auprc", "accuracy", "balanced_accuracy", "mcc")
LINEAR_SPACE: Space = {"log_alpha": ("uniform", (-4.0, 0.0)), "l1_ratio": ("uniform", (0.0, 1.0))}
SLOTS = 4  # tasks per fold that share the fits of a generation


def draw(space: Space, rng: random.Random) -> dict:
    out = {}
    for name, (kind, args) in space.items():
        out[name] = rng.choice(args) if kind == "choice" else rng.randint(*args) if kind == "int" else rng.uniform(*args)
    return out


def mutate(ind: dict, space: Space, rng: random.Random, rate: float) -> dict:
    out = dict(ind)
    for name, (kind, args) in space.items():
        if rng.random() >= rate:
            continue
        if kind == "choice":
            out[name] = rng.choice(args)
        else:
            low, high = args
            moved = min(max(rng.gauss(out[name], 0.2 * (high - low)), low), high)
            out[name] = int(round(moved)) if kind == "int" else moved
    return out


def generations(spark: SparkSession, losses: Losses, space: Space, population: int = 16, generations: int = 12, elites: int = 2,
                mutation: float = 0.35, seed: int = 42) -> DataFrame:
    """Search history, one row per generation and individual, best first; an individual seen before is not scored again."""
    rng = random.Random(seed)
    known: dict[tuple, float] = {}
    current = [draw(space, rng) for _ in range(population)]
    history = []
    for gen in range(generations):
        keys = [tuple(sorted(i.items())) for i in current]
        fresh = [k for k in dict.fromkeys(keys) if k not in known]
        if fresh:
            known.update(zip(fresh, losses([dict(k) for k in fresh])))
        ranked = sorted(zip(keys, current), key=lambda kc: (known[kc[0]], str(kc[0])))
        history += [(gen, r, known[k], str(dict(k))) for r, (k, _) in enumerate(ranked)]
        nxt = [dict(c) for _, c in ranked[:elites]]
        parents = [c for _, c in ranked[:max(2, population // 2)]]
        while len(nxt) < population:
            a, b = rng.sample(parents, 2)
            child = {n: (a if rng.random() < 0.5 else b)[n] for n in space}
            nxt.append(mutate(child, space, rng, mutation))
        current = nxt
    return spark.createDataFrame(history, "generation int, place int, loss double, params string")


def known_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return metric


def group_losses(pred: DataFrame, keys: Sequence[str], metric: str, y: str = "observed", p: str = "predicted") -> DataFrame:
    """``loss`` of every key group: errors as they are, other metrics with their sign turned; null where undefined.

    ROC-AUC and average precision take labels 0 and 1; their scores are rounded to 9 digits, so that equal sums tie.
    """
    known_metric(metric)
    if metric == "spearman":
        table = M.spearman(pred, keys, y, p)
    elif metric in ("roc_auc", "auprc"):
        ranked = pred.select(*keys, F.col(y).cast("int").alias("label"), (F.round(F.col(p), 9) + 0.0).alias("score"))
        table = M.streamed_ranking(ranked, keys)
    elif metric in ("accuracy", "balanced_accuracy", "mcc"):
        table = M.confusion_metrics(pred, keys, y, p)
    else:
        table = M.regression_errors(pred, keys, y, p)
    return table.select(*keys, (F.col(metric) if metric in ERROR_METRICS else -F.col(metric)).alias("loss"))


def mean_losses(table: DataFrame, n: int, folds: int) -> list[float]:
    """Mean fold loss of the candidates 0 to n - 1; infinite where a fold has none. ``table`` has n * folds rows."""
    sums: dict[int, list[float]] = {}
    for candidate, loss in table.select("candidate", "loss").collect():
        if loss is not None and np.isfinite(loss):
            sums.setdefault(candidate, []).append(loss)
    return [float(np.mean(sums[c])) if len(sums.get(c, [])) == folds else float("inf") for c in range(n)]


def _moment_loss(gram: np.ndarray, coef: np.ndarray, metric: str) -> float | None:
    n, squares = gram[0, 0], squared_error(gram, coef)
    if metric == "rmse":
        return float(np.sqrt(squares / n))
    if metric == "mse":
        return squares / n
    if metric == "r2":
        total = gram[-1, -1] - gram[0, -1] ** 2 / n
        return -(1 - squares / total) if total > 1e-12 * max(gram[-1, -1], 1e-300) else (-1.0 if squares <= 1e-12 else 0.0)
    return None


def elastic_net_losses(train: DataFrame, fold: str, features: str, target: str, metric: str = "rmse") -> Losses:
    """Scorer of individuals with ``log_alpha`` (decimal) and ``l1_ratio``; a binary target is fitted as 0 and 1.

    Tasks hold the matrices of one fold (features squared), never rows. The driver sees a loss per individual and fold.
    """
    known_metric(metric)
    spark = train.sparkSession
    rows = train.select(F.col(fold).cast("long").alias("fold"), F.col(features).cast("array<double>").alias("f"), F.col(target).cast("double").alias("y"))
    own = durable(grouped_gram(with_intercept(rows, "f", "y"), ["fold"], "_x"))
    cells = own.select("fold", "i", F.posexplode("row").alias("j", "v"))
    total = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("whole"))  # one matrix row
    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot")
    grams = durable(own.join(total, "i").select("fold", "i", "row", "whole", slots))
    folds = own.select("fold").distinct().count()
    if folds < 2:
        raise ValueError("at least two folds with rows are needed")
    places = grams.select(F.col("fold").alias("at_fold"), F.col("slot").alias("at_slot")).distinct()

    def fit(some: pd.DataFrame, matrix: pd.DataFrame) -> pd.DataFrame:
        if some.empty:  # fewer individuals than slots
            return pd.DataFrame([], columns=["candidate", "fold", "coef", "loss"])
        matrix = matrix.sort_values("i")
        held, whole = np.vstack(matrix["row"].to_list()), np.vstack(matrix["whole"].to_list())
        scale, rest = spreads(whole), whole - held
        cov, xy, _, _ = centred(rest, scale)
        out = []
        for c, f, log_alpha, ratio in some[["candidate", "fold", "log_alpha", "l1_ratio"]].itertuples(index=False):
            coef = raw_coefficients(rest, scale, descend(cov, xy, 10.0 ** log_alpha, ratio, np.zeros(len(xy))))
            out.append((c, f, coef, _moment_loss(held, coef, metric)))
        return pd.DataFrame(out, columns=["candidate", "fold", "coef", "loss"])

    def losses(individuals: list[dict]) -> list[float]:
        wanted = [(i, float(p["log_alpha"]), float(p["l1_ratio"])) for i, p in enumerate(individuals)]
        c = spark.createDataFrame(wanted, "candidate int, log_alpha double, l1_ratio double").withColumn("slot", F.pmod("candidate", F.lit(SLOTS)))
        jobs = c.join(places, F.col("slot") == F.col("at_slot")).select("candidate", F.col("at_fold").alias("fold"), "slot", "log_alpha", "l1_ratio")
        fits = jobs.groupBy("fold", "slot").cogroup(grams.groupBy("fold", "slot")).applyInPandas(
            fit, "candidate int, fold long, coef array<double>, loss double")
        if metric not in MOMENT_METRICS:
            fits = durable(fits)  # population x folds rows of a coefficient per feature: bounded by the parameters
            scored = rows.join(F.broadcast(fits.select("candidate", "fold", "coef")), "fold")
            pred = scored.select("candidate", "fold", F.col("y").alias("observed"), linear_prediction("f", "coef").alias("predicted"))
            fits = group_losses(pred, ["candidate", "fold"], metric)
        return mean_losses(fits, len(individuals), folds)
    return losses


def evolve_elastic_net(df: DataFrame, fold: str, features: str, target: str, metric: str = "rmse", space: Space = LINEAR_SPACE, **search) -> DataFrame:
    """Search history of elastic nets on train rows; ``search`` goes to ``generations``."""
    train = durable(df.where("split = 'train'").select(fold, features, target))
    return generations(df.sparkSession, elastic_net_losses(train, fold, features, target, metric), space, **search)
