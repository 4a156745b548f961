"""Evaluation rows: every metric of a task for the cross-validation folds, the train and the test side of each model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators import metrics as M
from evalspark.operators.ordering import key_join

REGRESSION_METRICS = ("r2", "rmse", "mae", "spearman")
CLASSIFICATION_METRICS = ("roc_auc", "auprc", "balanced_accuracy", "mcc")


def evaluation_rows(pred: DataFrame, keys: Sequence[str], fold: str, primary_metric: str, classification: bool = False) -> DataFrame:
    """One row per ``keys``: primary_metric, cv_folds, cv_primary, primary_metric_value, and cv_, train_ and test_ metrics.

    ``pred`` has the keys, ``part`` (cv, train or test; others take no part), a fold number, observed and predicted. All
    parts and folds are groups of the same aggregates. A cv metric is the mean over folds, null if a fold has none; the
    primary value is the test side's. Rows without finite values on both sides take no part.
    """
    names = CLASSIFICATION_METRICS if classification else REGRESSION_METRICS
    if primary_metric not in names:
        raise ValueError(f"unknown metric {primary_metric!r}; known: {', '.join(names)}")
    rows = M.complete(pred.where(F.col("part").isin("cv", "train", "test")), "observed", "predicted")
    rows = rows.select(*keys, "part", F.when(F.col("part") == "cv", F.col(fold).cast("long")).otherwise(-1).alias("_fold"), "observed", "predicted")
    by = [*keys, "part", "_fold"]
    if classification:
        a, b = M.ranking_metrics(rows, by), M.confusion_metrics(rows, by)
        table = key_join(a.select(*by, "roc_auc", "auprc"), b.select(*by, "balanced_accuracy", "mcc"), by)
    else:
        a, b = M.regression_errors(rows, by), M.spearman(rows, by)
        table = key_join(a.select(*by, "r2", "rmse", "mae"), b.select(*by, "spearman"), by)
    at = lambda part, c: F.when(F.col("part") == part, F.col(c))
    folds = F.count_if(F.col("part") == "cv")
    cv = [F.when(F.count(at("cv", m)) == folds, F.avg(at("cv", m))).alias(f"cv_{m}") for m in names]
    sides = [F.max(at(part, m)).alias(f"{part}_{m}") for part in ("train", "test") for m in names]
    out = table.groupBy(*keys).agg(folds.alias("cv_folds"), *cv, *sides)
    return out.withColumns({"primary_metric": F.lit(primary_metric), "cv_primary": F.col(f"cv_{primary_metric}"),
                            "primary_metric_value": F.col(f"test_{primary_metric}")})
