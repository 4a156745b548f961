"""Evaluation rows against direct formulas, with folds that have no metric and rows that do not count."""

import numpy as np
import pytest

from evalspark.operators.evaluation import evaluation_rows

PRED = "model string, part string, fold int, observed double, predicted double"


def parts(rng, model, label):
    out = []
    for part, fold, n in (("cv", 0, 20), ("cv", 1, 25), ("train", None, 45), ("test", None, 15)):
        for _ in range(n):
            x = rng.normal()
            out.append((model, part, fold, float(x + 0.5 * rng.normal() > 0) if label else x + 0.5 * rng.normal(), float(1 / (1 + np.exp(-x))) if label else x))
    return out


def only(rows, part, fold=None):
    y, p = np.array([(r[3], r[4]) for r in rows if r[1] == part and r[2] == fold]).T
    return y, p


def auc(y, p):
    return (np.sign(p[y == 1][:, None] - p[y == 0][None, :]).mean() + 1) / 2


def test_regression_rows(spark):
    rows = parts(np.random.default_rng(0), "a", False)
    extra = [("a", "test", None, None, 1.0), ("a", "test", None, 1.0, float("nan")), ("a", "other", None, 1.0, 9.0), ("a", None, None, 1.0, 9.0)]
    got = evaluation_rows(spark.createDataFrame(rows + extra, PRED), ["model"], "fold", "mae").first().asDict()
    rmse = lambda y, p: np.sqrt(((y - p) ** 2).mean())
    mae = lambda y, p: np.abs(y - p).mean()
    assert got["cv_folds"] == 2 and got["primary_metric"] == "mae"
    assert got["test_rmse"] == pytest.approx(rmse(*only(rows, "test"))) and got["train_rmse"] == pytest.approx(rmse(*only(rows, "train")))
    assert got["cv_primary"] == got["cv_mae"] == pytest.approx(np.mean([mae(*only(rows, "cv", f)) for f in (0, 1)]))
    assert got["primary_metric_value"] == pytest.approx(mae(*only(rows, "test")))
    y, p = only(rows, "test")
    rank = lambda v: v.argsort().argsort()
    assert got["test_spearman"] == pytest.approx(np.corrcoef(rank(y), rank(p))[0, 1])


def test_classification_rows(spark):
    rows = parts(np.random.default_rng(1), "a", True)
    got = evaluation_rows(spark.createDataFrame(rows, PRED), ["model"], "fold", "roc_auc", True).first().asDict()
    assert got["test_roc_auc"] == got["primary_metric_value"] == pytest.approx(auc(*only(rows, "test")))
    assert got["cv_primary"] == pytest.approx(np.mean([auc(*only(rows, "cv", f)) for f in (0, 1)]))
    y, p = only(rows, "train")
    hit = p >= 0.5
    assert got["train_balanced_accuracy"] == pytest.approx((hit[y == 1].mean() + (~hit)[y == 0].mean()) / 2)
    assert got["train_mcc"] == pytest.approx(np.corrcoef(y, hit)[0, 1])


def test_undefined_folds_missing_parts_and_null_keys(spark):
    rows = [("a", "cv", 0, 1.0, 0.9), ("a", "cv", 0, 0.0, 0.2), ("a", "cv", 1, 1.0, 0.8), ("a", "cv", 1, 1.0, 0.7), (None, "test", None, 1.0, 0.8), (None, "test", None, 0.0, 0.8)]
    got = {r["model"]: r.asDict() for r in evaluation_rows(spark.createDataFrame(rows, PRED), ["model"], "fold", "roc_auc", True).collect()}
    assert got["a"]["cv_folds"] == 2 and got["a"]["cv_roc_auc"] is None and got["a"]["test_roc_auc"] is None
    assert got[None]["test_roc_auc"] == 0.5 and got[None]["cv_folds"] == 0 and got[None]["cv_primary"] is None
    assert evaluation_rows(spark.createDataFrame([], PRED), ["model"], "fold", "rmse").count() == 0


def test_unknown_primary_metric(spark):
    with pytest.raises(ValueError, match="unknown metric"):
        evaluation_rows(spark.createDataFrame([], PRED), ["model"], "fold", "rmse", True)


def test_report_keeps_failed_models(spark):
    from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression

    from evalspark.operators.models import as_vectors, evaluate_model, model_report
    rng = np.random.default_rng(2)
    rows = [(i, "test" if i % 5 == 0 else "train", i % 2, rng.normal(size=2).tolist(), float(rng.normal())) for i in range(60)]
    df = as_vectors(spark.createDataFrame(rows, "id int, split string, fold int, x array<double>, y double"), "x", "y")
    pred = evaluate_model("good", LinearRegression(), df, "fold", "id").unionByName(evaluate_model("bad", GeneralizedLinearRegression(family="gamma"), df, "fold", "id"))
    got = {r["model"]: r.asDict() for r in model_report(pred, "fold").collect()}
    assert got["good"]["error"] is None and got["good"]["n_test"] == 12 and got["good"]["n_train"] == 48 and got["good"]["cv_folds"] == 2
    assert got["bad"]["error"] and got["bad"]["test_rmse"] is None and got["bad"]["n_test"] == 0
    assert got["good"]["primary_metric_value"] == got["good"]["test_rmse"] > 0
