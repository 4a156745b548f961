"""Logistic stacking, fusion by class metrics and elastic net paths against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import elastic_net as N
from evalspark.operators import fusion as U
from evalspark.operators import logistic as C
from evalspark.operators import metrics as M


# logistic fits and stacking

def optimum(x, y, penalty=1.0):
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(penalty * np.eye(len(w)) + x.T @ (x * (p * (1 - p))[:, None]), penalty * w + x.T @ (p - y))
    return w


def test_logistic_fits_reach_the_optimum(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for name, n, width in (("a", 90, 3), ("b", 40, 2), (None, 60, 4)):
        x, fold = rng.normal(size=(n, width)) * [1, 40, 3, 0.1][:width], rng.integers(0, 3, n)
        y = (x @ rng.normal(size=width) + rng.normal(size=n) > 0).astype(int)
        rows += [(name, int(f), int(t), v.tolist()) for f, t, v in zip(fold, y, x)]
        want |= {(name, f): optimum(x[fold != f], y[fold != f]) for f in (-1, 0, 1, 2)}
    df = spark.createDataFrame(rows, "dataset string, fold long, label int, x array<double>").repartition(3)
    got = {(r["dataset"], r["fit"]): r["coef"] for r in C.logistic_fits(df, ["dataset"], "x", "label").collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert np.allclose(got[k], w, atol=1e-6)


def test_overlong_newton_step_is_halved(spark):
    """From zero a full step overshoots where one class is rare and far out; the objective must not rise."""
    x = np.concatenate([np.linspace(-1, 1, 200), [900.0, 1000.0]])
    y = np.concatenate([np.zeros(200), [1, 1]])
    df = spark.createDataFrame([("d", -2, int(t), [float(v)]) for v, t in zip(x, y)], "dataset string, fold long, label int, x array<double>")
    w = np.array(C.logistic_fits(df, ["dataset"], "x", "label").first()["coef"])
    z = np.column_stack([np.ones(len(x)), x]) @ w
    p = 1 / (1 + np.exp(-z))
    assert np.abs(w + [np.sum(p - y), np.sum((p - y) * x)]).max() < 1e-5


def class_rows(spark, sizes):
    rng = np.random.default_rng(1)
    rows = []
    for name, zeros, ones in sizes:
        for i in range(zeros + ones):
            y = float(i >= zeros)
            for split in ("train", "test"):
                rid = i + (1000 if split == "test" else 0)
                rows += [(name, m, split, rid, y, float(y + rng.normal() * s)) for m, s in (("m1", 0.5), ("m2", 2.0))]
    return spark.createDataFrame(rows, "dataset string, model string, split string, row_id long, observed double, predicted double")


def test_class_stack_and_fallbacks(spark):
    pred = class_rows(spark, [("full", 30, 17), ("single", 9, 1), ("one_class", 6, 0), ("few", 12, 3)])
    out, weights = C.class_stack(pred, ["dataset"], "row_id")
    rows = out.collect()
    assert {(r["dataset"], r["method"]) for r in rows} == {("full", "out_of_fold"), ("single", "no_folds"), ("one_class", "average"), ("few", "out_of_fold")}
    assert len(rows) == 2 * (47 + 10 + 6 + 15) and all(0 <= r["predicted"] <= 1 for r in rows if r["method"] != "average")
    w = {(r["dataset"], r["model"]): r for r in weights.collect()}
    assert w["few", "m1"]["folds"] == 3 and w["full", "m1"]["folds"] == 5
    assert w["one_class", "m1"]["weight"] == w["one_class", "m2"]["weight"] == 0.5
    assert abs(w["full", "m1"]["abs_normalized_contribution"] + w["full", "m2"]["abs_normalized_contribution"] - 1) < 1e-12
    wide = {(r["row_id"]): r for r in pred.where("dataset = 'full' and split = 'train'").groupBy("row_id").pivot("model", ["m1", "m2"]).agg(F.max("predicted")).collect()}
    direct = optimum(np.array([[r["m1"], r["m2"]] for r in wide.values()]), np.array([float(k >= 30) for k in wide]))
    assert np.allclose([w["full", "m1"]["weight"], w["full", "m2"]["weight"]], direct[1:], atol=1e-6)


def test_class_folds_are_even(spark):
    df = spark.range(101).select(F.lit("d").alias("dataset"), F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("y"), F.lit(4).cast("long").alias("folds"))
    got = C.class_folds(df, ["dataset"], "row_id", "y", rows_per_bucket=10).groupBy("fold", "y").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in got if r["y"] == y]
        assert len(counts) == 4 and max(counts) - min(counts) <= 1


# ranking

def auc_brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def ap_brute(y, s):
    total = 0.0
    for v in np.unique(s):
        total += np.sum((s == v) & (y == 1)) * np.mean(y[s >= v] == 1)
    return total / np.sum(y == 1)


def test_streamed_ranking_over_partition_borders(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g, n in (("big", 3000), ("b2", 40), ("b3", 11), ("none", 5)):
        y = np.zeros(n, int) if g == "none" else rng.integers(0, 2, n)
        s = np.round(rng.random(n) + 0.2 * y, 2 if g == "big" else 1)
        rows += [(g, 1, int(a), float(b)) for a, b in zip(y, s)]
        want[g] = (None, None) if g == "none" else (auc_brute(y, s), ap_brute(y, s))
    df = spark.createDataFrame(rows, "g string, k int, label int, score double").repartition(5)
    got = {r["g"]: r for r in M.streamed_ranking(df, ["g", "k"]).collect()}
    for g, (auc, ap) in want.items():
        assert got[g]["roc_auc"] == (pytest.approx(auc) if auc is not None else None) and got[g]["auprc"] == (pytest.approx(ap) if ap is not None else None)
    again = {r["g"]: r["roc_auc"] for r in M.ranking_metrics(df, ["g"], "label", "score").collect()}
    assert again == {g: pytest.approx(r["roc_auc"]) if r["roc_auc"] is not None else None for g, r in got.items()}


@pytest.mark.parametrize("metric", ["roc_auc", "auprc", "accuracy", "balanced_accuracy", "mcc"])
def test_fusion_by_class_metrics(spark, metric):
    pred = class_rows(spark, [("d", 25, 14)])
    cand, base = U.candidate_table(pred, ["dataset"], ["row_id"], metric)
    data = pred.where("split = 'train'").groupBy("row_id").pivot("model", ["m1", "m2"]).agg(F.max("predicted"), F.max("observed")).toPandas().to_numpy()
    y, p = data[:, 2].astype(int), data[:, [1, 3]]

    def loss(values):
        s = values if values.min() >= 0 and values.max() <= 1 else 1 / (1 + np.exp(-np.clip(values, -30, 30)))
        hit = s >= 0.5
        tp, tn, fp, fn = (np.sum(x) for x in (hit & (y == 1), ~hit & (y == 0), hit & (y == 0), ~hit & (y == 1)))
        den = np.sqrt(float((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
        return {"roc_auc": 1 - auc_brute(y, s), "auprc": 1 - ap_brute(y, s), "accuracy": 1 - (tp + tn) / len(y),
                "balanced_accuracy": 1 - (tp / (tp + fn) + tn / (tn + fp)) / 2, "mcc": 1 - (1 + ((tp * tn - fp * fn) / den if den else 0)) / 2}[metric]

    strengths = {r["idx"]: r for r in base.collect()}
    for i in (0, 1):
        assert strengths[i]["train_metric"] == pytest.approx(loss(p[:, i]))
    rows = cand.collect()
    assert len(rows) == 6
    down = np.array([[np.sum(c > v) + (np.sum(c == v) + 1) / 2 for v in c] for c in p.T]).T
    for r in rows:
        w = np.array(r["weights"])
        value = p @ w
        if r["combination_space"] == "rank":
            q = -(down @ w)
            slope = np.cov(q, y, bias=True)[0, 1] / np.var(q)
            value = y.mean() + slope * (q - q.mean())
        assert r["train_metric"] == pytest.approx(loss(np.round(value, 9)), abs=1e-9), r["variant"]


def test_forty_models_in_pairs(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 24)
    rows = [("d", f"m{m:02d}", "train", i, float(y[i]), float(y[i] * 0.3 + v)) for m in range(40) for i, v in enumerate(rng.random(24) * 0.7)]
    pred = spark.createDataFrame(rows, "dataset string, model string, split string, row_id long, observed double, predicted double")
    cand, _ = U.candidate_table(pred, ["dataset"], ["row_id"], "roc_auc", max_models=2)
    got = cand.where("combination_space = 'score' and variant = 'score_ac'").select("models", "train_metric").collect()
    assert len(got) == 780 == U.subset_count(40, 2, 2)
    p = {f"m{m:02d}": np.array([r[5] for r in rows[m * 24:(m + 1) * 24]]) for m in range(40)}
    for names, loss in list(map(tuple, got))[::37]:
        a, b = names.split("|")
        assert loss == pytest.approx(1 - auc_brute(y, np.round((p[a] + p[b]) / 2, 9)))


def test_unknown_metric_raises(spark):
    with pytest.raises(ValueError, match="no losses"):
        U.candidate_table(class_rows(spark, [("d", 5, 5)]), ["dataset"], ["row_id"], "f1")


# elastic net

def regression_rows(rng, n=120, d=7):
    x = rng.normal(size=(n, d)) * np.array([1, 5, 0.2, 3, 1, 1, 0][:d]) + 4
    x[:, 4] = x[:, 1] * 0.9 + rng.normal(size=n) * 0.1  # correlated
    return x, x @ np.array([1, 0.5, 0, -1, 0, 0, 0][:d]) + rng.normal(size=n)


def objective(x, y, w, b, alpha, ratio):
    return np.mean((y - x @ w - b) ** 2) / 2 + alpha * (ratio * np.abs(w).sum() + (1 - ratio) / 2 * w @ w)


@pytest.mark.parametrize("alpha,ratio", [(1.0, 0.4), (0.1, 0.8), (0.01, 1.0), (1e-4, 0.1), (30.0, 0.5)])
def test_path_meets_the_optimality_conditions(alpha, ratio):
    x, y = regression_rows(np.random.default_rng(4))
    full = np.column_stack([np.ones(len(x)), x, y])
    gram = full.T @ full
    scale = N.spreads(gram)
    w = N.path(gram, scale, sorted({alpha, 1.0, 0.1}, reverse=True), ratio)[sorted({alpha, 1.0, 0.1}, reverse=True).index(alpha)]
    z = (x - x.mean(axis=0)) / scale
    slope = z.T @ (y - y.mean() - z @ w) / len(y)  # what each feature still pulls
    for j in range(len(w)):
        if w[j]:
            assert slope[j] - alpha * (1 - ratio) * w[j] == pytest.approx(alpha * ratio * np.sign(w[j]), abs=1e-7)
        else:
            assert abs(slope[j]) <= alpha * ratio + 1e-7
    coef = N.raw_coefficients(gram, scale, w)
    assert np.allclose(coef[0] + x @ coef[1:], y.mean() + z @ w)


def test_elastic_net_cv_by_dataset(spark):
    rng = np.random.default_rng(5)
    data = {name: regression_rows(rng, n) for name, n in (("a", 90), ("b", 60))}
    rows = [(name, i % 3, v.tolist(), float(t)) for name, (x, y) in data.items() for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "dataset string, fold int, x array<double>, y double").repartition(4)
    for r in N.elastic_net_cv(df, ["dataset"], "fold", "x", "y").collect():
        x, y = data[r["dataset"]]
        sd = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        fold, best = np.arange(len(y)) % 3, None
        for ratio, alpha in itertools.product(N.MODEL_L1_RATIOS, sorted(N.MODEL_ALPHAS, reverse=True)):
            errors = []
            for f in range(3):
                t = fold != f
                full = np.column_stack([np.ones(t.sum()), x[t], y[t]])
                c = N.raw_coefficients(full.T @ full, sd, N.path(full.T @ full, sd, [alpha], ratio)[0])
                errors.append(np.mean((y[~t] - c[0] - x[~t] @ c[1:]) ** 2))
            if best is None or np.mean(errors) < best[0] - 1e-12:
                best = (np.mean(errors), alpha, ratio)
        assert (r["cv_mse"], r["alpha"], r["l1_ratio"]) == (pytest.approx(best[0]), pytest.approx(best[1]), best[2])


def test_medians_and_estimator(spark):
    x, y = regression_rows(np.random.default_rng(6), 80)
    rows = [("d", [None if i % 9 == 0 and j == 1 else float("nan") if i % 7 == 0 and j == 2 else float(v) for j, v in enumerate(r)], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "dataset string, x array<double>, y double")
    got = np.array([r["x"] for r in N.impute_medians(df, df, ["dataset"], "x").orderBy("y").collect()], float)
    known = np.array([[np.nan if v is None else v for v in r[1]] for r in rows])[np.argsort(y)]
    assert np.allclose(got, np.where(np.isnan(known), np.nanmedian(known, axis=0), known))
    from evalspark.operators.models import as_vectors
    train = as_vectors(spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "x array<double>, y double"), "x", "y")
    out = N.ElasticNetCV().fit(train).transform(train)
    assert "prediction" in out.columns and out.selectExpr("corr(prediction, label)").first()[0] > 0.8
