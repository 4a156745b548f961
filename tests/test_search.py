"""Search over elastic nets: every generation's losses against direct fits, and the loop itself."""

import numpy as np
import pytest

from evalspark.operators import search as S
from evalspark.operators.elastic_net import centred, descend, raw_coefficients, spreads

WANTED = [{"log_alpha": a, "l1_ratio": q} for a, q in ((-3.0, 0.5), (-1.0, 0.0), (-0.5, 1.0), (2.0, 1.0), (-2.0, 0.9))]


def rows(n=90, d=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x @ np.array([1.0, -2.0, 0.0, 0.5])[:d] + 0.3 * rng.normal(size=n)
    return x, y, np.arange(n) % 3


def frame(spark, x, y, fold):
    return spark.createDataFrame([("train", int(f), a.tolist(), float(b)) for a, b, f in zip(x, y, fold)],
                                 "split string, fold int, x array<double>, y double")


def auc(y, p):
    pairs = np.sign(p[y == 1][:, None] - p[y == 0][None, :])
    return (pairs.mean() + 1) / 2


def direct(metric, y, p):
    e = y - p
    total = ((y - y.mean()) ** 2).sum()
    return {"rmse": lambda: np.sqrt((e ** 2).mean()), "mse": lambda: (e ** 2).mean(), "mae": lambda: np.abs(e).mean(),
            "r2": lambda: (e ** 2).sum() / total - 1, "pearson": lambda: -np.corrcoef(y, p)[0, 1], "roc_auc": lambda: -auc(y, np.round(p, 9))}[metric]()


def brute(x, y, fold, metric, wanted):
    """Fits on rows, not on sums of moments over tasks."""
    moments = lambda at: np.column_stack([np.ones(at.sum()), x[at], y[at]]).T @ np.column_stack([np.ones(at.sum()), x[at], y[at]])
    scale, out = spreads(moments(fold >= 0)), []
    for p in wanted:
        losses = []
        for f in np.unique(fold):
            g = moments(fold != f)
            cov, xy, _, _ = centred(g, scale)
            w = raw_coefficients(g, scale, descend(cov, xy, 10 ** p["log_alpha"], p["l1_ratio"], np.zeros(x.shape[1])))
            losses.append(direct(metric, y[fold == f], w[0] + x[fold == f] @ w[1:]))
        out.append(np.mean(losses))
    return out


@pytest.mark.parametrize("metric", ["rmse", "mse", "mae", "r2"])
def test_losses_of_a_generation(spark, metric):
    x, y, fold = rows()
    got = S.elastic_net_losses(frame(spark, x, y, fold), "fold", "x", "y", metric)(WANTED)
    np.testing.assert_allclose(got, brute(x, y, fold, metric, WANTED), rtol=1e-8)


def test_ranked_losses_of_a_generation(spark):
    x, y, fold = rows()
    label = (y > 0).astype(float)
    got = S.elastic_net_losses(frame(spark, x, label, fold), "fold", "x", "y", "roc_auc")(WANTED)
    np.testing.assert_allclose(got, brute(x, label, fold, "roc_auc", WANTED), rtol=1e-8)
    assert got[3] == -0.5  # the penalty leaves a constant, so all scores tie


def test_undefined_losses_rank_last(spark):
    """A constant prediction has no correlation; a fold of one class has no ROC-AUC."""
    x, y, fold = rows()
    got = S.elastic_net_losses(frame(spark, x, y, fold), "fold", "x", "y", "pearson")(WANTED)
    assert got[3] == float("inf")
    np.testing.assert_allclose(got[:3], brute(x, y, fold, "pearson", WANTED[:3]), rtol=1e-8)
    one_class = S.elastic_net_losses(frame(spark, x, np.where(fold == 0, 1.0, y > 0), fold), "fold", "x", "y", "roc_auc")
    assert one_class(WANTED[:1]) == [float("inf")]


def test_search_scores_each_individual_once(spark):
    asked = []

    def losses(individuals):
        asked.extend(str(i) for i in individuals)
        return [abs(i["a"] - 3) + i["b"] for i in individuals]
    h = S.generations(spark, losses, {"a": ("int", (0, 9)), "b": ("choice", (0.0, 0.5))}, 8, 6).toPandas()
    assert len(asked) == len(set(asked)) and len(h) == 48
    best = h.groupby("generation").loss.min()
    assert best.is_monotonic_decreasing and best.iloc[-1] == 0.0
    assert (h.sort_values(["generation", "place"]).groupby("generation").loss.apply(lambda s: s.is_monotonic_increasing)).all()


def test_search_finds_the_small_penalty(spark):
    x, y, fold = rows()
    df = frame(spark, x, y, fold).unionByName(frame(spark, x[:5], 100 * y[:5], fold[:5]).replace("train", "test", "split"))
    h = S.evolve_elastic_net(df, "fold", "x", "y", "rmse", population=6, generations=3).toPandas()
    best = h[h.place == 0].set_index("generation").loss
    assert best[2] <= best[0] <= brute(x, y, fold, "rmse", [{"log_alpha": 0.0, "l1_ratio": 1.0}])[0]


def test_unknown_metric(spark):
    with pytest.raises(ValueError, match="unknown metric"):
        S.elastic_net_losses(frame(spark, *rows()), "fold", "x", "y", "f1")


def test_one_fold_raises(spark):
    x, y, fold = rows()
    with pytest.raises(ValueError, match="two folds"):
        S.elastic_net_losses(frame(spark, x, y, 0 * fold), "fold", "x", "y")
