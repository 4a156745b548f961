"""Fusion, stacking, neighbours, domain and statistics against brute force in numpy."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.operators import domain as D
from evalspark.operators import ensemble as E
from evalspark.operators import features as X
from evalspark.operators import fusion as U
from evalspark.operators import linear as L
from evalspark.operators import neighbours as N
from evalspark.operators import stats as Z
from evalspark.session import durable


@pytest.fixture(scope="module")
def pred(spark):
    rng = np.random.default_rng(3)
    rows = []
    for ds in ("a", "b"):
        y = rng.normal(size=80)
        for m, noise in (("m1", 0.3), ("m2", 0.5), ("m3", 0.9)):
            p = np.round(y + rng.normal(scale=noise, size=80), 1)
            rows += [(ds, m, "train" if i < 60 else "test", i, float(y[i]), float(p[i]), i % 4) for i in range(80)]
    pdf = pd.DataFrame(rows, columns=["dataset", "model", "split", "row_id", "observed", "predicted", "fold"])
    return pdf, spark.createDataFrame(pdf)


def brute_fusion(g, metric):
    """All candidates of one dataset by direct evaluation on the train matrix."""
    w = g[g.split == "train"].pivot(index="row_id", columns="model", values="predicted")
    y = g[g.split == "train"].groupby("row_id")["observed"].first().to_numpy()
    mat, names = w.to_numpy(), list(w.columns)
    loss = {"rmse": lambda p: math.sqrt(np.mean((y - p) ** 2)), "mae": lambda p: np.mean(np.abs(y - p))}[metric]
    base = np.array([loss(mat[:, i]) for i in range(len(names))])
    z = np.sort(mat, axis=0)
    z = (z - z.min(0)) / (z.max(0) - z.min(0))
    cd = ((z[:, :, None] - z[:, None, :]) ** 2).mean(0)
    div = cd.sum(1) / (len(names) - 1)
    ranks = w.rank(ascending=False).to_numpy()
    out = {}
    for k in (2, 3):
        for sub in itertools.combinations(range(3), k):
            idx = list(sub)
            for v, raw in (("ac", np.ones(k)), ("wcp", 1 / base[idx]), ("wcds", div[idx])):
                wt = raw / raw.sum()
                key = "|".join(names[i] for i in idx)
                out[key, f"score_{v}"] = loss(mat[:, idx] @ wt)
                s = -(ranks[:, idx] @ wt)
                slope = np.cov(s, y, bias=True)[0, 1] / s.var()
                value = loss(slope * s + y.mean() - slope * s.mean())
                out[key, f"rank_{v}"] = value
    return out, base, div


@pytest.mark.parametrize("metric", ["rmse", "mae"])
def test_fusion_candidates_match_brute_force(pred, metric):
    pdf, df = pred
    cand, base = U.candidate_table(df, ["dataset"], ["row_id"], metric, rows_per_bucket=20)
    got, strengths = cand.toPandas(), base.toPandas()
    assert len(got) == 2 * 6 * U.subset_count(3)
    for ds, g in pdf.groupby("dataset"):
        want, b, div = brute_fusion(g, metric)
        mine = got[got.dataset == ds].set_index(["models", "variant"]).train_metric
        for key, value in want.items():
            assert abs(mine[key] - value) < 1e-9, key
        s = strengths[strengths.dataset == ds].sort_values("model")
        np.testing.assert_allclose(s.train_metric, b)
        np.testing.assert_allclose(s.diversity_strength, div)
        np.testing.assert_allclose(s.performance_strength, 1 / b)


def test_fusion_winner_predictions(pred):
    pdf, df = pred
    t = durable(U.fusion_table(df, ["dataset"], ["row_id"]))
    cand, _ = U.candidate_table(df, ["dataset"], ["row_id"], "rmse", table=t)
    best = durable(U.choose(cand, ["dataset"]))
    out = U.fuse(t, best, ["dataset"], ["row_id"]).toPandas()
    b = best.toPandas().set_index("dataset")
    for ds, g in out[out.split == "train"].groupby("dataset"):
        assert abs(math.sqrt(np.mean((g.observed - g.predicted) ** 2)) - b.train_metric[ds]) < 1e-9
    assert len(out) == 160


def test_subset_budget():
    assert U.subset_count(5) == 26 and U.subset_count(0) == 0
    assert U.max_models_for_budget(10, 2, None, 200) == (3, 165)
    assert U.max_models_for_budget(4, 2, None, 1) == (2, 6)


def test_subsets_of_many_models(spark):
    rows = [("d", i, f"m{i:02d}", 1.0 + i, 2.0) for i in range(40)]
    s = spark.createDataFrame(rows, "dataset string, idx int, model string, performance_strength double, diversity_strength double")
    got = U.subset_weights(s, ["dataset"], 2, 2).where("variant = 'wcp'").toPandas()
    assert len(got) == math.comb(40, 2) and got["mask"].nunique() == len(got)
    for mask, names, w in got[["mask", "models", "weights"]].itertuples(index=False):
        inside = [i for i in range(40) if mask >> i & 1]
        assert names == "|".join(f"m{i:02d}" for i in inside)
        np.testing.assert_allclose([w[i] for i in inside], [(1 + i) / sum(1 + j for j in inside) for i in inside])


def test_unknown_fusion_metric_raises(pred):
    with pytest.raises(ValueError):
        U.candidate_table(pred[1], ["dataset"], ["row_id"], "f1")


def test_penalty_is_chosen_without_the_left_out_fold(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    y = x @ np.array([1.0, -1.0]) + rng.normal(size=40)
    rows = [("k", i % 4, x[i].tolist(), float(y[i])) for i in range(40)]
    alphas = (0.01, 1.0, 100.0)
    df = spark.createDataFrame(rows, "k string, f long, features array<double>, y double")
    got = L.fold_coefficients(df, ["k"], "f", "features", "y", alphas).toPandas().set_index("fold")
    full = np.column_stack([np.ones(40), x, y])
    gram = {f: full[f::4].T @ full[f::4] for f in range(4)}
    for left_out in (-1, 0, 1, 2, 3):
        used = [gram[f] for f in range(4) if f != left_out]
        assert got.alpha[left_out] == L.pick_alpha(used, alphas)
        np.testing.assert_allclose(got.coef[left_out], L.solve_ridge(sum(used), got.alpha[left_out]))


def test_stacking_matches_direct_ridge(pred):
    pdf, df = pred
    out, weights = E.stack(df, ["dataset"], ["row_id"], "fold", alphas=(0.5,))
    got = out.toPandas()
    w = weights.toPandas()
    np.testing.assert_allclose(w.groupby("dataset").abs_normalized_contribution.sum(), 1.0)
    for ds, g in pdf.groupby("dataset"):
        x = g.pivot(index="row_id", columns="model", values="predicted")
        y = g.groupby("row_id")["observed"].first()
        fold = g.groupby("row_id").fold.first()
        tr = x.index < 60
        mine = got[got.dataset == ds].set_index("row_id").predicted

        def ridge(mask):
            a, b = x[mask].to_numpy(), y[mask].to_numpy()
            ac, bc = a - a.mean(0), b - b.mean()
            coef = np.linalg.solve(ac.T @ ac + 0.5 * np.eye(3), ac.T @ bc)
            return lambda q: (q - a.mean(0)) @ coef + b.mean()
        np.testing.assert_allclose(mine[60:].sort_index(), ridge(tr)(x[~tr].to_numpy()))
        for f in range(4):
            rows = tr & (fold == f).to_numpy()
            np.testing.assert_allclose(mine[x.index[rows]], ridge(tr & (fold != f).to_numpy())(x[rows].to_numpy()))


def test_inverse_rmse_weights_sum_to_one(pred):
    _, df = pred
    w = E.inverse_error_weights(df, ["dataset"]).toPandas()
    np.testing.assert_allclose(w.groupby("dataset").weight.sum(), 1.0)


def test_member_filter(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=60)
    cols = {"good": y + rng.normal(scale=0.2, size=60), "other": y + rng.normal(scale=0.4, size=60), "bad": -5 * y}
    cols["copy"] = cols["good"] * 1.001 + 0.05
    rows = [("d", m, "train" if i < 40 else "test", i, float(y[i]), float(v[i])) for m, v in cols.items() for i in range(60)]
    df = spark.createDataFrame(rows, "dataset string, model string, split string, row_id int, observed double, predicted double")
    got = E.member_filter(df).toPandas().set_index("model")
    assert got.reason["bad"] == "non_positive_r2" and bool(got.kept["other"])
    err = {m: np.mean((y[40:] - cols[m][40:]) ** 2) for m in ("good", "copy")}
    worse = max(err, key=err.get)
    assert got.reason[worse] == "highly_correlated" and got.kept.sum() == 2


@pytest.mark.parametrize("chunk,block", [(7, 11), (2048, 20000)])
def test_neighbours_are_exact(spark, chunk, block):
    rng = np.random.default_rng(1)
    t = np.vstack([np.repeat(rng.normal(size=(1, 4)), 60, axis=0) + rng.normal(scale=1e-3, size=(60, 4)), rng.normal(size=(90, 4))])
    q = np.vstack([rng.normal(size=(25, 4)), t[:5]])
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    got = N.nearest_neighbours(frame(q), frame(t), "id", "id", "v", 4, n_pivots=6, chunk=chunk, block=block).toPandas()
    dist = np.sqrt(((q[:, None] - t[None]) ** 2).sum(-1))
    for i, g in got.groupby("id"):
        g = g.sort_values("neighbour_rank")
        np.testing.assert_allclose(g.distance, np.sort(dist[i])[:4], atol=1e-12)
    assert len(got) == 30 * 4


def test_domain_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(70, 5)) @ rng.normal(size=(5, 5))
    x[:, 4] = 2.0
    q = rng.normal(size=(9, 5)) * 2
    frame = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, features array<double>")
    ref = D.fit_domain(frame(x), "id")
    out = D.assess_domain(frame(q), ref, "id").toPandas().sort_values("id")
    sd = x.std(0)
    sd[sd == 0] = 1
    z, zq = (x - x.mean(0)) / sd, (q - x.mean(0)) / sd
    dist = np.sort(np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1)), axis=1)[:, 1:6].mean(1)
    assert abs(ref.knn_threshold - np.quantile(dist, 0.95)) < 1e-9
    want = np.sort(np.sqrt(((zq[:, None] - z[None]) ** 2).sum(-1)), axis=1)[:, :5].mean(1)
    np.testing.assert_allclose(out.ad_knn_mean_distance, want)
    n, d = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum() / d
    beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / n**2 / d, delta)
    assert abs(ref.shrinkage - beta / delta) < 1e-9
    inv = np.linalg.pinv((1 - beta / delta) * s + beta / delta * mu * np.eye(d))
    np.testing.assert_allclose(out.ad_mahalanobis_distance, np.einsum("ij,jk,ik->i", zq, inv, zq))


def test_consensus_literal(spark):
    df = spark.createDataFrame([(True, False), (True, True), (False, None)], "a boolean, b boolean")
    got = [(r.ad_consensus_support_ratio, r.ad_consensus_concern) for r in D.with_consensus(df, ["a", "b"]).collect()]
    assert got == [(0.5, "Moderate concern"), (1.0, "Low concern"), (0.0, "High concern")]
    assert D.with_consensus(df, []).first().ad_consensus_concern == "Not assessed"


def test_tail_probabilities():
    assert abs(Z.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(Z.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9
    assert abs(Z.normal_sf(1.6448536269514722) - 0.05) < 1e-9
    for n in (4, 7):
        signs = list(itertools.product([0, 1], repeat=n))
        sums = np.array([sum((i + 1) * s for i, s in enumerate(ss)) for ss in signs])
        for w in (3, 6, 10):
            assert abs(Z.signed_rank_sf(w, n) - (sums >= w).mean()) < 1e-12


def test_friedman_and_wilcoxon(spark):
    rng = np.random.default_rng(8)
    mat = rng.normal(size=(12, 4)) + np.array([0, 0.5, 1.0, 1.5])
    rows = [(f"b{i}", f"m{j}", float(mat[i, j])) for i in range(12) for j in range(4)]
    s = spark.createDataFrame(rows, "block string, model string, score double")
    f = Z.friedman(s, "block", "model").first()
    r = pd.DataFrame(mat).rank(axis=1).to_numpy()
    chi = 12 / (12 * 4 * 5) * (r.sum(0) ** 2).sum() - 3 * 12 * 5
    assert abs(f.statistic - chi) < 1e-9 and abs(f.p_value - Z.chi2_sf(chi, 3)) < 1e-12
    w = Z.wilcoxon_vs_best(s, "block", "model").toPandas().set_index("model")
    best = w.best_model.iloc[0]
    b = int(best[1:])
    for j in set(range(4)) - {b}:
        d = mat[:, j] - mat[:, b]
        stat = pd.Series(np.abs(d)).rank()[d > 0].sum()
        assert abs(w.statistic[f"m{j}"] - stat) < 1e-9
        assert abs(w.raw_p_value[f"m{j}"] - Z.signed_rank_sf(stat, 12)) < 1e-12
    p = np.sort(w.raw_p_value)
    np.testing.assert_allclose(np.sort(w.holm_p_value), np.maximum.accumulate(np.minimum(1, p * np.arange(3, 0, -1))))


def test_ridge_moments():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 3)) + 10, rng.normal(size=50)
    full = np.column_stack([np.ones(50), x, y])
    coef = L.solve_ridge(full.T @ full, 0.0)
    want = np.linalg.lstsq(full[:, :4], y, rcond=None)[0]
    np.testing.assert_allclose(coef, want, rtol=1e-6)
    assert abs(L.squared_error(full.T @ full, want) - ((y - full[:, :4] @ want) ** 2).sum()) < 1e-6


def test_feature_filters(spark):
    rng = np.random.default_rng(0)
    n = 400
    a = rng.normal(size=n)
    cols = [a, np.full(n, 3.0), a.copy(), (np.arange(n) < 1).astype(float), (a > 0).astype(float), a + 1e-9]
    rows = [(i, p, float(c[i])) for p, c in enumerate(cols) for i in range(n)]
    rep = X.filter_report(spark.createDataFrame(rows, "row_id int, pos int, x double")).toPandas().set_index("pos")
    assert rep.reason.fillna("").to_dict() == {0: "", 1: "low_variance", 2: "exact_duplicate", 3: "binary_prevalence", 4: "", 5: ""}
    assert rep.duplicate_of[2] == 0


def test_ngrams_match_python(spark):
    text = "The  quick brown\nfox  jumps the quick brown"
    for n in (1, 2, 3):
        got = spark.createDataFrame([(text,), ("one",)], "t string").select(X.token_ngrams("t", n)).collect()
        w = text.lower().split()
        assert got[0][0] == [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)]
        assert got[1][0] == (["one"] if n == 1 else [])


def test_grouped_stack_uses_groups_where_viable(spark):
    from evalspark.operators.models import grouped_stack
    rng = np.random.default_rng(6)
    rows = []
    for g, n, slope in (("big", 120, 2.0), ("tiny", 12, -3.0)):
        for i in range(n):
            x = float(rng.normal())
            rows.append((f"{g}{i}", g, f"k{i // 2}", "test" if i % 5 == 0 else "train", [x], slope * x))
    df = spark.createDataFrame(rows, "id string, g string, key string, split string, x array<double>, y double")
    pred, plan = grouped_stack(df, "g", "key", "id", "x", "y", max_folds=3, alphas=(1e-6,))
    p, m = pred.toPandas(), plan.toPandas().set_index("g")
    assert m.status["big"] == "trained" and m.status["tiny"] == "fallback_global"
    assert len(p) == 132 and (p[p.g == "big"].group_available == 1).all() and (p[p.g == "tiny"].group_available == 0).all()
    np.testing.assert_allclose(p[p.g == "big"].stack_pred, p[p.g == "big"].observed, atol=1e-3)
    assert (p[p.g == "tiny"].stack_pred == p[p.g == "tiny"].global_pred).all()


def test_evolution_history(spark):
    from pyspark.ml.regression import LinearRegression

    from evalspark.operators.models import as_vectors, evolve
    rng = np.random.default_rng(1)
    rows = [("train", i % 2, rng.normal(size=2).tolist(), float(i % 7)) for i in range(40)]
    df = as_vectors(spark.createDataFrame(rows, "split string, fold int, x array<double>, y double"), "x", "y")
    h = evolve(df, lambda p: LinearRegression(regParam=p["r"]), {"r": ("choice", (0.0, 0.1))}, "fold", 3, 2, 1).toPandas()
    assert len(h) == 6 and h.groupby("params").loss.nunique().max() == 1
    assert h[h.generation == 1].loss.min() <= h[h.generation == 0].loss.min()


def test_model_queries_run_the_whole_job(spark, monkeypatch):
    """K1 and K2 hand over every model with the default number of trees, J5 the full grid, K7 the default search."""
    from evalspark.operators import models as ops
    from evalspark.plans import model_queries as Q

    seen = {}
    monkeypatch.setattr(Q, "vectors", lambda *a: None)
    monkeypatch.setattr(Q, "rounded", lambda df, *a, **k: df)
    monkeypatch.setattr(Q, "reported", lambda spark, d, models, binary: seen.update({binary: models}))
    monkeypatch.setattr(ops, "elastic_net_selection", lambda *a, **k: seen.update(j5=(a[1:], k)))
    monkeypatch.setattr(ops, "evolve", lambda *a, **k: seen.update(k7=(a[3:], k)))
    for build in (Q.k1, Q.k2, Q.j5, Q.k7):
        build(None, None)
    assert set(seen[False]) == set(ops.regression_models()) and set(seen[True]) == set(ops.classification_models(64))
    assert seen[False]["Random Forest"].getNumTrees() == seen[True]["Random Forest"].getNumTrees() == 400
    assert seen["j5"] == (("fold", 3), {}) and seen["k7"] == (("fold",), {})


def test_seed_ensemble_against_weighted_least_squares(spark):
    rng = np.random.default_rng(8)
    rows = []
    for ds in ("a", "b"):
        x = rng.normal(size=(90, 3))
        y = x @ [1.0, -2.0, 0.5] + rng.normal(scale=0.4, size=90)
        rows += [(ds, i, [float(v) for v in x[i]], float(y[i]), i < 70) for i in range(90)]
    rows += [("a", 500, None, 1.0, True), ("a", 501, [1.0, float("nan"), 0.0], 1.0, True), ("lone", 1, [1.0, 2.0, 3.0], None, True)]
    df = spark.createDataFrame(rows, "dataset string, row_id int, features array<double>, y double, train boolean")
    seeds = (3, 11, 40)
    got = {(r.dataset, r.row_id): r for r in E.seed_ensemble(df, ["dataset"], "row_id", "features", "y", F.col("train"), seeds).collect()}
    assert len(got) == len(rows)
    drawn = df.select("row_id", *[E.poisson_weight("row_id", s).alias(str(s)) for s in seeds]).distinct().toPandas().set_index("row_id")
    assert 0.7 < drawn.to_numpy().mean() < 1.3 and (drawn["3"] != drawn["11"]).any()
    for ds in ("a", "b"):
        part = [r for r in rows if r[0] == ds and r[1] < 90]
        x = np.c_[np.ones(90), [r[2] for r in part]]
        y, want = np.array([r[3] for r in part]), 0.0
        for s in seeds:
            w = drawn.loc[range(70), str(s)].to_numpy()
            root = np.sqrt(w)[:, None]
            want = want + x @ np.linalg.lstsq(x[:70] * root, y[:70] * root[:, 0], rcond=None)[0] / len(seeds)
        assert np.allclose([got[ds, i].predicted for i in range(90)], want, atol=1e-9)
        assert got[ds, 0].members == 3
    assert got["a", 500].predicted is None and got["lone", 1].members == 0 and got["lone", 1].predicted is None
    with pytest.raises(ValueError):
        E.seed_ensemble(df, ["dataset"], "row_id", "features", "y", F.col("train"), [])
    assert E.seed_ensemble(df.limit(0), ["dataset"], "row_id", "features", "y", F.col("train"), seeds).count() == 0


def test_domain_metadata(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "features array<double>")
    one = D.domain_metadata(df, k=3, method="knn").first()
    assert (one.n_training_chemicals, one.n_features) == (2, 2)
    assert one.metadata.startswith('{"n_training_chemicals":2,"n_features":2,"knn_neighbors":3,') and one.metadata.endswith('"method":"knn"}')
    assert D.domain_metadata(df.limit(0)).first().n_features == 0
