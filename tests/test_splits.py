"""Splits: sizes, disjointness, group integrity, and the greedy rules against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.operators import splits as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 700
    pdf = pd.DataFrame({"ds": np.where(np.arange(n) < 500, "hot", "small"), "id": range(n), "y": rng.normal(size=n)})
    pdf["grp"] = np.where(rng.random(n) < 0.3, "third", "g" + pd.Series(rng.zipf(1.4, n) % 90).astype(str))
    pdf["key"] = "k" + pd.Series(rng.integers(0, 300, n)).astype(str)
    return pdf, spark.createDataFrame(pdf)


def test_random_holdout_size_and_order_freedom(data, spark):
    pdf, df = data
    a = S.random_holdout(df, ["ds"], "id", 0.2, rows_per_bucket=40).toPandas()
    b = S.random_holdout(df.repartition(7), ["ds"], "id", 0.2).toPandas()
    assert (a.sort_values("id").split.tolist() == b.sort_values("id").split.tolist())
    assert a[a.split == "test"].groupby("ds").size().to_dict() == {"hot": 100, "small": 40}
    other = S.random_holdout(df, ["ds"], "id", 0.2, seed=1).toPandas().sort_values("id")
    assert other.split.tolist() != a.sort_values("id").split.tolist()


def test_stratified_holdout_and_fallback(data, spark):
    pdf, df = data
    s = S.stratified_holdout(df, ["ds"], "id", "y", 0.2).toPandas()
    share = s.groupby(["ds", "bin"]).split.apply(lambda x: (x == "test").mean())
    assert len(share) == 8 and ((share - 0.2).abs() < 0.03).all()
    flat = S.stratified_holdout(df.withColumn("y", F.lit(1.0)), ["ds"], "id", "y", 0.2).toPandas()
    assert set(flat.split_strategy) == {"random"} and (flat.split == "test").sum() == 140


def test_quartile_bins_match_qcut(data, spark):
    pdf, df = data
    pdf = pdf.assign(y=np.round(pdf.y, 1))
    got = S.quartile_bins(spark.createDataFrame(pdf), ["ds"], "y").toPandas().set_index("id").bin
    for _, g in pdf.groupby("ds"):
        want = pd.qcut(g.y, 4, labels=False, duplicates="drop")
        assert (got[g.id].to_numpy() == want.to_numpy()).all()


def test_hash_split_matches_hashlib(data):
    pdf, df = data
    got = S.hash_split(df, ["ds"], "key", "id", 0.25).toPandas()
    for ds, g in got.groupby("ds"):
        score = g.key.map(lambda k: int(hashlib.sha1(k.encode()).hexdigest()[:12], 16))
        n = int(round(len(g) * 0.25))
        assert (g.split == "test").sum() == n
        assert score[g.split == "test"].min() >= score[g.split == "train"].max()


def greedy_holdout(sizes, fraction):
    n = sum(sizes.values())
    goal, cur, test = min(max(round(n * fraction), 1), n - 1), 0, set()
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        s = sizes[g]
        if cur < goal and (abs(cur + s - goal) <= abs(cur - goal) or cur == 0):
            test.add(g)
            cur += s
    return test


@pytest.mark.parametrize("fraction", [0.05, 0.2, 0.37])
def test_group_holdout_follows_the_greedy_rule(data, fraction):
    _, df = data
    got = S.group_holdout(df, ["ds"], "grp", fraction, rows_per_bucket=30).toPandas()
    for _, g in got.groupby("ds"):
        assert (g.groupby("grp").split.nunique() == 1).all()
        want = greedy_holdout(g.groupby("grp").size().to_dict(), fraction)
        assert set(g[g.split == "test"].grp) == want


def greedy_folds(sizes, k):
    loads, out = [0] * k, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        j = loads.index(min(loads))
        out[g] = j
        loads[j] += sizes[g]
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_group_kfold_follows_the_lightest_fold_rule(data, k):
    _, df = data
    got = S.group_kfold(df, ["ds"], "grp", k, rows_per_bucket=30).toPandas()
    for _, g in got.groupby("ds"):
        want = greedy_folds(g.groupby("grp").size().to_dict(), k)
        assert g.groupby("grp").fold.first().to_dict() == want


def test_random_kfold_balance(data):
    _, df = data
    f = S.random_kfold(df, ["ds"], "id", 3, rows_per_bucket=40).toPandas()
    sizes = f.groupby(["ds", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all() and sizes.shape == (2, 3)
    q = S.stratified_kfold(df, ["ds"], "id", "y", 4).toPandas().groupby(["ds", "bin", "fold"]).size().unstack()
    assert (q.max(axis=1) - q.min(axis=1) <= 1).all()


def test_inner_folds_fall_back(data):
    _, df = data
    one = S.inner_folds(df.withColumn("grp", F.lit("x")), ["ds"], "scaffold", "id", group="grp", folds=3).toPandas()
    assert set(one.cv_strategy) == {"random"} and set(one.fold) == {0, 1, 2}


def test_subgroup_plan(data):
    pdf, df = data
    p = S.subgroup_plan(df, ["grp"], "key", 5).toPandas().set_index("grp")
    for g, part in pdf.groupby("grp"):
        ok = len(part) >= 30 and part.key.nunique() >= 20
        assert (p.status[g] == "trained") == ok and p.oof_folds[g] == (5 if ok else 0)
