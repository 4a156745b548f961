"""Skew-safe order statistics: one group holds most rows, buckets are forced to be small."""

import numpy as np
import pandas as pd
import pytest

from evalspark.operators import metrics as M
from evalspark.operators import ordering as O


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": ["hot"] * 2000 + ["b"] * 60 + ["one"], "id": range(2061)})
    pdf["v"] = np.round(rng.normal(size=len(pdf)), 2)
    pdf["p"] = np.round(pdf.v + rng.normal(size=len(pdf)), 1)
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("rows", [50, 10**6])
def test_ranks_match_pandas(data, rows):
    pdf, df = data
    r = O.ranks(df, ["k"], "v", rows).toPandas()
    m = pdf.merge(r, on=["k", "v"])
    assert len(m) == len(pdf)
    want = pdf.set_index("id").groupby("k").v
    got = m.set_index("id")
    assert (got.rank_avg == want.rank().reindex(got.index)).all()
    assert (got.rank_min == want.rank(method="min").reindex(got.index)).all()


@pytest.mark.parametrize("rows", [50, 10**6])
def test_quantiles_match_numpy(data, rows):
    pdf, df = data
    q = O.quantiles(df, ["k"], "v", [0.0, 0.25, 0.5, 0.975, 1.0], rows_per_bucket=rows).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(q.loc[k, [f"q{i}" for i in range(5)]].astype(float), np.quantile(g.v, [0, 0.25, 0.5, 0.975, 1]))


def test_row_numbers_are_dense_and_ordered(data):
    _, df = data
    n = O.row_numbers(df, ["k"], ["v", "id"], "pos", 50).toPandas().sort_values(["v", "id"])
    for _, g in n.groupby("k"):
        assert g.pos.tolist() == list(range(len(g)))


def test_hot_group_is_cut_into_buckets(data):
    _, df = data
    b = O._bucketed(df, ["k"], ["v", "id"], 50).groupBy("k", "_b").count().toPandas()
    hot = b[b.k == "hot"]["count"]
    assert len(hot) > 10 and hot.max() < 600


def test_running_max_and_neighbours(data, spark):
    pdf, df = data
    got = O.running_max(df, ["k"], ["id"], "v", 50).toPandas().sort_values("id")
    assert np.allclose(got.running_max, pdf.groupby("k", sort=False).v.cummax())
    from evalspark.functions.cleaning import interpolate_linear
    holes = pdf.assign(v=np.where(np.arange(len(pdf)) % 4 == 1, np.nan, pdf.v))
    f = interpolate_linear(spark.createDataFrame(holes), ["k"], "id", "v").toPandas().sort_values("id")
    want = holes.groupby("k", sort=False).v.transform(lambda s: s.interpolate())
    np.testing.assert_allclose(f.v.astype(float), want)


@pytest.mark.parametrize("rows", [50, 10**6])
def test_spearman_and_auc(data, spark, rows):
    pdf, df = data
    s = M.spearman(df, ["k"], "v", "p", rows).toPandas().set_index("k").spearman
    for k in ("hot", "b"):
        g = pdf[pdf.k == k]
        assert abs(s[k] - np.corrcoef(g.v.rank(), g.p.rank())[0, 1]) < 1e-9
    assert pd.isna(s["one"])
    b = pdf.assign(y=(pdf.v > 0.3).astype(float))
    m = M.ranking_metrics(spark.createDataFrame(b), ["k"], "y", "p", rows).toPandas().set_index("k")
    for k in ("hot", "b"):
        g = b[b.k == k]
        pos, neg = g[g.y == 1].p.to_numpy(), g[g.y == 0].p.to_numpy()
        auc = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
        assert abs(m.roc_auc[k] - auc) < 1e-9
    assert pd.isna(m.roc_auc["one"])


def test_auc_is_unchanged_by_monotone_maps(data, spark):
    pdf, _ = data
    b = spark.createDataFrame(pdf[pdf.k == "hot"].assign(y=lambda x: (x.v > 0).astype(float)))
    a = M.ranking_metrics(b, ["k"], "y", "p").first()
    c = M.ranking_metrics(b.selectExpr("k", "y", "p / 10 + 100 AS p"), ["k"], "y", "p").first()
    # scores of 90..110 all pass the clipped sigmoid, so use the unit interval for the second map
    d = M.ranking_metrics(b.selectExpr("k", "y", "(p + 10) / 20 AS p"), ["k"], "y", "p").first()
    assert abs(a.roc_auc - d.roc_auc) < 1e-12 and c.roc_auc is not None


def test_constant_sides_give_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0)], "k string, y double, p double")
    row = M.regression_errors(df, ["k"], "y", "p").first()
    assert row.pearson is None and row.r2 == 0.0
    assert M.spearman(df, ["k"], "y", "p").first().spearman is None


def test_best_and_first_known(spark):
    df = spark.createDataFrame([("a", 2, None, "x"), ("a", 1, None, "y"), ("a", 3, 7, "z")], "k string, o int, v int, t string")
    from pyspark.sql import functions as F
    assert O.best_row(df, ["k"], [F.col("o")]).first().t == "y"
    mixed = O.first_known(df, ["k"], [F.col("o")], ["v", "t"]).first()
    assert (mixed.v, mixed.t) == (7, "y")
    assert O.dedupe(df, ["k"], ["o"], "last").first().t == "z"


def test_known_neighbours_use_frames_that_only_grow(data, spark):
    """A frame up to the end of a block is scanned anew for every row: quadratic in the block."""
    df = spark.range(100).selectExpr("id % 2 AS k", "id", "IF(id % 7 = 0, id * 1.0D, NULL) AS v")
    plan = O.neighbours_known(df, ["k"], "id", "v", 20)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
