"""Rules, deduplication, alignment, cache and sources on small fixtures."""

import json
import os

import pytest
from pyspark.sql import functions as F

from evalspark.functions import cleaning as C
from evalspark.functions import columns as K
from evalspark.functions import families
from evalspark.functions import taxonomy as T
from evalspark.operators import joins as J
from evalspark.operators import reports as R
from evalspark.operators import signatures as S
from evalspark.sources import cache, readers, sinks


def values(spark, data, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


def test_numbers_and_tokens(spark):
    got = values(spark, [(" 1.5 ",), ("nan",), ("inf",), ("abc",), (None,), ("-2e3\n",)], "x string", C.to_number("x"), C.null_clean("x"))
    assert got == [(1.5, "1.5"), (None, None), (None, "inf"), (None, "abc"), (None, None), (-2000.0, "-2e3")]
    texts = [(0.0,), (1.5,), (-2.25,), (1e12,), (1e-5,), (100.0,), (0.1 + 0.2,), (float("inf"),), (123456.789,)]
    got = [r[0] for r in values(spark, texts, "x double", C.stable_float_text("x"))]
    assert got == ["nan" if x == float("inf") else f"{x:.12g}" for x, in texts]


def test_missing_value_demo(spark):
    col1, col2 = ["1", "2", "3", "nan", "missing", "4", "5", None], ["1", "nan", "inf", "2", "3", "4", "5", "6"]
    df = spark.createDataFrame([(i, a, b, str(i + 1)) for i, (a, b) in enumerate(zip(col1, col2))], "i int, c1 string, c2 string, c3 string")
    cols = ["c1", "c2", "c3"]
    assert C.drop_missing_rows(df, cols).count() == 3
    assert C.drop_missing_columns(df, cols).columns == ["i", "c3"]
    zero = [tuple(r)[1:] for r in C.fill_missing_zero(df, cols).orderBy("i").collect()]
    assert zero[3] == (0.0, 2.0, 4.0) and zero[1] == (2.0, 0.0, 2.0)
    lin = [r.c1 for r in C.interpolate_linear(df.withColumn("k", F.lit(0)), ["k"], "i", "c1").orderBy("i").collect()]
    assert lin == pytest.approx([1, 2, 3, 10 / 3, 11 / 3, 4, 5, 5])


def test_metric_name_rules(spark):
    names = ["AUROC", "PR-AUC", "root_mean_squared_error", "root mean squared error", "RMSE", "R^2", "odd", ""]
    got = values(spark, [(n,) for n in names], "x string", T.normalize_metric("x"), T.leaderboard_metric_kind("x"),
                 T.metric_lower_is_better("x"))
    assert got == [("roc_auc", "roc_auc", False), ("auprc", "auprc", False), ("mse", "mse", True), ("rmse", "mse", None),
                   ("rmse", "rmse", True), ("r2", "r2", False), ("rmse", "odd", None), ("rmse", None, None)]


def test_column_roles():
    assert K.pick_column(["Dataset", "Test RMSE"], K.REGRESSION_COLUMNS["rmse"]) == "Test RMSE"
    assert K.infer_column(["DRUG", "drug"], ["Drug"]) is None
    assert K.infer_column(["Id", "x", "Y"], ["X"]) == "x"
    assert K.infer_column(["DRUG", "x"], ["Drug", "X"]) == "DRUG"
    assert K.infer_column(["drug", "DRUG", " x "], ["Drug", "X"]) == " x "
    assert K.model_metric_column(["mae", "test_rmse"], "mse") == "test_rmse"


def test_metric_dedupe_is_composite(spark):
    rows = [("d", "m", "w", 0.5, None, "boom", "completed", 1), ("d", "m", "w", 0.9, None, None, "completed", 2),
            ("d", "m", "w", 1.5, 7.0, None, "skipped x", 3)]
    df = spark.createDataFrame(rows, "dataset string, model string, workflow string, test_rmse double, extra double, error string, status string, seq int")
    one = R.dedupe_metric_rows(df, [-F.col("seq")]).first()
    assert (one.test_rmse, one.extra, one.error) == (0.9, 7.0, "boom")
    whole = R.dedupe_metric_rows(df, [-F.col("seq")], composite=False).first()
    assert (whole.test_rmse, whole.extra, whole.error) == (0.9, None, None)
    again = R.dedupe_metric_rows(R.dedupe_metric_rows(df, [-F.col("seq")]), [-F.col("seq")])
    assert again.count() == 1


def test_ablation_fractions(spark):
    rows = [(f"d{i}", "regression", "base", "w", "conventional_ml", 1.0, "lower", 1.0) for i in range(44)]
    rows += [(f"d{i}", "regression", "classic", "w", "maplight_classic", 0.9, "lower", 0.9) for i in range(7)]
    rows += [(f"d{i}", "regression", "deep", "w", "deep_backend", 0.8, "lower", 0.8) for i in range(14)]
    df = spark.createDataFrame(rows, "dataset string, task_kind string, model string, workflow string, component string, analysis_metric_value double, analysis_metric_direction string, comparison_score double")
    s = {r.stage_order: r for r in R.ablation_summary(R.staged_ablation(df, ["dataset"])).collect()}
    assert [round(s[i].improvement_fraction * 44) for i in range(1, 6)] == [0, 7, 14, 0, 0]
    assert s[3].datasets_changed_winner == 14


def test_occurrence_alignment(spark):
    a = spark.createDataFrame([("d", "x", 1), ("d", "y", 2), ("d", "x", 3), ("e", "x", 1)], "ds string, k string, o int")
    b = spark.createDataFrame([("d", "x", 5, 10.0), ("d", "x", 4, 20.0), ("d", "y", 9, 30.0)], "ds string, k string, o int, p double")
    got = {(r.ds, r.o): (r.p, r.aligned) for r in J.occurrence_align(a, b, ["ds"], "k", "o", "p").collect()}
    assert got == {("d", 1): (20.0, True), ("d", 3): (10.0, True), ("d", 2): (30.0, True), ("e", 1): (None, False)}


def test_better_counts_match_brute_force(spark):
    refs = [("k", float(v)) for v in (1, 2, 2, 5, 9)]
    mine = [("k", float(v)) for v in (0, 2, 3, 9, 10)]
    r, m = (spark.createDataFrame(x, "k string, s double") for x in (refs, mine))
    got = {row.s: row.n_better for row in J.better_counts(m, r, ["k"], "s", 2).collect()}
    assert got == {s: sum(v < s for _, v in refs) for _, s in mine}


def test_validated_join_raises(spark):
    a = spark.createDataFrame([(1, 1.0)], "k int, a double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, b double")
    with pytest.raises(ValueError):
        J.validated_join(a, b, ["k"], "a", "b")


def test_signatures(spark):
    import hashlib
    df = spark.createDataFrame([("d", i, f"k{i}") for i in range(10)], "ds string, i int, k string")
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    keys = [f"k{i}" for i in range(10)]
    for size in (3, 4, 100_000):
        blocks = [sha("\n".join(keys[i:i + size])) for i in range(0, 10, size)]
        got = S.ordered_signature(df, ["ds"], "i", {"h": "k"}, rows_per_block=size).first()
        assert got.n_rows == 10 and got.h == sha("\n".join(blocks))
    x = S.order_free_signature(df, ["ds"], [F.col("k")]).first()
    y = S.order_free_signature(df.orderBy(F.desc("i")), ["ds"], [F.col("k")]).first()
    assert x == y


def test_feature_cache_computes_only_missing(spark, tmp_path):
    store = cache.FeatureCache(spark, str(tmp_path), cache.representation_key("len", {"v": 1}))
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "entity_key string")
    compute = lambda df: df.select("entity_key", F.array(F.length("entity_key").cast("float")).alias("features"))
    _, fresh = store.fetch(keys("a", "bb", "a"), compute)
    assert sorted(r[0] for r in fresh.collect()) == ["a", "bb"]
    got, fresh = store.fetch(keys("bb", "ccc", "bb"), compute)
    assert [r[0] for r in fresh.collect()] == ["ccc"]
    assert sorted((r.entity_key, r.features[0]) for r in got.collect()) == [("bb", 2.0), ("bb", 2.0), ("ccc", 3.0)]
    _, fresh = store.fetch(keys("a", "ccc"), compute)
    assert fresh.count() == 0
    with pytest.raises(ValueError):
        store.fetch(keys("z"), lambda df: df.select("entity_key", F.array(F.length("entity_key")).alias("features")))


def test_status_scan_skips_non_objects(spark, tmp_path):
    for name, body in (("a", {"status": "completed", "elapsed_seconds": 3.5}), ("b", [1, 2]), ("c", {"status": "skipped", "dataset": "C"})):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "run_status.json").write_text(json.dumps(body, indent=1))
    got = sorted(tuple(r)[:2] for r in readers.read_run_status(spark, f"{tmp_path}/*/run_status.json").collect())
    assert got == [("C", "skipped"), ("a", "completed")]


def test_stage_sink_latest_wins(spark, tmp_path):
    df = lambda v: spark.createDataFrame([("d", "m", v)], "dataset string, model string, v int")
    sinks.append_stage(str(tmp_path / "s"), df(1), 1)
    sinks.append_stage(str(tmp_path / "s"), df(2), 2)
    assert sinks.read_latest(spark, str(tmp_path / "s"), ["dataset", "model"]).first().v == 2


def keys_frame(spark, *k):
    return spark.createDataFrame([(x,) for x in k], "entity_key string")


def lengths(df):
    return df.select("entity_key", F.array(F.length("entity_key").cast("float")).alias("features"))


def test_cache_keeps_first_copy_and_ignores_uncommitted_shards(spark, tmp_path):
    store = cache.FeatureCache(spark, str(tmp_path), "r", buckets=4)
    store.fetch(keys_frame(spark, "a", "bb"), lengths)
    later = lambda df: df.select("entity_key", F.array(F.lit(99.0).cast("float")).alias("features"))
    store._commit(store._write(later(keys_frame(spark, "a", "ccc"))), lengths(keys_frame(spark, "a")).schema)  # a second writer
    store._write(later(keys_frame(spark, "dddd")))  # its job died before the commit
    got, fresh = store.fetch(keys_frame(spark, "a", "ccc", "dddd", None), lengths)
    assert [r[0] for r in fresh.collect()] == ["dddd"]
    want = {"a": 1.0, "ccc": 99.0, "dddd": 4.0, None: None}
    assert {r.entity_key: r.features and r.features[0] for r in got.collect()} == want


def test_cache_writes_nothing_when_nothing_is_missing(spark, tmp_path):
    store = cache.FeatureCache(spark, str(tmp_path), "r")
    store.fetch(keys_frame(spark, "a", "bb"), lengths)
    before = sorted(p for _, _, files in os.walk(tmp_path) for p in files)
    got, fresh = store.fetch(keys_frame(spark, "bb"), lengths)
    assert fresh.count() == 0 and got.first().features == [2.0]
    assert sorted(p for _, _, files in os.walk(tmp_path) for p in files) == before
    empty, fresh = store.fetch(keys_frame(spark, "a").limit(0), lengths)
    assert empty.count() == 0 and fresh.count() == 0


def test_cache_after_failed_compute_and_compaction(spark, tmp_path):
    store = cache.FeatureCache(spark, str(tmp_path), "r", buckets=4)

    @F.udf("array<float>")
    def broken(key):
        raise ValueError("no features today")

    with pytest.raises(Exception, match="no features today"):
        store.fetch(keys_frame(spark, "a"), lambda df: df.select("entity_key", broken("entity_key").alias("features")))
    assert store.commits() == [] and store.stored() is None and store.compact() is None
    for names in (["a", "bb"], ["bb", "ccc"], ["a", "dddd"]):
        store.fetch(keys_frame(spark, *names), lengths)
    before = sorted(store.stored().collect())
    store.compact()
    assert [c.compacts for c in store.commits()] == [True] and sorted(store.stored().collect()) == before
    _, fresh = store.fetch(keys_frame(spark, "a", "e"), lengths)
    assert [r[0] for r in fresh.collect()] == ["e"] and len(store.commits()) == 2
    with pytest.raises(RuntimeError):
        store._commit("shard=x", store.stored().schema, compacts_after=0)


def test_cache_reads_only_requested_buckets(spark, tmp_path):
    store = cache.FeatureCache(spark, str(tmp_path), "r", buckets=64)
    store.fetch(keys_frame(spark, *[f"k{i}" for i in range(200)]), lengths)
    keys = keys_frame(spark, "k7").withColumn("bucket", store._bucket())
    known = store._known(keys, store.commits())
    plan = known._jdf.queryExecution().executedPlan().toString()
    number = keys.first().bucket
    assert known.count() == 1 and f"= {number})" in plan[plan.index("PartitionFilters"):]


def test_stage_durations_carry_over_buckets(spark):
    rows = [("r", i, i * i * 1_000_000, f"s{i}") for i in range(40)] + [("one", 0, 5, "only"), (None, 1, 3_000_000, "b"), (None, 0, None, "a")]
    df = spark.createDataFrame(rows, "run string, id int, started long, stage string").repartition(5)
    for size in (1, 3, 1_000_000):
        got = {(x.run, x.stage): x for x in R.stage_durations(df, ["run"], ["started", "id"], "started", "stage", size).collect()}
        assert len(got) == len(rows)
        for i in range(39):
            x = got["r", f"s{i}"]
            mean = (i + 1) ** 2 * 1_000_000 // (i + 1) / 1e6
            assert (x.duration_seconds, x.finished, x.remaining, x.status) == (2 * i + 1, i + 1, 39 - i, "completed")
            assert x.mean_seconds == mean and x.eta_seconds == pytest.approx(mean * (39 - i))
        last, only = got["r", "s39"], got["one", "only"]
        assert (last.status, last.duration_seconds, last.finished, last.remaining, last.mean_seconds) == ("running", None, 39, 1, 39.0)
        assert (only.status, only.finished, only.mean_seconds, only.eta_seconds) == ("running", 0, None, None)
        assert got[None, "a"].duration_seconds is None and got[None, "b"].status == "running"


def test_token_estimate(spark):
    sizes = spark.createDataFrame([("none", 0), ("small", 10), ("big", 5_000)], "dataset string, n long")
    got = {x.dataset: x for x in R.token_estimate(sizes, "n", 1_000_000).collect()}
    assert (got["none"].estimated_train_rows, got["none"].estimated_columns) == (1, 32)
    assert got["small"].estimated_tokens == 8 * 32 * 11 and got["small"].fits_daily_budget
    assert got["big"].estimated_tokens == 4_000 * 400 * 11 and not got["big"].fits_daily_budget
    assert R.token_estimate(sizes, "n", 1, max_features=7).first().estimated_columns == 7


def test_reference_run_prefers_runs_with_tuned_rows(spark):
    rows = [("new", "d1", "plain", 9), ("mid", "d1", "GA_tuned ", 5), ("mid", "d2", None, 5), ("old", "d1", "ga_tuned", 1), ("old", "d2", "x", 1)]
    df = spark.createDataFrame(rows, "run_name string, dataset string, workflow string, at int")
    pick = lambda n, d=df: [x.run_name for x in R.reference_run(d, [F.max("at")], n).collect()]
    assert pick(2) == ["mid"] and pick(5) == ["new"] and pick(1, df.limit(0)) == []
    manual = R.resolve_tuned_models(" SVR, KNN,,SVR", df, ["run_name"], [], []).collect()
    assert [x.model for x in manual] == ["SVR", "KNN"] and {x.mode for x in manual} == {"manual"}
    assert R.resolve_tuned_models(None, df, ["run_name"], [], []).count() == 0


def test_feature_families(spark):
    assert families.selected_families(["TT", "morgan", "nothing", " Morgan "], ["maccs", "morgan"]) == ["topological_torsion", "morgan", "maccs"]
    df = spark.createDataFrame([(1, [1.0], [2.0, 3.0]), (2, None, [4.0, 5.0])], "id int, a array<double>, b array<double>")
    got = families.family_columns(df, ["id"], {"x": F.col("a"), "y": F.col("b")}, ["y", "x"]).orderBy("id").collect()
    assert got[0].features == [2.0, 3.0, 1.0] and got[0].widths == {"y": 2, "x": 1} and got[1].features is None
    for chosen in (["z"], []):
        with pytest.raises(ValueError):
            families.family_columns(df, ["id"], {"x": F.col("a")}, chosen)
