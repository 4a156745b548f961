"""Models, ensembles, fusion and paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import ensemble as E
from evalspark.operators import fusion as U
from evalspark.operators import joins as J
from evalspark.operators import linear as L
from evalspark.operators import logistic as C
from evalspark.operators import metrics as M
from evalspark.operators import neighbours as N
from evalspark.operators import ordering as O
from evalspark.operators import reports as R
from evalspark.operators import splits as S
from evalspark.operators import stats as Z
from evalspark.plans import views as V
from evalspark.plans.join_queries import BESTM, VP, best_models
from evalspark.plans.metric_queries import AVG_RANK
from evalspark.plans.registry import query, r, rounded
from evalspark.plans.report_queries import RD, VA
from evalspark.session import durable

DS = ["dataset"]


# --- M: statistics -------------------------------------------------------------------------------------------------

PAIRS = f"""p AS (SELECT a.dataset, a.model AS model_a, b.model AS model_b, a.predicted AS va, b.predicted AS vb FROM v_pred a JOIN v_pred b
 ON a.dataset = b.dataset AND a.row_id = b.row_id AND a.model < b.model AND a.split = 'test' AND b.split = 'test'),
k AS (SELECT dataset, model_a, model_b, {AVG_RANK.format(p='dataset, model_a, model_b', v='va')} AS ra, {AVG_RANK.format(p='dataset, model_a, model_b', v='vb')} AS rb FROM p),
c AS (SELECT dataset, model_a, model_b, corr(ra, rb) AS rho FROM k GROUP BY ALL)"""


def pair_rho(spark, d):
    return durable(Z.pair_spearman(V.v_pred(spark, d).where("split = 'test'"), "dataset", ["row_id"]))


@query("m1_prediction_diversity", f"""WITH {PAIRS}
SELECT dataset, count(*) AS pair_count, round(avg(abs(rho)), 6) AS mean_abs_spearman, round(quantile_cont(abs(rho), 0.5), 6) AS median_abs_spearman,
 round(max(abs(rho)), 6) AS max_abs_spearman, round(1 - quantile_cont(abs(rho), 0.5), 6) AS diversity_index FROM c GROUP BY dataset""", VP)
def m1(spark, d):
    s = Z.diversity_summary(Z.pair_spearman(V.v_pred(spark, d).where("split = 'test'"), "dataset", ["row_id"]), "dataset")
    return rounded(s, "mean_abs_spearman", "median_abs_spearman", "max_abs_spearman", "diversity_index")


@query("m1_pair_summary", f"""WITH {PAIRS}
SELECT concat(model_a, ' / ', model_b) AS pair, count(DISTINCT dataset) AS datasets, round(avg(abs(rho)), 6) AS mean_abs_spearman,
 round(max(abs(rho)), 6) AS max_abs_spearman FROM c GROUP BY ALL""", VP)
def m1b(spark, d):
    s = Z.pair_summary(Z.pair_spearman(V.v_pred(spark, d).where("split = 'test'"), "dataset", ["row_id"]), "dataset")
    return rounded(s, "mean_abs_spearman", "max_abs_spearman")


SCORES = """b AS (SELECT concat(run_name, dataset) AS block, model, 0.75 * ((rank() OVER w + (count(*) OVER (PARTITION BY run_name, dataset, delta) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY run_name, dataset))
 + 0.25 * ((rank() OVER v + (count(*) OVER (PARTITION BY run_name, dataset, elapsed_seconds) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY run_name, dataset)) AS s
 FROM v_analysis WINDOW w AS (PARTITION BY run_name, dataset ORDER BY delta), v AS (PARTITION BY run_name, dataset ORDER BY elapsed_seconds)),
x AS (SELECT block, model, round(avg(s), 9) AS score FROM b GROUP BY ALL),
e AS (SELECT model FROM x GROUP BY model HAVING count(*) >= greatest(5, ceil((SELECT count(DISTINCT block) FROM x) * 0.5))),
y AS (SELECT * FROM x WHERE model IN (SELECT model FROM e)),
z AS (SELECT * FROM y WHERE block IN (SELECT block FROM y GROUP BY block HAVING count(*) = (SELECT count(*) FROM e)))"""


def scores(spark, d):
    c = R.cost_performance(V.v_analysis(spark, d), RD).withColumn("block", F.concat("run_name", "dataset"))
    c = durable(c.groupBy("block", "model").agg(F.round(F.avg("cost_performance_score"), 9).alias("s")))
    return Z.complete_scores(c, "block", "model", "s")


@query("m2_friedman_test", f"""WITH {SCORES},
r AS (SELECT block, model, {AVG_RANK.format(p='block', v='score')} AS rk, count(*) OVER (PARTITION BY block, score) AS t FROM z),
g AS (SELECT model, sum(rk) AS rs, count(*) AS n FROM r GROUP BY model), k AS (SELECT count(*) AS models, max(n) AS blocks, sum(rs * rs) AS ss FROM g)
SELECT blocks, models, round((12.0::DOUBLE / (blocks * models * (models + 1)) * ss - 3 * blocks * (models + 1))
 / (1 - (SELECT sum(t * t - 1) FROM r)::DOUBLE / (blocks * models * (models * models - 1))), 5) AS statistic FROM k""", VA)
def m2(spark, d):
    f = Z.friedman(scores(spark, d), "block", "model")
    return f.select("blocks", "models", r("statistic", 5).alias("statistic"))


@query("m2_friedman_p_value")
def m2b(spark, d):
    return Z.friedman(scores(spark, d), "block", "model").select("blocks", "models", r("p_value", 9).alias("p_value"))


@query("m3_wilcoxon_statistics", f"""WITH {SCORES},
md AS (SELECT model, quantile_cont(score, 0.5) AS m FROM z GROUP BY model), bm AS (SELECT arg_min(model, (m, model)) AS best FROM md),
dd AS (SELECT z.block, z.model, z.score - b.score AS diff FROM z JOIN z b ON b.block = z.block AND b.model = (SELECT best FROM bm) WHERE z.model <> (SELECT best FROM bm)),
q AS (SELECT model, diff, rank() OVER (PARTITION BY model ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY model, abs(diff)) - 1) / 2.0::DOUBLE AS rk FROM dd WHERE diff <> 0)
SELECT dd.model, (SELECT best FROM bm) AS best_model, count(*) AS blocks, round(quantile_cont(diff, 0.5), 6) AS median_delta,
 coalesce((SELECT round(sum(CASE WHEN q.diff > 0 THEN rk ELSE 0 END), 3) FROM q WHERE q.model = dd.model), 0) AS statistic FROM dd GROUP BY dd.model""", VA)
def m3(spark, d):
    w = Z.wilcoxon_vs_best(scores(spark, d), "block", "model")
    return w.select("model", "best_model", "blocks", r("median_delta").alias("median_delta"), r("statistic", 3).alias("statistic"))


@query("m3_wilcoxon_holm_p_values")
def m3b(spark, d):
    w = Z.wilcoxon_vs_best(scores(spark, d), "block", "model")
    return rounded(w.select("model", "tail_method", "raw_p_value", "holm_p_value", "significantly_worse"), "raw_p_value", "holm_p_value", digits=9)


DESC = """f AS (SELECT CAST(c_custkey AS VARCHAR) AS k, CAST(c_nationkey AS DOUBLE) AS nation, c_acctbal AS balance, o.n AS orders, o.total, o.biggest FROM customer
 JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n, sum(o_totalprice) AS total, max(o_totalprice) AS biggest FROM orders GROUP BY 1) o ON o_custkey = c_custkey),
a AS (SELECT k, descriptor, x FROM f UNPIVOT (x FOR descriptor IN (nation, balance, orders))), b AS (SELECT k, outcome, y FROM f UNPIVOT (y FOR outcome IN (total, biggest))),
j AS (SELECT * FROM a JOIN b USING (k)),
rk AS (SELECT *, rank() OVER (PARTITION BY descriptor, outcome ORDER BY x) + (count(*) OVER (PARTITION BY descriptor, outcome, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY descriptor, outcome ORDER BY y) + (count(*) OVER (PARTITION BY descriptor, outcome, y) - 1) / 2.0 AS ry FROM j)"""


@query("m4_descriptor_outcome_correlations", f"""WITH {DESC}
SELECT descriptor, outcome, count(*) AS datasets, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM rk GROUP BY ALL HAVING count(*) >= 4""")
def m4(spark, d):
    o = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("biggest"))
    c = V.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    t = Z.correlation_table(c.join(o, "c_custkey"), "c_custkey", ["nation", "balance", "orders"], ["total", "biggest"])
    return rounded(t, "pearson", "spearman")


@query("m5_log_log_scaling_fit", """
SELECT event_type AS dataset, count(*) AS n_rows, round(regr_slope(log10(value), log10(user_id)), 6) AS slope, round(regr_intercept(log10(value), log10(user_id)), 6) AS intercept,
 round(corr(log10(value), log10(user_id)), 6) AS correlation FROM events WHERE value > 0 AND user_id > 0 GROUP BY event_type HAVING count(*) >= 3""")
def m5(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("dataset"), "user_id", "value")
    return rounded(Z.log_log_fit(e, DS, "user_id", "value"), "slope", "intercept", "correlation")


@query("m6_size_quartiles", """
WITH s AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1), q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.5) AS b, quantile_cont(n, 0.75) AS c FROM s)
SELECT CASE WHEN n <= a THEN 0 WHEN n <= b THEN 1 WHEN n <= c THEN 2 ELSE 3 END AS size_quartile, count(*) AS n_datasets, min(n) AS low, max(n) AS high FROM s CROSS JOIN q GROUP BY 1""")
def m6(spark, d):
    s = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("_all", F.lit(0))
    q = S.quartile_bins(s, ["_all"], "n", "size_quartile")
    return q.groupBy("size_quartile").agg(F.count(F.lit(1)).alias("n_datasets"), F.min("n").alias("low"), F.max("n").alias("high"))


EFF = """b AS (SELECT *, (rank() OVER w + (count(*) OVER (PARTITION BY run_name, dataset, delta) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY run_name, dataset) AS pp,
 (rank() OVER v + (count(*) OVER (PARTITION BY run_name, dataset, elapsed_seconds) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY run_name, dataset) AS rp
 FROM v_analysis WINDOW w AS (PARTITION BY run_name, dataset ORDER BY delta), v AS (PARTITION BY run_name, dataset ORDER BY elapsed_seconds)),
g AS (SELECT model, workflow, count(DISTINCT dataset) AS datasets, round(quantile_cont(0.75 * pp + 0.25 * rp, 0.5), 6) AS median_score, round(avg(0.75 * pp + 0.25 * rp), 6) AS mean_score,
 round(quantile_cont(delta, 0.5), 6) AS median_delta, quantile_cont(elapsed_seconds, 0.5) AS median_seconds FROM b GROUP BY model, workflow)"""


def effectiveness(spark, d):
    c = R.cost_performance(V.v_analysis(spark, d), RD)
    return c.groupBy("model", "workflow").agg(
        F.count_distinct("dataset").alias("datasets"), r(R.median("cost_performance_score")).alias("median_score"),
        r(F.avg("cost_performance_score")).alias("mean_score"), r(R.median("analysis_delta_from_best")).alias("median_delta"),
        R.median("elapsed_seconds").alias("median_seconds"))


@query("m7_cost_performance_summary", f"WITH {EFF} SELECT * FROM g", VA)
def m7(spark, d):
    return effectiveness(spark, d)


@query("m8_best_single_model", f"WITH {EFF} SELECT * FROM g ORDER BY median_score, median_delta, median_seconds, model LIMIT 1", VA)
def m8(spark, d):
    return effectiveness(spark, d).orderBy("median_score", "median_delta", "median_seconds", "model").limit(1)


@query("m9_actual_vs_predicted_extract", f"""WITH {BESTM},
k AS (SELECT p.dataset, p.model, p.row_id, p.observed, p.predicted, row_number() OVER (PARTITION BY p.dataset ORDER BY
 CAST('0x' || substr(sha1(concat('11:', CAST(p.row_id AS VARCHAR))), 1, 12) AS BIGINT), p.row_id) AS rn FROM v_pred p JOIN b ON b.dataset = p.dataset AND b.model = p.model WHERE p.split = 'test')
SELECT dataset, model, row_id, observed, round(predicted, 6) AS predicted FROM k WHERE rn <= 100""", VP)
def m9(spark, d):
    p = V.v_pred(spark, d).where("split = 'test'").join(best_models(spark, d), ["dataset", "model"])
    s = S.seeded_sample(p, DS, "row_id", 100, 11)
    return s.select("dataset", "model", "row_id", "observed", r("predicted").alias("predicted"))


# --- K: ensembles ----------------------------------------------------------------------------------------------------

@query("k3_knn_predictor", """
WITH z AS (SELECT a.vec_id, b.vec_id AS tid, b.label AS y, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.label < 2 AND b.label >= 2), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, tid) AS rk FROM z)
SELECT vec_id, round(coalesce(avg(y) FILTER (d = 0), sum(y / nullif(d, 0)) / sum(1 / nullif(d, 0))), 6) AS predicted FROM o WHERE rk <= 15 GROUP BY vec_id""")
def k3(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("features"))
    train = e.where("label >= 2")
    return rounded(N.knn_predict(e.where("label < 2"), train, "vec_id", "vec_id", "features", "label", N.adaptive_k(1000)), "predicted")


@query("k4_voting_average", """
SELECT dataset, split, row_id, count(*) AS members, min(observed) AS observed, round(avg(predicted), 6) AS predicted FROM v_pred GROUP BY ALL""", VP)
def k4(spark, d):
    return rounded(E.average(V.v_pred(spark, d), ["dataset", "split", "row_id"]), "predicted")


SEEDS = (0, 1, 2)


@query("k9_seed_ensemble", """
WITH b AS (SELECT dataset, row_id, observed, predicted AS x, split FROM v_pred WHERE model = 'm_k'),
u AS (SELECT b.*, seed, ('0x' || substr(sha1(concat(seed, ':', row_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM b CROSS JOIN (VALUES (0), (1), (2)) t(seed) WHERE split = 'train'),
steps AS (SELECT i, sum(exp(-1::DOUBLE) / factorial(i)::DOUBLE) OVER (ORDER BY i) AS c FROM (SELECT unnest(range(12))::INT AS i)),
w AS (SELECT u.*, (SELECT count(*) FROM steps WHERE u.u >= c)::DOUBLE AS w FROM u),
s AS (SELECT dataset, seed, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * observed) / sum(w) AS my FROM w GROUP BY ALL HAVING sum(w) > 0),
f AS (SELECT w.dataset, w.seed, coalesce(sum(w * (x - mx) * (observed - my)) / nullif(sum(w * (x - mx) ** 2), 0), 0) AS slope, any_value(mx) AS mx, any_value(my) AS my
 FROM w JOIN s ON s.dataset = w.dataset AND s.seed = w.seed GROUP BY ALL)
SELECT b.dataset, row_id, count(*) AS members, min(observed) AS observed, round(avg(my + slope * (x - mx)), 4) AS predicted
FROM b JOIN f ON f.dataset = b.dataset GROUP BY b.dataset, row_id""", VP)
def k9(spark, d):
    """A model per seed on its own bootstrap of the train rows; the SQL solves the normal equations of one feature."""
    p = V.v_pred(spark, d).where("model = 'm_k'").withColumn("features", F.array(F.col("predicted"))).drop("predicted")
    out = E.seed_ensemble(p, DS, "row_id", "features", "observed", F.col("split") == "train", SEEDS)
    return rounded(out.select("dataset", "row_id", "members", "observed", "predicted"), "predicted", digits=4)


@query("k8_tuned_models_from_reference", """
WITH runs AS (SELECT run_name, count(DISTINCT dataset) AS ds, count(*) FILTER (workflow = 'ga_tuned') AS ga, max(last_order) AS newest FROM v_metrics GROUP BY run_name),
ref AS (SELECT run_name FROM runs ORDER BY (ds >= 5 AND ga > 0) DESC, newest DESC, run_name DESC LIMIT 1),
ok AS (SELECT v.*, CASE WHEN primary_metric = 'RMSE' THEN primary_metric_value ELSE -primary_metric_value END AS s FROM v_metrics v JOIN ref ON v.run_name = ref.run_name
  WHERE error IS NULL OR error = 'nan'),
o AS (SELECT *, row_number() OVER (PARTITION BY run_name, dataset ORDER BY s, model, attempt) AS rn FROM ok),
w AS (SELECT DISTINCT replace(model, ' GA', '') AS model FROM o WHERE rn = 1 AND workflow = 'ga_tuned'),
b AS (SELECT dataset, model, min(s) AS bs FROM ok GROUP BY ALL),
i AS (SELECT DISTINCT b.model FROM ok g JOIN b ON g.dataset = b.dataset AND replace(g.model, ' GA', '') = b.model
  WHERE g.workflow = 'ga_tuned' AND bs - s > 0 AND (bs - s) / abs(bs) >= 0.005)
SELECT model, 'auto' AS mode, run_name AS reference_run FROM (SELECT * FROM w UNION SELECT * FROM i) m CROSS JOIN ref""", ("v_metrics",))
def k8(spark, d):
    m = durable(V.v_metrics(spark, d))  # a row per run, dataset, model and attempt; several steps read it
    return R.resolve_tuned_models("auto", m, RD, [F.col("model"), F.col("attempt")], [F.max("last_order")])


@query("k10_member_filter", """
WITH u AS (SELECT dataset, model, split, observed, predicted FROM v_pred
 UNION ALL SELECT dataset, 'm_lin2', split, observed, predicted * 1.5 FROM v_pred WHERE model = 'm_lin'
 UNION ALL SELECT dataset, 'm_near', split, observed, predicted + 3 * (CAST('0x' || substr(sha1(CAST(row_id AS VARCHAR)), 1, 4) AS BIGINT) % 41 - 20)::DOUBLE FROM v_pred WHERE model = 'm_lin'),
s AS (SELECT dataset, model, 1 - sum((observed - predicted) ** 2) / (var_pop(observed) * count(*)) AS r2, sqrt(avg((observed - predicted) ** 2)) AS e FROM u WHERE split = 'test' GROUP BY ALL),
g AS (SELECT *, count(*) FILTER (r2 > 0) OVER w >= 2 AS use_r2, max(e) FILTER (model IN ('m_lin', 'm_lin2')) OVER w AS worse FROM s WINDOW w AS (PARTITION BY dataset)),
a AS (SELECT *, r2 > 0 OR NOT use_r2 AS active FROM g),
c AS (SELECT *, count(*) FILTER (active) OVER w > 2 AND count(*) FILTER (active AND model IN ('m_lin', 'm_lin2')) OVER w = 2 AND model IN ('m_lin', 'm_lin2') AND e = worse AS alike
 FROM a WINDOW w AS (PARTITION BY dataset))
SELECT dataset, model, active AND NOT alike AS kept, CASE WHEN NOT active THEN 'non_positive_r2' WHEN alike THEN 'highly_correlated' END AS reason FROM c""", VP)
def k10(spark, d):
    p = V.v_pred(spark, d)
    lin = p.where("model = 'm_lin'")
    noise = 3.0 * (F.conv(F.substring(F.sha1(F.col("row_id").cast("string")), 1, 4), 16, 10).cast("long") % 41 - 20)
    extra = lin.withColumns({"model": F.lit("m_lin2"), "predicted": F.col("predicted") * 1.5}).unionByName(
        lin.withColumns({"model": F.lit("m_near"), "predicted": F.col("predicted") + noise}))
    return E.member_filter(p.unionByName(extra))


@query("k11_inverse_rmse_weights", """
WITH n AS (SELECT dataset, count(DISTINCT model) AS k FROM v_pred GROUP BY dataset),
f AS (SELECT p.dataset, row_id FROM v_pred p JOIN n ON n.dataset = p.dataset GROUP BY p.dataset, row_id HAVING count(*) = max(k)),
a AS (SELECT p.* FROM v_pred p JOIN f ON f.dataset = p.dataset AND f.row_id = p.row_id),
e AS (SELECT dataset, model, 1 / greatest(sqrt(avg((observed - predicted) ** 2)), 1e-8) AS w FROM a WHERE split = 'train' GROUP BY ALL),
g AS (SELECT dataset, model, w / sum(w) OVER (PARTITION BY dataset) AS weight FROM e)
SELECT p.dataset, p.row_id, min(observed) AS observed, round(sum(weight * predicted), 6) AS predicted FROM a p JOIN g ON g.dataset = p.dataset AND g.model = p.model GROUP BY p.dataset, p.row_id""", VP)
def k11(spark, d):
    p = E.aligned_rows(V.v_pred(spark, d), DS, ["row_id"])
    return rounded(E.weighted_average(p, E.inverse_error_weights(p, DS), DS, ["row_id"]), "predicted")


def with_folds(spark, d):
    p = V.v_pred(spark, d)
    rows = p.where("split = 'train'").select("dataset", "row_id").distinct()
    f = S.random_kfold(rows, DS, "row_id", 5).select("dataset", "row_id", "fold")
    return O.key_join(p, f, ["dataset", "row_id"], "left")


@query("k12_out_of_fold_stacking")
def k12(spark, d):
    pred, _ = E.stack(with_folds(spark, d), DS, ["row_id"], "fold")
    e = M.regression_errors(pred, ["dataset", "split"])
    return rounded(e.select("dataset", "split", "n_rows", "rmse", "r2"), "rmse", "r2", digits=4)


@query("k12_stacking_weights")
def k12b(spark, d):
    _, w = E.stack(with_folds(spark, d), DS, ["row_id"], "fold")
    return rounded(w.drop("alpha"), "weight", "abs_normalized_contribution", digits=4)


NEWTON_STEPS = 12


def newton_sql(steps: int) -> str:
    """Newton steps of the penalised log loss with two members and an intercept, for every dataset and fold left out (-1: none)."""
    det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
    adj = [["h11 * h22 - h12 * h12", "h02 * h12 - h01 * h22", "h01 * h12 - h02 * h11"], ["h02 * h12 - h01 * h22", "h00 * h22 - h02 * h02", "h01 * h02 - h00 * h12"],
           ["h01 * h12 - h02 * h11", "h01 * h02 - h00 * h12", "h00 * h11 - h01 * h01"]]
    out = ["c0 AS (SELECT dataset, fit, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM (SELECT dataset, folds FROM plan WHERE method <> 'average') p, LATERAL (SELECT unnest(range(-1, folds)) AS fit))"]
    x = ["1.0::DOUBLE", "f1", "f2"]
    for k in range(steps):
        sums = ", ".join(f"sum(p * (1 - p) * {x[i]} * {x[j]}) + {int(i == j)} AS h{i}{j}" for i in range(3) for j in range(i, 3))
        grads = ", ".join(f"sum((p - y) * {x[i]}) + min(w{i}) AS g{i}" for i in range(3))
        out.append(f"""s{k} AS MATERIALIZED (SELECT dataset, fit, min(w0) AS w0, min(w1) AS w1, min(w2) AS w2, {sums}, {grads}
 FROM (SELECT c.*, y, f1, f2, 1 / (1 + exp(-(w0 + w1 * f1 + w2 * f2))) AS p FROM fitted t JOIN c{k} c ON c.dataset = t.dataset AND c.fit <> t.fold) GROUP BY dataset, fit)""")
        moved = ", ".join(f"w{i} - ({' + '.join(f'({adj[i][j]}) * g{j}' for j in range(3))}) / {det} AS w{i}" for i in range(3))
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT dataset, fit, {moved} FROM s{k})")
    return ",\n".join(out)


CLASS_STACK_SQL = f"""b AS (SELECT *, CASE WHEN row_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM v_binary),
x AS (SELECT dataset, split, row_id, min(observed) AS observed, max(predicted) FILTER (model = 'raw') AS f1, max(predicted) FILTER (model = 'unit') AS f2 FROM b GROUP BY ALL),
n AS (SELECT dataset, count(DISTINCT observed) AS classes, max(observed) AS high, count_if(observed = (SELECT max(observed) FROM x)) AS ones, count(*) AS rows_n FROM x WHERE split = 'train' GROUP BY dataset),
plan AS (SELECT *, CASE WHEN classes <> 2 THEN 'average' WHEN least(ones, rows_n - ones) < 2 THEN 'no_folds' ELSE 'out_of_fold' END AS method,
 CASE WHEN classes = 2 AND least(ones, rows_n - ones) >= 2 THEN CAST(least(5, ones, rows_n - ones) AS BIGINT) ELSE 0::BIGINT END AS folds FROM n),
fitted AS MATERIALIZED (SELECT x.*, plan.method, CAST(observed = high AS INTEGER) AS y, CASE WHEN folds = 0 THEN -2 ELSE (row_number() OVER (PARTITION BY x.dataset ORDER BY observed,
 CAST('0x' || substr(sha1(concat('42:', CAST(row_id AS VARCHAR))), 1, 12) AS BIGINT), row_id) - 1) % greatest(folds, 1) END AS fold FROM x JOIN plan ON plan.dataset = x.dataset WHERE split = 'train' AND method <> 'average'),
{newton_sql(NEWTON_STEPS)}"""
VB = ("v_binary",)


def class_stacked(spark, d):
    p = V.v_binary(spark, d).withColumn("split", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))
    return C.class_stack(p, DS, "row_id")


@query("k12_class_stacking", f"""WITH {CLASS_STACK_SQL},
p AS (SELECT t.dataset, split, row_id, observed, 1 / (1 + exp(-(w0 + w1 * f1 + w2 * f2))) AS predicted, method FROM fitted t JOIN c{NEWTON_STEPS} c ON c.dataset = t.dataset AND c.fit = greatest(t.fold, -1)
UNION ALL SELECT x.dataset, split, row_id, observed, 1 / (1 + exp(-(w0 + w1 * f1 + w2 * f2))), method FROM x JOIN plan ON plan.dataset = x.dataset JOIN c{NEWTON_STEPS} c ON c.dataset = x.dataset AND c.fit = -1 WHERE split = 'test'
UNION ALL SELECT x.dataset, split, row_id, observed, (f1 + f2) / 2, method FROM x JOIN plan ON plan.dataset = x.dataset WHERE method = 'average')
SELECT dataset, split, row_id, observed, round(predicted, 6) AS predicted, method FROM p""", VB)
def k12c(spark, d):
    """Labels from two scores: logistic meta model, stratified out-of-fold probabilities."""
    return rounded(class_stacked(spark, d)[0], "predicted")


@query("k12_class_stacking_weights", f"""WITH {CLASS_STACK_SQL},
w AS (SELECT p.dataset, method, CAST(folds AS BIGINT) AS folds, CASE WHEN method = 'average' THEN 0.5::DOUBLE ELSE w1 END AS w1, CASE WHEN method = 'average' THEN 0.5::DOUBLE ELSE w2 END AS w2
 FROM plan p LEFT JOIN (SELECT * FROM c{NEWTON_STEPS} WHERE fit = -1) c ON c.dataset = p.dataset),
l AS (SELECT *, 'raw' AS model, w1 AS weight FROM w UNION ALL SELECT *, 'unit', w2 FROM w)
SELECT dataset, method, folds, model, round(weight, 6) AS weight, round(abs(weight) / (abs(w1) + abs(w2)), 6) AS abs_normalized_contribution FROM l""", VB)
def k12d(spark, d):
    return rounded(class_stacked(spark, d)[1], "weight", "abs_normalized_contribution")


FUSION_SQL = f"""c AS (SELECT dataset, split, row_id FROM v_pred GROUP BY ALL HAVING count(*) = 3),
t AS (SELECT p.* FROM v_pred p JOIN c USING (dataset, split, row_id)),
l AS (SELECT dataset, model, sqrt(avg((observed - predicted) ** 2)) AS loss FROM t WHERE split = 'train' GROUP BY ALL),
o AS (SELECT dataset, model, (predicted - min(predicted) OVER w) / (max(predicted) OVER w - min(predicted) OVER w) AS z,
  row_number() OVER (PARTITION BY dataset, model ORDER BY predicted, row_id) AS i FROM t WHERE split = 'train' WINDOW w AS (PARTITION BY dataset, model)),
v AS (SELECT a.dataset, a.model, avg((a.z - b.z) ** 2) AS cd FROM o a JOIN o b ON a.dataset = b.dataset AND a.i = b.i AND a.model <> b.model GROUP BY a.dataset, a.model)"""


@query("k13_base_strengths", f"""WITH {FUSION_SQL}
SELECT l.dataset, l.model, round(loss, 6) AS train_metric, round(1 / greatest(loss, 1e-12), 8) AS performance_strength, round(cd, 8) AS diversity_strength
FROM l JOIN v ON l.dataset = v.dataset AND l.model = v.model""", VP)
def k13(spark, d):
    t = U.fusion_table(V.v_pred(spark, d), DS, ["row_id"]).where("split = 'train'")
    t = durable(t)
    b = U.base_strengths(t, DS, U.profile_diversity(t, DS, ["row_id"]))
    return b.select("dataset", "model", r("train_metric").alias("train_metric"), r("performance_strength", 8).alias("performance_strength"),
                    r("diversity_strength", 8).alias("diversity_strength"))


@query("k13_score_fusion_candidates", f"""WITH {FUSION_SQL},
s AS (SELECT * FROM (VALUES (3, 'm_gap|m_k'), (5, 'm_gap|m_lin'), (6, 'm_k|m_lin'), (7, 'm_gap|m_k|m_lin')) x(mask, models)),
w AS (SELECT l.dataset, s.models, l.model, k.variant, CASE k.variant WHEN 'score_ac' THEN 1.0::DOUBLE WHEN 'score_wcp' THEN 1 / loss ELSE cd END AS w
 FROM l JOIN v ON l.dataset = v.dataset AND l.model = v.model JOIN s ON list_contains(string_split(s.models, '|'), l.model) CROSS JOIN (VALUES ('score_ac'), ('score_wcp'), ('score_wcds')) k(variant)),
n AS (SELECT *, w / sum(w) OVER (PARTITION BY dataset, models, variant) AS wt FROM w),
f AS (SELECT t.dataset, models, variant, row_id, min(observed) AS y, sum(wt * predicted) AS p FROM t JOIN n ON n.dataset = t.dataset AND n.model = t.model WHERE split = 'train' GROUP BY ALL)
SELECT dataset, models, variant, round(sqrt(avg((y - p) ** 2)), 6) AS train_metric FROM f GROUP BY dataset, models, variant""", VP)
def k13b(spark, d):
    t = durable(U.fusion_table(V.v_pred(spark, d), DS, ["row_id"]))
    c, _ = U.candidate_table(V.v_pred(spark, d), DS, ["row_id"], "rmse", rank_space=False, table=t)
    return c.select("dataset", "models", "variant", r("train_metric").alias("train_metric"))


@query("k13_fusion_winner")
def k13c(spark, d):
    """Both spaces by mean absolute error; the winner's test error and combination."""
    p = V.v_pred(spark, d)
    t = durable(U.fusion_table(p, DS, ["row_id"]))
    rows = durable(U.aligned_rows(t, DS, ["row_id"]))
    c, _ = U.candidate_table(p, DS, ["row_id"], "mae", table=t, rows=rows)
    best = durable(U.choose(c, DS, 9))
    e = M.regression_errors(U.fuse(t, best, DS, ["row_id"], rows), ["dataset", "split"]).select("dataset", "split", "mae")
    return best.select("dataset", "models", "variant", r("train_metric").alias("train_metric")).join(rounded(e, "mae"), "dataset")


CLASS_FUSION_SQL = """b AS (SELECT * FROM v_binary UNION ALL SELECT DISTINCT dataset, 'hash', row_id, observed, CAST(row_id % 17 AS DOUBLE) / 17 FROM v_binary),
t AS (SELECT * FROM b WHERE row_id % 5 <> 0 AND dataset IN (SELECT dataset FROM b WHERE row_id % 5 <> 0 GROUP BY dataset HAVING count(DISTINCT observed) = 2)),
z AS (SELECT *, min(predicted) OVER w AS lo, max(predicted) OVER w AS hi FROM t WINDOW w AS (PARTITION BY dataset, model)),
u AS (SELECT *, CASE WHEN lo >= 0 AND hi <= 1 THEN predicted ELSE 1 / (1 + exp(-greatest(-30, least(30, predicted)))) END AS score FROM z),
a AS (SELECT dataset, model, observed, rank() OVER w + (count(*) OVER (PARTITION BY dataset, model, score) - 1) / 2 AS k FROM u WINDOW w AS (PARTITION BY dataset, model ORDER BY score)),
l AS (SELECT dataset, model, 1 - (sum(k) FILTER (observed = 1) - count_if(observed = 1) * (count_if(observed = 1) + 1) / 2) / (count_if(observed = 1) * count_if(observed = 0)) AS loss FROM a GROUP BY ALL),
o AS (SELECT dataset, model, row_number() OVER (PARTITION BY dataset, model ORDER BY predicted, row_id) AS i, (predicted - lo) / (hi - lo) AS z FROM z),
v AS (SELECT a.dataset, a.model, avg((a.z - b.z) ** 2) AS cd FROM o a JOIN o b ON a.dataset = b.dataset AND a.i = b.i AND a.model <> b.model GROUP BY a.dataset, a.model),
s AS (SELECT * FROM (VALUES ('hash|raw'), ('hash|unit'), ('raw|unit'), ('hash|raw|unit')) x(models)),
w AS (SELECT l.dataset, s.models, l.model, k.variant, CASE k.variant WHEN 'ac' THEN 1.0::DOUBLE WHEN 'wcp' THEN 1 / loss ELSE cd END AS w
 FROM l JOIN v ON l.dataset = v.dataset AND l.model = v.model JOIN s ON list_contains(string_split(s.models, '|'), l.model) CROSS JOIN (VALUES ('ac'), ('wcp'), ('wcds')) k(variant)),
n AS (SELECT *, w / sum(w) OVER (PARTITION BY dataset, models, variant) AS wt FROM w),
r AS (SELECT *, count(*) OVER (PARTITION BY dataset, model) + 1 - (rank() OVER (PARTITION BY dataset, model ORDER BY predicted) + (count(*) OVER (PARTITION BY dataset, model, predicted) - 1) / 2) AS down FROM t),
f AS (SELECT r.dataset, models, variant, row_id, min(observed) AS y, sum(wt * predicted) AS p, -sum(wt * down) AS q FROM r JOIN n ON n.dataset = r.dataset AND n.model = r.model GROUP BY ALL),
g AS (SELECT *, regr_slope(y, q) OVER w AS sl, regr_intercept(y, q) OVER w AS ic FROM f WINDOW w AS (PARTITION BY dataset, models, variant)),
e AS (SELECT dataset, models, concat('score_', variant) AS variant, y, round(p, 9) AS p FROM g UNION ALL SELECT dataset, models, concat('rank_', variant), y, round(ic + sl * q, 9) FROM g),
h AS (SELECT *, min(p) OVER w AS lo, max(p) OVER w AS hi FROM e WINDOW w AS (PARTITION BY dataset, models, variant)),
c AS (SELECT dataset, models, variant, y, CASE WHEN lo >= 0 AND hi <= 1 THEN p ELSE 1 / (1 + exp(-greatest(-30, least(30, p)))) END AS score FROM h),
d AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY dataset, models, variant, score) - 1) / 2 AS k, sum(y) OVER v AS tp, count(*) OVER v AS up FROM c
 WINDOW w AS (PARTITION BY dataset, models, variant ORDER BY score), v AS (PARTITION BY dataset, models, variant ORDER BY score DESC))"""


def class_candidates(spark, d, metric):
    b = V.v_binary(spark, d)
    extra = b.select("dataset", F.lit("hash").alias("model"), "row_id", "observed", ((F.col("row_id") % 17).cast("double") / 17).alias("predicted")).distinct()
    p = b.unionByName(extra).withColumn("split", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))
    two = p.where("split = 'train'").groupBy("dataset").agg(F.count_distinct("observed").alias("k")).where("k = 2").select("dataset")
    c, _ = U.candidate_table(p.join(two, "dataset", "left_semi"), DS, ["row_id"], metric)
    return rounded(c.select("dataset", "models", "variant", "train_metric"), "train_metric")


@query("k13_roc_auc_candidates", f"""WITH {CLASS_FUSION_SQL}
SELECT dataset, models, variant, round(1 - (sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS train_metric FROM d GROUP BY ALL""", ("v_binary",))
def k13d(spark, d):
    """Every subset of three models in score and rank space by 1 - ROC-AUC."""
    return class_candidates(spark, d, "roc_auc")


@query("k13_auprc_candidates", f"""WITH {CLASS_FUSION_SQL.replace("1 - (sum(k) FILTER (observed = 1) - count_if(observed = 1) * (count_if(observed = 1) + 1) / 2) / (count_if(observed = 1) * count_if(observed = 0)) AS loss FROM a",
 "1 - sum(tp / up) FILTER (observed = 1) / count_if(observed = 1) AS loss FROM (SELECT dataset, model, observed, sum(observed) OVER w AS tp, count(*) OVER w AS up FROM u WINDOW w AS (PARTITION BY dataset, model ORDER BY score DESC))")}
SELECT dataset, models, variant, round(1 - sum(tp / up) FILTER (y = 1) / sum(y), 6) AS train_metric FROM d GROUP BY ALL""", ("v_binary",))
def k13e(spark, d):
    """The same by 1 - average precision."""
    return class_candidates(spark, d, "auprc")


@query("k14_subset_budget", """
SELECT event_type AS dataset, count(DISTINCT user_id) // 15 AS n_models, CAST(2 ** (count(DISTINCT user_id) // 15) AS BIGINT) - 1 - count(DISTINCT user_id) // 15 AS subsets FROM events GROUP BY event_type""")
def k14(spark, d):
    g = V.table(spark, d, "events").groupBy(F.col("event_type").alias("dataset")).agg(F.count_distinct("user_id").alias("u"))
    return g.select("dataset", F.floor(F.col("u") / 15).alias("n_models")).withColumn("subsets", U.subset_total("n_models"))


@query("k15_fusion_inputs", """
WITH b AS (SELECT run_name, dataset, workflow, arg_min(model, (score, model)) AS model FROM v_analysis WHERE workflow <> 'Ensemble' AND workflow <> 'CFA' GROUP BY ALL),
n AS (SELECT run_name, dataset FROM b GROUP BY ALL HAVING count(*) >= 2)
SELECT b.run_name, b.dataset, b.workflow, b.model FROM b JOIN n ON n.run_name = b.run_name AND n.dataset = b.dataset""", VA)
def k15(spark, d):
    a = V.v_analysis(spark, d).where("workflow NOT IN ('Ensemble', 'CFA')")
    b = durable(E.best_per_workflow(a, RD, "comparison_score").select(*RD, "workflow", "model"))
    enough = b.groupBy(*RD).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(*RD)
    return b.join(enough, RD)


@query("k17_metrics_with_leaderboard_columns", """
WITH rf AS (SELECT dataset, model, leaderboard_metric_name AS metric, metric_value, CASE leaderboard_metric_name WHEN 'RMSE' THEN 'rmse' WHEN 'AUROC' THEN 'roc_auc' ELSE 'spearman' END AS kind,
 CASE WHEN leaderboard_metric_name = 'RMSE' THEN metric_value_numeric ELSE -metric_value_numeric END AS s FROM v_ref),
o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY s, model, metric_value) AS k FROM rf),
t AS (SELECT dataset, min(metric) AS metric, min(kind) AS kind, list(s ORDER BY k) AS vals, min(model) FILTER (k = 1) AS first_model, min(metric_value) FILTER (k = 1) AS first_value,
 CAST(to_json(list(struct_pack(rank := k, model := model, metric_name := metric, metric_value := metric_value) ORDER BY k)) AS VARCHAR) AS entries FROM o WHERE k <= 10 GROUP BY dataset),
m AS (SELECT run_name, dataset, model, attempt, primary_metric_value AS x, CASE primary_metric WHEN 'RMSE' THEN 'rmse' WHEN 'ROC-AUC' THEN 'roc_auc' ELSE 'spearman' END AS kind FROM v_metrics),
j AS (SELECT m.*, t.* EXCLUDE (dataset, kind), t.kind AS board, coalesce(t.kind = m.kind, false) AS same, CASE WHEN t.kind = 'rmse' THEN x ELSE -x END AS score FROM m LEFT JOIN t ON t.dataset = m.dataset)
SELECT run_name, dataset, model, attempt, first_model AS leaderboard_model, metric AS leaderboard_metric_name, first_value AS leaderboard_metric_value,
 CASE WHEN vals IS NOT NULL THEN 1::INTEGER END AS leaderboard_rank, CAST(coalesce(len(vals), 0) AS INTEGER) AS leaderboard_top10_count, coalesce(entries, '[]') AS leaderboard_top10_json,
 board AS leaderboard_metric_normalized, board = 'rmse' AS leaderboard_lower_is_better, CASE WHEN same THEN abs(vals[1]) END AS leaderboard_metric_reference,
 CASE WHEN same THEN round(x - abs(vals[1]), 6) END AS leaderboard_delta_primary, CASE WHEN same THEN abs(vals[1]) END AS leaderboard_top10_best_reference,
 CASE WHEN same THEN round(x - abs(vals[1]), 6) END AS leaderboard_delta_top10_best,
 CASE WHEN same AND x IS NOT NULL THEN CAST(1 + len(list_filter(vals, lambda v: v < score)) AS INTEGER) END AS leaderboard_estimated_rank_vs_top10,
 CASE WHEN same AND x IS NOT NULL THEN 1 + len(list_filter(vals, lambda v: v < score)) <= 10 END AS leaderboard_estimated_in_top10,
 CASE WHEN same AND x IS NOT NULL THEN round(score - vals[-1], 6) END AS leaderboard_gap_to_top10_cutoff,
 CASE WHEN same AND x IS NOT NULL THEN abs(vals[-1]) END AS leaderboard_top10_cutoff_value FROM j""", ("v_metrics", "v_ref"))
def k17(spark, d):
    from evalspark.operators.leaderboards import with_leaderboard_columns
    m = V.v_metrics(spark, d).select("run_name", "dataset", "model", "attempt", "primary_metric", "primary_metric_value")
    out = with_leaderboard_columns(m, V.v_ref(spark, d)).drop("primary_metric", "primary_metric_value")
    return rounded(out, "leaderboard_delta_primary", "leaderboard_delta_top10_best", "leaderboard_gap_to_top10_cutoff")


# --- K: fitted models ------------------------------------------------------------------------------------------------

def vectors(spark, d, binary=False):
    """Embeddings as features; the label (or its upper half as 0/1) as target, split and folds by hash."""
    from evalspark.operators.models import as_vectors
    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("y"))
    e = e.withColumns({"_all": F.lit(0), "y": F.when(F.col("y") >= 5, 1).otherwise(0) if binary else F.col("y")})
    e = S.random_holdout(e, ["_all"], "vec_id", 0.2)
    e = S.random_kfold(e, ["_all"], "vec_id", 3).drop("folds", "_all")
    return durable(as_vectors(e, "x", "y").select("vec_id", "x", "features", "label", "split", "fold"))


def reported(spark, d, models, binary):
    from evalspark.operators.models import evaluate_model, model_report
    df = vectors(spark, d, binary)
    pred = None
    for name, est in models.items():
        p = evaluate_model(name, est, df, "fold", "vec_id", binary, 4)
        pred = p if pred is None else pred.unionByName(p)
    rep = model_report(durable(pred), "fold", binary)
    shown = [c for c in rep.columns if c.startswith(("cv_", "train_", "test_", "primary_metric_value")) and c != "cv_folds"]
    return rounded(rep.drop("elapsed_seconds"), *shown, digits=3)


@query("k1_regression_models")
def k1(spark, d):
    from evalspark.operators.models import regression_models
    return reported(spark, d, regression_models(), False)


# The grid of operators.elastic_net.MODEL_ALPHAS and MODEL_L1_RATIOS.
@query("k1_elastic_net_cv", """WITH b AS (SELECT dataset, row_id, observed AS y, predicted AS x, row_id % 3 AS fold FROM v_pred WHERE model = 'm_k' AND split = 'train'),
m AS (SELECT dataset, fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM b GROUP BY ALL),
t AS (SELECT dataset, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM m GROUP BY dataset),
s AS (SELECT *, sqrt(sxx / n - (sx / n) ** 2) AS sd FROM t),
g AS (SELECT pow(10, -4 + 4 * i / 11) AS alpha, ratio FROM range(12) r(i), (VALUES (0.4::DOUBLE), (0.8::DOUBLE)) q(ratio)),
f AS (SELECT m.dataset, fold, m.n AS vn, m.sx AS vx, m.sy AS vy, m.sxx AS vxx, m.sxy AS vxy, m.syy AS vyy, s.n - m.n AS n, (s.sx - m.sx) / (s.n - m.n) AS mx, (s.sy - m.sy) / (s.n - m.n) AS my,
 (s.sxx - m.sxx) / (s.n - m.n) AS mxx, (s.sxy - m.sxy) / (s.n - m.n) AS mxy, sd FROM m JOIN s ON s.dataset = m.dataset),
w AS (SELECT f.*, alpha, ratio, sign(mxy - mx * my) * greatest(abs(mxy - mx * my) / sd - alpha * ratio, 0) / ((mxx - mx * mx) / sd ** 2 + alpha * (1 - ratio)) / sd AS w FROM f CROSS JOIN g),
e AS (SELECT dataset, alpha, ratio, avg((vyy - 2 * w * vxy - 2 * (my - w * mx) * vy + w * w * vxx + 2 * w * (my - w * mx) * vx + vn * (my - w * mx) ** 2) / vn) AS mse FROM w GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY round(mse, 9), ratio, alpha DESC) AS k FROM e)
SELECT c.dataset, round(mse, 5) AS cv_mse, round(alpha, 8) AS alpha, ratio AS l1_ratio,
 round(sign(sxy / n - sx / n * sy / n) * greatest(abs(sxy / n - sx / n * sy / n) / sd - alpha * ratio, 0) / (1 + alpha * (1 - ratio)), 6) AS scaled FROM c JOIN s ON s.dataset = c.dataset WHERE k = 1""", VP)
def k1b(spark, d):
    """One feature, so that the path has a closed form; the grid, folds and choice are those of the model table."""
    from evalspark.operators.elastic_net import elastic_net_cv
    p = V.v_pred(spark, d).where("model = 'm_k' and split = 'train'").select("dataset", F.array("predicted").alias("x"), F.col("observed").alias("y"), (F.col("row_id") % 3).alias("fold"))
    out = elastic_net_cv(p, DS, "fold", "x", "y")
    return rounded(out.select("dataset", r("cv_mse", 5).alias("cv_mse"), r("alpha", 8).alias("alpha"), "l1_ratio", F.col("scaled")[0].alias("scaled")), "scaled")


@query("k2_classification_models")
def k2(spark, d):
    from evalspark.operators.models import classification_models
    return reported(spark, d, classification_models(64), True)


@query("k5_evaluate_failing_model")
def k5(spark, d):
    """A model that cannot be fitted leaves a row with its error text and the others are reported."""
    from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
    rep = reported(spark, d, {"Ridge": LinearRegression(regParam=0.1),
                              "Broken": GeneralizedLinearRegression(family="gamma", maxIter=1)}, False)
    return rep.withColumn("error", F.col("error").isNotNull())


# Parts and folds of stored predictions for the next two queries.
PARTS_SQL = "CASE row_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'cv' END AS part, CASE WHEN row_id % 4 > 1 THEN row_id % 3 ELSE -1 END AS fold"


def in_parts(p):
    part = F.when(F.col("row_id") % 4 == 0, "test").when(F.col("row_id") % 4 == 1, "train").otherwise("cv")
    return p.withColumns({"part": part, "fold": F.col("row_id") % 3})


def parts_sql(table: str, names: tuple[str, ...], primary: str) -> str:
    """The rows of ``evaluation_rows`` from a table of metrics per dataset, model, part and fold."""
    cv = [f"CASE WHEN count({m}) FILTER (part = 'cv') = count(*) FILTER (part = 'cv') THEN round(avg({m}) FILTER (part = 'cv'), 6) END AS cv_{m}" for m in names]
    sides = [f"round(max({m}) FILTER (part = '{s}'), 6) AS {s}_{m}" for s in ("train", "test") for m in names]
    return (f"SELECT *, '{primary}' AS primary_metric, cv_{primary} AS cv_primary, test_{primary} AS primary_metric_value FROM "
            f"(SELECT dataset, model, count(*) FILTER (part = 'cv') AS cv_folds, {', '.join(cv + sides)} FROM {table} GROUP BY dataset, model)")


def evaluated(p, primary, classification):
    from evalspark.operators.evaluation import evaluation_rows
    out = evaluation_rows(in_parts(p), ["dataset", "model"], "fold", primary, classification)
    return rounded(out, *[c for c in out.columns if c.startswith(("cv_", "train_", "test_", "primary_metric_value")) and c != "cv_folds"])


@query("k5_evaluation_rows", f"""WITH p AS (SELECT dataset, model, observed AS y, predicted AS x, {PARTS_SQL} FROM v_pred),
k AS (SELECT *, {AVG_RANK.format(p='dataset, model, part, fold', v='y')} AS ry, {AVG_RANK.format(p='dataset, model, part, fold', v='x')} AS rx FROM p),
g AS (SELECT dataset, model, part, fold, 1 - sum((y - x) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - x) ** 2)) AS rmse, avg(abs(y - x)) AS mae, corr(ry, rx) AS spearman FROM k GROUP BY ALL)
{parts_sql("g", ("r2", "rmse", "mae", "spearman"), "rmse")}""", VP)
def k5b(spark, d):
    """All regression metrics of cv folds, train and test, by dataset and model."""
    return evaluated(V.v_pred(spark, d), "rmse", False)


@query("k5_evaluation_rows_of_classes", f"""WITH p AS (SELECT dataset, model, observed AS y, CASE WHEN min(predicted) OVER w >= 0 AND max(predicted) OVER w <= 1 THEN predicted
 ELSE 1 / (1 + exp(-greatest(least(predicted, 30), -30))) END AS x, part, fold FROM (SELECT *, {PARTS_SQL} FROM v_binary) WINDOW w AS (PARTITION BY dataset, model, part, fold)),
k AS (SELECT *, {AVG_RANK.format(p='dataset, model, part, fold', v='x')} AS rx, sum(y) OVER w AS tp, count(*) OVER w AS up FROM p WINDOW w AS (PARTITION BY dataset, model, part, fold ORDER BY x DESC)),
c AS (SELECT dataset, model, part, fold, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS n0, sum(rx) FILTER (y = 1) AS s, sum(tp / up) FILTER (y = 1) AS ap,
 CAST(count(*) FILTER (y = 1 AND x >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND x >= 0.5) AS DOUBLE) AS fp FROM k GROUP BY ALL),
g AS (SELECT dataset, model, part, fold, (s - n1 * (n1 + 1) / 2) / (n1 * n0) AS roc_auc, ap / n1 AS auprc, (tp / n1 + (n0 - fp) / n0) / 2 AS balanced_accuracy,
 coalesce((tp * (n0 - fp) - fp * (n1 - tp)) / nullif(sqrt((tp + fp) * n1 * n0 * (n0 - fp + n1 - tp)), 0), 0) AS mcc FROM c WHERE n1 > 0 AND n0 > 0
 UNION ALL SELECT dataset, model, part, fold, NULL, NULL, NULL, NULL FROM c WHERE n1 = 0 OR n0 = 0)
{parts_sql("g", ("roc_auc", "auprc", "balanced_accuracy", "mcc"), "roc_auc")}""", VB)
def k5c(spark, d):
    """All classification metrics of cv folds, train and test, by dataset and model."""
    return evaluated(V.v_binary(spark, d), "roc_auc", True)


@query("k6_score_source_order")
def k6(spark, d):
    from pyspark.ml.classification import LinearSVC, LogisticRegression

    from evalspark.operators.models import predict
    df = vectors(spark, d, True)
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    out = None
    for name, est in (("probability", LogisticRegression(regParam=0.1)), ("decision", LinearSVC(regParam=0.1, maxIter=20))):
        p = predict(est.fit(train), test, ["vec_id"]).withColumn("source", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return rounded(out, "predicted", digits=3)


@query("k7_evolutionary_search")
def k7(spark, d):
    from pyspark.ml.regression import LinearRegression

    from evalspark.operators.models import evolve
    space = {"reg": ("uniform", (0.0, 1.0)), "l1": ("choice", (0.0, 0.5, 1.0))}
    build = lambda p: LinearRegression(regParam=p["reg"], elasticNetParam=p["l1"])
    h = evolve(vectors(spark, d), build, space, "fold")
    return rounded(h, "loss", digits=4)


# The individuals of the next query.
INDIVIDUALS = ((-3.0, 0.5), (-2.0, 0.0), (-1.5, 1.0), (1.0, 1.0))


@query("k7_generation_losses", f"""WITH b AS (SELECT row_id % 3 AS fold, predicted AS x, observed AS y FROM v_binary WHERE model = 'raw'),
m AS (SELECT fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM b GROUP BY fold),
t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM m),
f AS (SELECT fold, sqrt(t.sxx / t.n - (t.sx / t.n) ** 2) AS sd, (t.sx - m.sx) / (t.n - m.n) AS mx, (t.sy - m.sy) / (t.n - m.n) AS my,
 (t.sxx - m.sxx) / (t.n - m.n) AS mxx, (t.sxy - m.sxy) / (t.n - m.n) AS mxy FROM m CROSS JOIN t),
g AS (SELECT CAST(c AS INTEGER) AS candidate, pow(10, a) AS alpha, ratio FROM (VALUES {", ".join(f"({i}, {a}::DOUBLE, {q}::DOUBLE)" for i, (a, q) in enumerate(INDIVIDUALS))}) x(c, a, ratio)),
w AS (SELECT candidate, fold, mx, my, sign(mxy - mx * my) * greatest(abs(mxy - mx * my) / sd - alpha * ratio, 0) / ((mxx - mx * mx) / sd ** 2 + alpha * (1 - ratio)) / sd AS w FROM f CROSS JOIN g),
p AS (SELECT candidate, b.fold, y, w * x + my - w * mx AS p, round(w * x + my - w * mx, 9) AS s FROM b JOIN w ON w.fold = b.fold),
k AS (SELECT *, rank() OVER (PARTITION BY candidate, fold ORDER BY s) + (count(*) OVER (PARTITION BY candidate, fold, s) - 1) / 2.0::DOUBLE AS k FROM p),
e AS (SELECT candidate, fold, sqrt(avg((y - p) ** 2)) AS rmse, avg(abs(y - p)) AS mae,
 -(sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS roc_auc FROM k GROUP BY ALL)
SELECT candidate, metric, round(avg(loss), 6) AS loss FROM (UNPIVOT e ON rmse, mae, roc_auc INTO NAME metric VALUE loss) GROUP BY ALL""", ("v_binary",))
def k7b(spark, d):
    """Mean fold losses of one generation by three metrics; one feature, so that the fits have a closed form."""
    from evalspark.operators.search import elastic_net_losses
    b = durable(V.v_binary(spark, d).where("model = 'raw'").select((F.col("row_id") % 3).alias("fold"), F.array("predicted").alias("x"), F.col("observed").alias("y")))
    wanted = [{"log_alpha": a, "l1_ratio": q} for a, q in INDIVIDUALS]
    rows = [(i, m, loss) for m in ("rmse", "mae", "roc_auc") for i, loss in enumerate(elastic_net_losses(b, "fold", "x", "y", m)(wanted))]
    return rounded(spark.createDataFrame(rows, "candidate int, metric string, loss double"), "loss")


@query("k7_roc_auc_search")
def k7c(spark, d):
    """Elastic nets on the embeddings by ROC-AUC: one pass over the rows a generation."""
    from evalspark.operators.search import evolve_elastic_net
    return rounded(evolve_elastic_net(vectors(spark, d, True), "fold", "x", "label", "roc_auc"), "loss", digits=4)


@query("k16_grouped_stack")
def k16(spark, d):
    from evalspark.operators.models import grouped_stack
    docs = V.table(spark, d, "documents").select(
        "doc_id", "source", F.md5("text").alias("key"), F.array(F.log("n_chars").cast("double"), F.length(F.regexp_replace("text", "[^e]", "")).cast("double"),
                                                              F.length(F.regexp_replace("text", "[^ ]", "")).cast("double")).alias("x"),
        F.col("n_chars").cast("double").alias("y")).withColumn("_all", F.lit(0))
    docs = durable(S.hash_split(docs, ["_all"], "key", "doc_id", 0.2).drop("_all"))
    pred, plan = grouped_stack(docs, "source", "key", "doc_id", "x", "y", min_rows=30, min_keys=20)
    e = M.regression_errors(pred.withColumnRenamed("stack_pred", "predicted"), ["source", "split"])
    return rounded(e.join(plan, "source").select("source", "split", "n_rows", "rmse", "status", "oof_folds"), "rmse", digits=2)


@query("j5_elastic_net_selection")
def j5(spark, d):
    from evalspark.operators.models import elastic_net_selection
    s = elastic_net_selection(vectors(spark, d), "fold", 3)
    return rounded(s, "coefficient", digits=3)


@query("j6_forest_selection")
def j6(spark, d):
    from evalspark.operators.models import select_features
    return rounded(select_features(vectors(spark, d), "fold", 3, "random_forest"), "coefficient", digits=3)


@query("j11_principal_components")
def j11(spark, d):
    from evalspark.operators.models import principal_components
    p = principal_components(vectors(spark, d), 2)
    return p.select("vec_id", r(F.abs(F.col("components")[0]), 4).alias("pc1"), r(F.abs(F.col("components")[1]), 4).alias("pc2"))
