"""Quality metrics, ranks and the flagship ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.operators import metrics as M
from evalspark.operators import ordering as O
from evalspark.plans import views as V
from evalspark.plans.registry import query, r, rounded

KEYS = ["dataset", "model", "split"]

AVG_RANK = """rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0"""


@query("flagship_model_ranking", """
WITH m AS (SELECT dataset, model, count(*) AS n_rows,
                  sqrt(avg((observed - predicted) * (observed - predicted))) AS rmse
           FROM v_pred WHERE split = 'test' GROUP BY dataset, model)
SELECT dataset, model, n_rows, round(rmse, 6) AS rmse,
       round(rmse - min(rmse) OVER (PARTITION BY dataset), 6) AS delta_from_best,
       rank() OVER (PARTITION BY dataset ORDER BY rmse) AS rank_in_dataset,
       row_number() OVER (PARTITION BY dataset ORDER BY rmse, model) = 1 AS is_best
FROM m""", ("v_pred",))
def flagship(spark, d):
    """Row-level work is one partial aggregate; the windows see one row per (dataset, model)."""
    m = (V.v_pred(spark, d).where(F.col("split") == "test").groupBy("dataset", "model")
         .agg(F.count(F.lit(1)).alias("n_rows"), M.rmse("observed", "predicted").alias("rmse")))
    w = Window.partitionBy("dataset")
    return m.select("dataset", "model", "n_rows", r("rmse").alias("rmse"),
                    r(F.col("rmse") - F.min("rmse").over(w)).alias("delta_from_best"),
                    F.rank().over(w.orderBy("rmse")).alias("rank_in_dataset"),
                    (F.row_number().over(w.orderBy("rmse", "model")) == 1).alias("is_best"))


@query("h1_regression_errors", """
SELECT dataset, model, split, count(*) AS n_rows, round(avg((observed - predicted) ** 2), 4) AS mse,
       round(sqrt(avg((observed - predicted) ** 2)), 6) AS rmse, round(avg(abs(observed - predicted)), 6) AS mae
FROM v_pred GROUP BY ALL""", ("v_pred",))
def h1(spark, d):
    g = M.regression_errors(V.v_pred(spark, d), KEYS)
    return g.select(*KEYS, "n_rows", r("mse", 4).alias("mse"), r("rmse").alias("rmse"), r("mae").alias("mae"))


@query("h2_r2", """
SELECT dataset, model, split, round(1 - sum((observed - predicted) ** 2) / (var_pop(observed) * count(*)), 6) AS r2
FROM v_pred GROUP BY ALL""", ("v_pred",))
def h2(spark, d):
    return V.v_pred(spark, d).groupBy(*KEYS).agg(r(M.r2("observed", "predicted")).alias("r2"))


@query("h3_pearson", """
SELECT dataset, model, split, round(corr(observed, predicted), 6) AS pearson FROM v_pred GROUP BY ALL""", ("v_pred",))
def h3(spark, d):
    return V.v_pred(spark, d).groupBy(*KEYS).agg(r(M.pearson("observed", "predicted")).alias("pearson"))


@query("h4_spearman", f"""
WITH k AS (SELECT dataset, model, split,
  {AVG_RANK.format(p='dataset, model, split', v='observed')} AS ry,
  {AVG_RANK.format(p='dataset, model, split', v='predicted')} AS rp FROM v_pred)
SELECT dataset, model, split, count(*) AS n_rows, round(corr(ry, rp), 6) AS spearman FROM k GROUP BY ALL""",
       ("v_pred",))
def h4(spark, d):
    return rounded(M.spearman(V.v_pred(spark, d), KEYS), "spearman")


LABELLED = """
s AS (SELECT dataset, model, row_id, observed, predicted,
        min(observed) OVER w AS y0, max(observed) OVER w AS y1, min(predicted) OVER w AS p0, max(predicted) OVER w AS p1
      FROM v_binary WINDOW w AS (PARTITION BY dataset, model)),
b AS (SELECT dataset, model, row_id, CASE WHEN y0 = y1 THEN NULL WHEN observed = y1 THEN 1 ELSE 0 END AS label,
        CASE WHEN p0 >= 0 AND p1 <= 1 THEN predicted
             ELSE 1 / (1 + exp(-greatest(least(predicted, 30.0), -30.0))) END AS score FROM s)"""


@query("h5_binary_label_map", f"""WITH {LABELLED}
SELECT dataset, model, row_id, label FROM b""", ("v_binary",))
def h5(spark, d):
    return M.binary_frame(V.v_binary(spark, d), ["dataset", "model"]).select("dataset", "model", "row_id", "label")


@query("h6_score_rule", f"""WITH {LABELLED}
SELECT dataset, model, row_id, round(score, 9) AS score FROM b""", ("v_binary",))
def h6(spark, d):
    b = M.binary_frame(V.v_binary(spark, d), ["dataset", "model"])
    return b.select("dataset", "model", "row_id", r("score", 9).alias("score"))


@query("h7_roc_auc", f"""WITH {LABELLED},
k AS (SELECT dataset, model, label, {AVG_RANK.format(p='dataset, model', v='score')} AS rk FROM b)
SELECT dataset, model, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
 round((sum(CASE WHEN label = 1 THEN rk END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
  / nullif(CAST(count(*) FILTER (label = 1) * count(*) FILTER (label = 0) AS DOUBLE), 0), 6) AS roc_auc
FROM k GROUP BY dataset, model""", ("v_binary",))
def h7(spark, d):
    g = M.ranking_metrics(V.v_binary(spark, d), ["dataset", "model"])
    return g.select("dataset", "model", "n_pos", "n_neg", r("roc_auc").alias("roc_auc"))


@query("h8_average_precision", f"""WITH {LABELLED},
g AS (SELECT dataset, model, score, sum(label) AS pos, sum(1 - label) AS neg FROM b GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY dataset, model) AS p FROM g
      WINDOW w AS (PARTITION BY dataset, model ORDER BY score DESC))
SELECT dataset, model, round(sum(pos * (tp / nullif(tp + fp, 0)) / nullif(p, 0)), 6) AS auprc FROM c GROUP BY dataset, model""",
       ("v_binary",))
def h8(spark, d):
    g = M.ranking_metrics(V.v_binary(spark, d), ["dataset", "model"])
    return g.select("dataset", "model", r("auprc").alias("auprc"))


CONFUSION = f"""WITH {LABELLED},
c AS (SELECT dataset, model, CAST(count(*) FILTER (label = 1 AND score >= 0.5) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (label = 0 AND score < 0.5) AS DOUBLE) AS tn,
  CAST(count(*) FILTER (label = 0 AND score >= 0.5) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (label = 1 AND score < 0.5) AS DOUBLE) AS fn FROM b GROUP BY dataset, model)"""


@query("h9_accuracy", f"""{CONFUSION}
SELECT dataset, model, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 6) AS accuracy,
  round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy FROM c""", ("v_binary",))
def h9(spark, d):
    g = M.confusion_metrics(V.v_binary(spark, d), ["dataset", "model"])
    return g.select("dataset", "model", r("accuracy").alias("accuracy"), r("balanced_accuracy").alias("balanced_accuracy"))


@query("h10_matthews", f"""{CONFUSION}
SELECT dataset, model, CASE WHEN tp + tn + fp + fn > 0 THEN coalesce(round((tp * tn - fp * fn)
  / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6), 0) END AS mcc FROM c""", ("v_binary",))
def h10(spark, d):
    g = M.confusion_metrics(V.v_binary(spark, d), ["dataset", "model"])
    return g.select("dataset", "model", r("mcc").alias("mcc"))


@query("h11_metric_as_loss", """
WITH g AS (SELECT dataset, model, sqrt(avg((observed - predicted) ** 2)) AS rmse, avg(abs(observed - predicted)) AS mae,
  1 - sum((observed - predicted) ** 2) / (var_pop(observed) * count(*)) AS r2, corr(observed, predicted) AS pearson
  FROM v_pred GROUP BY ALL)
SELECT dataset, model, 'rmse' AS metric, round(rmse, 6) AS loss FROM g
UNION ALL SELECT dataset, model, 'mae', round(mae, 6) FROM g
UNION ALL SELECT dataset, model, 'r2', round(1 - r2, 6) FROM g
UNION ALL SELECT dataset, model, 'pearson', round(1 - pearson, 6) FROM g
UNION ALL SELECT dataset, model, 'mystery', round(mae, 6) FROM g""", ("v_pred",))
def h11(spark, d):
    g = M.regression_errors(V.v_pred(spark, d), ["dataset", "model"]).withColumn("mystery", F.col("mae"))
    long = g.select("dataset", "model", "mae", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("rmse", "mae", "r2", "pearson", "mystery")
    ])).alias("m"))
    return long.select("dataset", "model", "m.metric",
                       r(M.as_loss(F.col("m.metric"), F.col("m.value"), F.col("mae"))).alias("loss"))


@query("h12_out_of_fold_metrics", """
WITH k AS (SELECT dataset, model, observed, CASE WHEN observed < 1 THEN 'nan'::DOUBLE ELSE predicted END AS predicted
           FROM v_pred)
SELECT dataset, model, count(*) AS n_rows, round(sqrt(avg((observed - predicted) ** 2)), 6) AS rmse,
  round(avg(abs(observed - predicted)), 6) AS mae,
  round(1 - sum((observed - predicted) ** 2) / (var_pop(observed) * count(*)), 6) AS r2
FROM k WHERE NOT isnan(predicted) GROUP BY ALL""", ("v_pred",))
def h12(spark, d):
    p = V.v_pred(spark, d)
    p = p.withColumn("predicted", F.when(F.col("observed") < 1, float("nan")).otherwise(F.col("predicted")))
    return rounded(M.out_of_fold(p, ["dataset", "model"]), "rmse", "mae", "r2")


@query("h13_mean_fold_scores", """
WITH f AS (SELECT dataset, model, entity_key // 30 AS fold, sqrt(avg((observed - predicted) ** 2)) AS rmse,
  avg(abs(observed - predicted)) AS mae, 1 - sum((observed - predicted) ** 2) / (var_pop(observed) * count(*)) AS r2
  FROM v_pred GROUP BY ALL)
SELECT dataset, model, count(*) AS n_folds, round(avg(rmse), 6) AS cv_rmse, round(avg(mae), 6) AS cv_mae,
  round(avg(r2), 6) AS cv_r2, round(stddev_pop(rmse), 6) AS cv_rmse_std FROM f GROUP BY ALL""", ("v_pred",))
def h13(spark, d):
    p = V.v_pred(spark, d).withColumn("fold", F.floor(F.col("entity_key") / 30))
    return rounded(M.mean_fold_scores(p, ["dataset", "model"]), "cv_rmse", "cv_mae", "cv_r2", "cv_rmse_std")


@query("h14_search_loss_sign", """
SELECT run_name, dataset, model, attempt, CASE WHEN primary_metric = 'RMSE' THEN primary_metric_value
  ELSE -primary_metric_value END AS search_loss FROM v_metrics""", ("v_metrics",))
def h14(spark, d):
    from evalspark.functions import taxonomy as T
    m = V.v_metrics(spark, d)
    loss = T.comparison_score("primary_metric_value", F.coalesce(T.metric_lower_is_better("primary_metric"), F.lit(True)))
    return m.select("run_name", "dataset", "model", "attempt", loss.alias("search_loss"))


@query("e3_average_rank", f"""
SELECT dataset, model, row_id, {AVG_RANK.format(p='dataset, model', v='predicted')} AS rank_up,
  count(*) OVER (PARTITION BY dataset, model) + 1 - ({AVG_RANK.format(p='dataset, model', v='predicted')}) AS rank_down
FROM v_pred""".replace("2.0", "2.0::DOUBLE"), ("v_pred",))
def e3(spark, d):
    p = V.v_pred(spark, d).select("dataset", "model", "row_id", "predicted")
    k = O.ranks(p, ["dataset", "model"], "predicted")
    j = O.key_join(p, k, ["dataset", "model", "predicted"])
    return j.select("dataset", "model", "row_id", F.col("rank_avg").alias("rank_up"),
                    O.descending("rank_avg", "n_rows").alias("rank_down"))
