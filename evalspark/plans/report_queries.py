"""Report tables over metric rows: deduplication, winners, comparisons, coverage, cost, ensembles, ablation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.functions import cleaning as C
from evalspark.functions import taxonomy as T
from evalspark.operators import ordering as O
from evalspark.operators import reports as R
from evalspark.plans import views as V
from evalspark.plans.registry import query, r, rounded
from evalspark.session import durable
from evalspark.plans.rule_queries import COMPONENT_SQL, FAMILY_SQL, METHOD_SQL

VM = ("v_metrics",)
VA = ("v_metrics", "v_analysis")
RD = ["run_name", "dataset"]


def analysis(spark, d):
    a = V.v_analysis(spark, d)
    return a.withColumns({"family": T.architecture_family("workflow", "model"),
                          "method": T.ensemble_method("model", "workflow"),
                          "component": T.component_family("model", "workflow")})


AX = f"a AS (SELECT *, {FAMILY_SQL} AS family, {METHOD_SQL} AS method, {COMPONENT_SQL} AS component FROM v_analysis)"
ORD_D1 = ("CASE WHEN lower(trim(error)) NOT IN ('', 'nan', 'none') THEN 1 ELSE 0 END, "
          "CASE WHEN status LIKE 'skipped%' THEN 1 ELSE 0 END, coalesce(test_rmse, 'inf'::DOUBLE), -last_order, run_name, attempt")


# --- D: aggregations -------------------------------------------------------------------------------------------

@query("d1_metric_dedupe", f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY dataset, model, workflow ORDER BY {ORD_D1}) AS rn FROM v_metrics)
SELECT dataset, model, workflow, arg_min(primary_metric_value, rn) AS primary_metric_value,
 arg_min(test_rmse, rn) FILTER (test_rmse IS NOT NULL) AS test_rmse, arg_min(error, rn) FILTER (error IS NOT NULL) AS error,
 arg_min(status, rn) AS status FROM o GROUP BY ALL""", VM)
def d1(spark, d):
    """Composite row: every column takes its own first non-null value."""
    out = R.dedupe_metric_rows(V.v_metrics(spark, d), [-F.col("last_order"), F.col("run_name"), F.col("attempt")])
    return out.select("dataset", "model", "workflow", "primary_metric_value", "test_rmse", "error", "status")


@query("d2_best_row_per_dataset", """
WITH k AS (SELECT *, CASE WHEN primary_metric = 'RMSE' THEN primary_metric_value ELSE -primary_metric_value END AS s
 FROM v_metrics WHERE error IS NULL OR error = 'nan'),
o AS (SELECT *, row_number() OVER (PARTITION BY run_name, dataset ORDER BY s, model, attempt) AS rn FROM k)
SELECT run_name, dataset, model, workflow, attempt, primary_metric_value FROM o WHERE rn = 1""", VM)
def d2(spark, d):
    b = R.best_rows(V.v_metrics(spark, d), RD, [F.col("model"), F.col("attempt")])
    return b.select(*RD, "model", "workflow", "attempt", "primary_metric_value")


@query("d3_best_row_by_score_then_name", """
SELECT run_name, dataset, arg_min(model, (score, model)) AS model, arg_min(workflow, (score, model)) AS workflow,
 round(min(score), 6) AS score FROM v_analysis GROUP BY ALL""", VA)
def d3(spark, d):
    b = R.best_by_score(V.v_analysis(spark, d), RD)
    return b.select(*RD, "model", "workflow", r("comparison_score").alias("score"))


REFK = "CASE leaderboard_metric_name WHEN 'RMSE' THEN 'rmse' WHEN 'AUROC' THEN 'roc_auc' ELSE 'spearman' END"


def refs(spark, d):
    return V.v_ref(spark, d).select("dataset", "model", "reference_source", "leaderboard_metric_name",
                                    T.leaderboard_metric_kind("leaderboard_metric_name").alias("kind"),
                                    C.parse_first_float("metric_value").alias("value"))


@query("d4_leaderboard_comparison", f"""
WITH rf AS (SELECT dataset, {REFK} AS kind, min(leaderboard_metric_name) AS lname, min(metric_value_numeric) AS ref
 FROM v_ref WHERE reference_source = 'board' GROUP BY ALL),
m AS (SELECT v.*, lower(replace(primary_metric, '-', '_')) AS pm, lname, ref,
  CASE WHEN v.model LIKE 'Chemprop%' THEN primary_metric_value - ref END AS gap FROM v_metrics v LEFT JOIN rf USING (dataset)),
f AS (SELECT *, max(CASE WHEN gap IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY dataset) AS anyg FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN primary_metric = 'RMSE' THEN primary_metric_value
  ELSE -primary_metric_value END, run_name, model, attempt) AS rn FROM f WHERE (gap IS NOT NULL) = (anyg = 1))
SELECT dataset, model AS best_model, pm AS target_metric, primary_metric_value, round(ref, 4) AS leaderboard_reference,
 round(gap, 6) AS leaderboard_gap FROM o WHERE rn = 1""", ("v_metrics", "v_ref"))
def d4(spark, d):
    ref = (V.v_ref(spark, d).where("reference_source = 'board'").groupBy("dataset")
           .agg(F.min("leaderboard_metric_name").alias("leaderboard_metric_name"),
                F.min("metric_value_numeric").alias("leaderboard_reference")))
    m = V.v_metrics(spark, d).join(ref, "dataset", "left")
    gap = F.when(F.col("model").startswith("Chemprop"), F.col("primary_metric_value") - F.col("leaderboard_reference"))
    m = m.withColumns({"leaderboard_gap": gap, "leaderboard_estimated_rank": F.lit(None).cast("int")})
    out = R.leaderboard_comparison(m, ["run_name", "model", "attempt"])
    return out.select("dataset", F.col("model").alias("best_model"), "target_metric", "primary_metric_value",
                      r("leaderboard_reference", 4).alias("leaderboard_reference"), r("leaderboard_gap").alias("leaderboard_gap"))


@query("d5_reference_comparison", f"""
WITH rf AS (SELECT dataset, {REFK} AS kind, metric_value_numeric AS v, reference_source FROM v_ref),
b AS (SELECT dataset, CASE primary_metric WHEN 'RMSE' THEN 'rmse' WHEN 'ROC-AUC' THEN 'roc_auc' ELSE 'spearman' END AS kind,
  arg_min(model, (CASE WHEN primary_metric = 'RMSE' THEN primary_metric_value ELSE -primary_metric_value END, model, run_name, attempt)) AS best_model,
  min(CASE WHEN primary_metric = 'RMSE' THEN primary_metric_value ELSE -primary_metric_value END) AS s
  FROM v_metrics WHERE error IS NULL OR error = 'nan' GROUP BY ALL),
g AS (SELECT b.dataset, b.kind, best_model, CASE WHEN b.kind = 'rmse' THEN s ELSE -s END AS best_value,
  list(CASE WHEN b.kind = 'rmse' THEN v ELSE -v END ORDER BY CASE WHEN b.kind = 'rmse' THEN v ELSE -v END) AS vals, s,
  string_agg(DISTINCT reference_source, '; ' ORDER BY reference_source) AS sources
  FROM b JOIN rf ON b.dataset = rf.dataset AND b.kind = rf.kind GROUP BY b.dataset, b.kind, best_model, s)
SELECT dataset, kind, best_model, best_value, CASE WHEN kind = 'rmse' THEN 'lower' ELSE 'higher' END AS direction,
 abs(vals[1]) AS leaderboard_top1, abs(vals[least(10, len(vals))]) AS leaderboard_top10_cutoff,
 len(vals) AS known_reference_count, sources AS reference_sources,
 least(1 + len(list_filter(vals, lambda x: x < s)), 11) AS estimated_rank_vs_top10,
 1 + len(list_filter(vals, lambda x: x < s)) <= 10 AS in_top10_estimate,
 round(s - vals[1], 6) AS gap_to_top1, round(s - vals[least(10, len(vals))], 6) AS gap_to_top10_cutoff FROM g""",
       ("v_metrics", "v_ref"))
def d5(spark, d):
    m = V.v_metrics(spark, d).where(~C.has_error("error")).withColumn("kind", T.leaderboard_metric_kind("primary_metric"))
    s = T.comparison_score("primary_metric_value", T.leaderboard_direction("kind") == "lower")
    best = O.best_row(m, ["dataset", "kind"], [s, F.col("model"), F.col("run_name"), F.col("attempt")]).select(
        "dataset", "kind", F.col("model").alias("best_model"), F.col("primary_metric_value").alias("best_value"))
    out = R.compare_with_reference(best, refs(spark, d))
    return rounded(out, "gap_to_top1", "gap_to_top10_cutoff")


@query("d6_cross_dataset_model_summary", """
SELECT workflow, model, count(DISTINCT dataset) AS datasets,
 count(DISTINCT CASE WHEN task_kind = 'regression' THEN dataset END) AS regression_datasets,
 count(DISTINCT CASE WHEN task_kind = 'classification' THEN dataset END) AS classification_datasets,
 round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.5), 6) AS median_delta, round(avg(test_rmse), 6) AS mean_rmse,
 round(avg(CASE WHEN task_kind = 'classification' THEN value END), 6) AS mean_classification_metric
FROM v_analysis GROUP BY ALL""", VA)
def d6(spark, d):
    return rounded(R.model_summary(V.v_analysis(spark, d)), "mean_delta", "median_delta", "mean_rmse",
                   "mean_classification_metric")


WIN = f"""{AX}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_name, dataset ORDER BY score, model) AS rn FROM a)
 WHERE rn = 1)"""


@query("d7_winner_counts", f"""WITH {WIN},
g AS (SELECT family, count(DISTINCT dataset) AS winning_datasets, count(*) FILTER (task_kind = 'regression') AS regression_wins,
 count(*) FILTER (task_kind = 'classification') AS classification_wins FROM w GROUP BY family)
SELECT *, round(winning_datasets / greatest(CAST(sum(winning_datasets) OVER () AS DOUBLE), 1), 6) AS win_fraction FROM g""", VA)
def d7(spark, d):
    return rounded(R.winner_counts(R.best_by_score(analysis(spark, d), RD), ["family"]), "win_fraction")


@query("d8_family_coverage", f"""WITH {AX}
SELECT family, count(DISTINCT dataset) AS datasets, count(DISTINCT model) AS models, count(*) AS n_rows,
 round(avg(delta), 6) AS mean_delta, round(avg(test_rmse), 6) AS mean_rmse FROM a GROUP BY family""", VA)
def d8(spark, d):
    return rounded(R.family_coverage(analysis(spark, d), "family"), "mean_delta", "mean_rmse")


@query("d9_keep_first_keep_last", """
WITH h AS (SELECT md5(text) AS text_hash, doc_id, source FROM documents)
SELECT text_hash, min(doc_id) AS first_id, arg_min(source, doc_id) AS first_source, max(doc_id) AS last_id,
 arg_max(source, doc_id) AS last_source FROM h GROUP BY text_hash""")
def d9(spark, d):
    h = V.table(spark, d, "documents").select(F.md5("text").alias("text_hash"), "doc_id", "source")
    a = O.dedupe(h, ["text_hash"], ["doc_id"]).withColumnsRenamed({"doc_id": "first_id", "source": "first_source"})
    b = O.dedupe(h, ["text_hash"], ["doc_id"], "last").withColumnsRenamed({"doc_id": "last_id", "source": "last_source"})
    return a.join(b, "text_hash")


@query("d10_collapse_duplicates", """
SELECT dataset, md5(entity_key) AS key_hash, count(*) AS n_rows, round(avg(target), 6) AS target FROM v_entity GROUP BY ALL""",
       ("v_entity",))
def d10(spark, d):
    """Texts shuffle as digests: the key's content is needed once, at the end of the caller's job."""
    e = V.v_entity(spark, d).select("dataset", F.md5("entity_key").alias("key_hash"), "target")
    return e.groupBy("dataset", "key_hash").agg(F.count(F.lit(1)).alias("n_rows"), r(F.avg("target")).alias("target"))


PIVOT_MODELS = ["Random Forest", "SVR", "CatBoost", "KNN"]


@query("d11_pivot_models", """
SELECT run_name, dataset, """ + ", ".join(
    f"coalesce(round(avg(value) FILTER (model = '{m}'), 6), -1) AS \"{m.lower().replace(' ', '_')}\"" for m in PIVOT_MODELS) + """
FROM v_analysis GROUP BY run_name, dataset""", VA)
def d11(spark, d):
    p = (V.v_analysis(spark, d).groupBy(*RD).pivot("model", PIVOT_MODELS)
         .agg(F.round(F.avg("analysis_metric_value"), 6)).fillna(-1.0))
    return p.withColumnsRenamed({m: m.lower().replace(" ", "_") for m in PIVOT_MODELS})


@query("d11b_all_model_means", """
SELECT run_name, dataset, model, round(avg(value), 6) AS mean_value FROM v_analysis GROUP BY run_name, dataset, model""", VA)
def d11b(spark, d):
    """The values of d11 for every model of v_analysis, in long form."""
    return V.v_analysis(spark, d).groupBy(*RD, "model").agg(F.round(F.avg("analysis_metric_value"), 6).alias("mean_value"))


@query("d12_presence_and_best_rank", f"""WITH {AX},
k AS (SELECT run_name || dataset AS run_dataset, family, rank() OVER (PARTITION BY run_name, dataset ORDER BY delta) AS rk FROM a),
b AS (SELECT run_dataset, family, min(rk) AS best_rank FROM k GROUP BY ALL),
g AS (SELECT DISTINCT k1.run_dataset, k2.family FROM (SELECT DISTINCT run_dataset FROM k) k1 CROSS JOIN (SELECT DISTINCT family FROM k) k2)
SELECT g.run_dataset, g.family, CASE WHEN b.best_rank IS NULL THEN 0 ELSE 1 END AS present, best_rank,
 round(avg(CASE WHEN b.best_rank IS NULL THEN 0.0::DOUBLE ELSE 1 END) OVER (PARTITION BY g.run_dataset), 6) AS coverage
FROM g LEFT JOIN b ON g.run_dataset = b.run_dataset AND g.family = b.family""", VA)
def d12(spark, d):
    a = analysis(spark, d).withColumn("run_dataset", F.concat("run_name", "dataset"))
    rk = F.rank().over(Window.partitionBy("run_dataset").orderBy("analysis_delta_from_best"))
    best = a.withColumn("rk", rk).groupBy("run_dataset", "family").agg(F.min("rk").alias("best_rank"))
    p = R.presence(a, "run_dataset", "family").join(best, ["run_dataset", "family"], "left")
    cov = F.avg(F.col("present").cast("double")).over(Window.partitionBy("run_dataset"))
    return p.select("run_dataset", "family", "present", "best_rank", r(cov).alias("coverage"))


@query("d13_first_non_empty_values", """
SELECT dataset, arg_min(trim(error), (run_name, model, attempt)) FILTER (lower(trim(error)) NOT IN ('', 'nan', 'none')) AS error,
 arg_min(status, (run_name, model, attempt)) AS status FROM v_metrics GROUP BY dataset""", VM)
def d13(spark, d):
    return R.first_non_empty(V.v_metrics(spark, d), ["dataset"], ["error", "status"],
                             [F.col("run_name"), F.col("model"), F.col("attempt")])


@query("d14_most_common_value", """
WITH c AS (SELECT l_shipdate::DATE AS day, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS day, arg_min(l_partkey, (-n, l_partkey)) AS l_partkey, max(n) AS n_rows FROM c GROUP BY day""")
def d14(spark, d):
    li = V.table(spark, d, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("day"), "l_partkey")
    return R.most_common(li, ["day"], "l_partkey")


@query("d15_model_value_report", """
WITH b AS (SELECT *, row_number() OVER (PARTITION BY run_name, dataset ORDER BY CASE WHEN primary_metric = 'RMSE'
   THEN primary_metric_value ELSE -primary_metric_value END, model, attempt) AS rn FROM v_metrics WHERE error IS NULL OR error = 'nan'),
t AS (SELECT model, count(DISTINCT dataset) AS top1_datasets FROM b WHERE rn = 1 GROUP BY model),
w AS (SELECT model, run_name, dataset, CASE WHEN delta <= 0.5 THEN 0.5 - delta ELSE 0 END AS weight FROM v_analysis),
u AS (SELECT model, count(*) AS member_rows, count(*) FILTER (abs(weight) > 1e-12) AS nonzero_rows, round(avg(abs(weight)), 6) AS mean_abs_weight
 FROM w GROUP BY model),
c AS (SELECT model, count(DISTINCT dataset) AS attempted_datasets,
 count(DISTINCT CASE WHEN error IS NULL OR error = 'nan' THEN dataset END) AS successful_datasets FROM v_metrics GROUP BY model)
SELECT c.model, attempted_datasets, successful_datasets, coalesce(top1_datasets, 0) AS top1_datasets, coalesce(member_rows, 0) AS member_rows,
 coalesce(nonzero_rows, 0) AS nonzero_rows, coalesce(mean_abs_weight, 0) AS mean_abs_weight,
 coalesce(top1_datasets, 0) = 0 AND coalesce(nonzero_rows, 0) = 0 AS never_useful
FROM c LEFT JOIN t ON t.model = c.model LEFT JOIN u ON u.model = c.model""", VA)
def d15(spark, d):
    m = V.v_metrics(spark, d)
    tried = m.groupBy("model").agg(
        F.count_distinct("dataset").alias("attempted_datasets"),
        F.count_distinct(F.when(~C.has_error("error"), F.col("dataset"))).alias("successful_datasets"))
    top = R.best_rows(m, RD, [F.col("model"), F.col("attempt")]).groupBy("model").agg(
        F.count_distinct("dataset").alias("top1_datasets"))
    delta = F.col("analysis_delta_from_best")
    w = V.v_analysis(spark, d).select("model", F.when(delta <= 0.5, 0.5 - delta).otherwise(0.0).alias("weight"))
    use = w.groupBy("model").agg(F.count(F.lit(1)).alias("member_rows"),
                                 F.count_if(F.abs("weight") > 1e-12).alias("nonzero_rows"),
                                 r(F.avg(F.abs("weight"))).alias("mean_abs_weight"))
    out = tried.join(top, "model", "left").join(use, "model", "left").fillna(0)
    return out.withColumn("never_useful", (F.col("top1_datasets") == 0) & (F.col("nonzero_rows") == 0))


# Selector tables: one coefficient row per (dataset = part type, feature = supplier of the part).
SELECTOR_SQL = """s AS (SELECT p_type AS dataset, concat(CASE l_suppkey % 4 WHEN 0 THEN 'morgan_bit_' WHEN 1 THEN 'rdkit_' WHEN 2 THEN 'maccs_bit_'
  ELSE 'aux_' END, CAST(l_suppkey AS VARCHAR)) AS feature, avg(l_discount - 0.05) * 100 AS coefficient
 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type, l_suppkey),
f AS (SELECT *, CASE WHEN feature LIKE 'morgan%' THEN 'morgan' WHEN feature LIKE 'rdkit%' THEN 'rdkit' WHEN feature LIKE 'maccs%' THEN 'maccs'
 ELSE 'other' END AS family, abs(coefficient) AS magnitude, abs(coefficient) > 0.1 AS is_selected FROM s),
g AS (SELECT dataset, family, count(*) AS available_features, count(*) FILTER (is_selected) AS selected_features,
 coalesce(sum(magnitude) FILTER (is_selected), 0) AS selected_magnitude FROM f GROUP BY ALL)"""


def selector(spark, d):
    from evalspark.functions.columns import magnitude
    li = V.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_discount")
    part = V.table(spark, d, "part").select("p_partkey", "p_type")
    kind = F.col("l_suppkey") % 4
    prefix = F.when(kind == 0, "morgan_bit_").when(kind == 1, "rdkit_").when(kind == 2, "maccs_bit_").otherwise("aux_")
    s = (li.join(part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_type").alias("dataset"), "l_suppkey")
         .agg((F.avg(F.col("l_discount") - 0.05) * 100).alias("coefficient"))
         .select("dataset", F.concat(prefix, F.col("l_suppkey").cast("string")).alias("feature"), "coefficient"))
    chosen = s.where(F.abs("coefficient") > 0.1).select("dataset", "feature").withColumn("_hit", F.lit(True))
    return (s.withColumns({"family": T.feature_family("feature"), "magnitude": magnitude(s.columns)})
            .join(chosen, ["dataset", "feature"], "left")
            .withColumn("is_selected", F.col("_hit").isNotNull()).drop("_hit"))


def selector_families(spark, d):
    sel = F.col("is_selected")
    return selector(spark, d).groupBy("dataset", "family").agg(
        F.count(F.lit(1)).alias("available_features"), F.count_if(sel).alias("selected_features"),
        F.coalesce(F.sum(F.when(sel, F.col("magnitude"))), F.lit(0.0)).alias("selected_magnitude"))


@query("d16_selector_family_enrichment", f"""WITH {SELECTOR_SQL},
k AS (SELECT family, count(DISTINCT dataset) AS datasets_with_family, count(*) FILTER (selected_features > 0) AS datasets_selected,
 CAST(sum(available_features) AS DOUBLE) AS available, CAST(sum(selected_features) AS DOUBLE) AS selected,
 quantile_cont(CAST(selected_features AS DOUBLE), 0.5) AS median_selected, sum(selected_magnitude) AS magnitude FROM g GROUP BY family)
SELECT family, datasets_with_family, datasets_selected, available, selected, median_selected,
 round(datasets_selected / datasets_with_family, 6) AS presence_rate, round(selected / available, 6) AS selection_rate,
 round(selected / (available / sum(available) OVER () * sum(selected) OVER ()), 6) AS enrichment,
 round(selected / sum(selected) OVER (), 6) AS selected_share, round(magnitude / sum(magnitude) OVER (), 5) AS magnitude_share,
 datasets_selected / datasets_with_family >= 0.5 AND selected / (available / sum(available) OVER () * sum(selected) OVER ()) <= 1 AS watch
FROM k""")
def d16(spark, d):
    g = selector_families(spark, d).groupBy("family").agg(
        F.count_distinct("dataset").alias("datasets_with_family"), F.count_if(F.col("selected_features") > 0).alias("datasets_selected"),
        F.sum("available_features").cast("double").alias("available"), F.sum("selected_features").cast("double").alias("selected"),
        R.median("selected_features").alias("median_selected"), F.sum("selected_magnitude").alias("_mag"))
    w = Window.partitionBy(F.lit(0))  # a handful of families
    expected = F.col("available") / F.sum("available").over(w) * F.sum("selected").over(w)
    enrich = C.safe_ratio("selected", expected)
    rate = C.safe_ratio("datasets_selected", "datasets_with_family")
    return g.select("family", "datasets_with_family", "datasets_selected", "available", "selected", "median_selected",
                    r(rate).alias("presence_rate"), r(C.safe_ratio("selected", "available")).alias("selection_rate"),
                    r(enrich).alias("enrichment"), r(F.col("selected") / F.sum("selected").over(w)).alias("selected_share"),
                    r(F.col("_mag") / F.sum("_mag").over(w), 5).alias("magnitude_share"),
                    ((rate >= 0.5) & (enrich <= 1)).alias("watch"))


@query("d17_importance_share_and_rank", f"""WITH {SELECTOR_SQL},
h AS (SELECT dataset, family, CASE WHEN selected_magnitude > 0 THEN selected_magnitude ELSE selected_features END AS weight FROM g),
k AS (SELECT *, weight / nullif(sum(weight) OVER (PARTITION BY dataset), 0) AS share FROM h)
SELECT dataset, family, round(share, 5) AS share, rank() OVER (PARTITION BY dataset ORDER BY share DESC) AS family_rank FROM k""")
def d17(spark, d):
    g = selector_families(spark, d)
    weight = F.when(F.col("selected_magnitude") > 0, F.col("selected_magnitude")).otherwise(F.col("selected_features"))
    w = Window.partitionBy("dataset")
    k = g.withColumn("weight", weight).withColumn("share", C.safe_ratio("weight", F.sum("weight").over(w)))
    return k.select("dataset", "family", r("share", 5).alias("share"),
                    F.rank().over(w.orderBy(F.desc("share"))).alias("family_rank"))


@query("d18_run_cost_summary", """
WITH p AS (SELECT run_name, dataset, max(elapsed_seconds) AS mx, count(*) FILTER (status = 'completed') AS done FROM v_metrics GROUP BY ALL),
b AS (SELECT run_name, dataset, min(test_rmse) AS best FROM v_metrics GROUP BY ALL),
m AS (SELECT run_name, count(DISTINCT model) AS models FROM v_metrics GROUP BY run_name)
SELECT p.run_name, count(*) AS datasets, count(*) FILTER (done > 0) AS completed_datasets, max(models) AS models,
 sum(mx) AS total_elapsed_seconds, round(sum(mx) / 3600, 6) AS total_elapsed_hours, round(avg(best), 6) AS mean_best_rmse,
 round(quantile_cont(best, 0.5), 6) AS median_best_rmse, round(avg(CASE WHEN best < 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate
FROM p JOIN b ON p.run_name = b.run_name AND p.dataset = b.dataset JOIN m ON m.run_name = p.run_name GROUP BY p.run_name""", VM)
def d18(spark, d):
    m = V.v_metrics(spark, d)
    per = m.groupBy(*RD).agg(F.max("elapsed_seconds").alias("mx"), F.count_if(F.col("status") == "completed").alias("done"),
                             F.min("test_rmse").alias("best"), F.collect_set("model").alias("ms"))
    models = per.select("run_name", F.explode("ms").alias("model")).groupBy("run_name").agg(
        F.count_distinct("model").alias("models"))
    g = per.groupBy("run_name").agg(
        F.count(F.lit(1)).alias("datasets"), F.count_if(F.col("done") > 0).alias("completed_datasets"),
        F.sum("mx").alias("total_elapsed_seconds"), r(F.sum("mx") / 3600).alias("total_elapsed_hours"),
        r(F.avg("best")).alias("mean_best_rmse"), r(R.median("best")).alias("median_best_rmse"),
        r(F.avg(F.when(F.col("best") < 3, 1.0).otherwise(0.0))).alias("hit_rate"))
    return g.join(models, "run_name")


@query("d19_selector_time_attribution", """
WITH s AS (SELECT event_type AS dataset, sum(value) AS secs FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
k AS (SELECT event_type AS dataset, bool_or(value > 340) AS timed_out, min(value) AS first_elapsed, max(value) AS cap FROM events GROUP BY 1)
SELECT k.dataset, round(coalesce(s.secs, CASE WHEN timed_out THEN cap END, first_elapsed), 4) AS selector_seconds,
 CASE WHEN s.secs IS NOT NULL THEN 'stage_runtime' WHEN timed_out THEN 'selector_timeout_cap' ELSE 'first_model_elapsed_proxy' END AS source
FROM k LEFT JOIN s ON s.dataset = k.dataset""")
def d19(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("dataset"), "value")
    stage = e.where(F.col("dataset").rlike("click|view")).groupBy("dataset").agg(R.sum_or_null("value").alias("secs"))
    k = e.groupBy("dataset").agg(F.bool_or(F.col("value") > 340).alias("timed_out"), F.min("value").alias("first"),
                                 F.max("value").alias("cap"))
    j = k.join(stage, "dataset", "left")
    return j.select("dataset", r(F.coalesce("secs", F.when(F.col("timed_out"), F.col("cap")), "first"), 4).alias("selector_seconds"),
                    F.when(F.col("secs").isNotNull(), "stage_runtime").when(F.col("timed_out"), "selector_timeout_cap")
                    .otherwise("first_model_elapsed_proxy").alias("source"))


@query("d20_sum_of_nulls_is_null", """
SELECT run_name, dataset, round(sum(test_roc_auc), 4) AS auc_sum, round(sum(test_rmse), 4) AS rmse_sum FROM v_metrics GROUP BY ALL""", VM)
def d20(spark, d):
    return V.v_metrics(spark, d).groupBy(*RD).agg(r(R.sum_or_null("test_roc_auc"), 4).alias("auc_sum"),
                                                  r(R.sum_or_null("test_rmse"), 4).alias("rmse_sum"))


@query("d21_model_cost_summary", """
WITH f AS (SELECT CASE WHEN workflow = 'CFA' THEN 'CFA' WHEN workflow = 'Ensemble' THEN 'Ensemble' WHEN workflow = 'MapLight + GNN' THEN 'MapLight+GNN'
  WHEN workflow = 'Chemprop v2' THEN 'Chemprop' WHEN model = 'TabPFN' THEN 'TabPFN' WHEN workflow = 'ChemML deep learning' THEN 'Other neural baselines'
  ELSE 'Conventional ML' END AS model_family, * FROM v_analysis)
SELECT model_family, 'current run' AS source, count(DISTINCT dataset) AS datasets, count(*) AS model_rows,
 quantile_cont(elapsed_seconds, 0.5) AS median_seconds, round(avg(elapsed_seconds), 4) AS mean_seconds,
 round(quantile_cont(elapsed_seconds / n_train * 1000, 0.5), 4) AS median_seconds_per_1000 FROM f GROUP BY model_family
UNION ALL SELECT 'External tool', 'published figure', NULL, NULL, NULL, NULL, 11.16""", VA)
def d21(spark, d):
    a = V.v_analysis(spark, d).withColumn("model_family", T.publication_family("model", "workflow"))
    g = a.groupBy("model_family").agg(
        F.lit("current run").alias("source"), F.count_distinct("dataset").alias("datasets"), F.count(F.lit(1)).alias("model_rows"),
        R.median("elapsed_seconds").alias("median_seconds"), r(F.avg("elapsed_seconds"), 4).alias("mean_seconds"),
        r(R.median(C.safe_ratio("elapsed_seconds", "n_train") * 1000), 4).alias("median_seconds_per_1000"))
    fixed = spark.createDataFrame([("External tool", "published figure", 11.16)],
                                  "model_family string, source string, median_seconds_per_1000 double")
    return g.unionByName(fixed, allowMissingColumns=True)


@query("d22_reference_coverage", f"""
WITH rf AS (SELECT dataset, {REFK} AS kind, CASE WHEN leaderboard_metric_name = 'RMSE' THEN metric_value_numeric
  ELSE -metric_value_numeric END AS v, reference_source FROM v_ref)
SELECT dataset, kind, count(*) AS n_rows, abs(min(v)) AS best, abs(list_sort(list(v))[least(10, count(*))]) AS tenth_or_worst,
 string_agg(DISTINCT reference_source, '; ' ORDER BY reference_source) AS sources FROM rf GROUP BY ALL""", ("v_ref",))
def d22(spark, d):
    return R.reference_coverage(refs(spark, d)).withColumnsRenamed({"n_references": "n_rows", "reference_sources": "sources"})


TUNED = """t AS (SELECT *, replace(model, ' GA', '') AS base FROM v_metrics WHERE ends_with(model, ' GA')),
b AS (SELECT * FROM v_metrics WHERE NOT ends_with(model, ' GA')),
j AS (SELECT t.run_name, t.dataset, t.model, t.attempt, b.model AS baseline_model, t.primary_metric, t.primary_metric_value AS tv,
  b.primary_metric_value AS bv, row_number() OVER (PARTITION BY t.run_name, t.dataset, t.model, t.attempt ORDER BY b.attempt, b.model) AS rn
 FROM t JOIN b ON t.run_name = b.run_name AND t.dataset = b.dataset AND b.model IN (t.base, concat('Tuned ', t.base))),
k AS (SELECT *, CASE WHEN primary_metric = 'RMSE' THEN bv - tv ELSE tv - bv END AS delta FROM j WHERE rn = 1)"""


@query("c10_tuned_vs_baseline", f"""WITH {TUNED}
SELECT run_name, dataset, model, attempt, baseline_model, tv AS tuned_value, bv AS baseline_value, round(delta, 6) AS delta,
 round(CASE WHEN abs(bv) > 1e-12 THEN delta / abs(bv) END, 6) AS relative_delta, delta > 0 AS tuned_better FROM k""", VM)
def c10(spark, d):
    out = R.tuned_vs_baseline(V.v_metrics(spark, d), RD, ["attempt"])
    return rounded(out.select(*RD, "model", "attempt", "baseline_model", "tuned_value", "baseline_value", "delta",
                              "relative_delta", "tuned_better"), "delta", "relative_delta")


@query("d23_tuning_summary", f"""WITH {TUNED}
SELECT run_name, model, count(DISTINCT dataset) AS datasets_compared, count(*) FILTER (delta > 0) AS wins, round(avg(delta), 6) AS mean_delta,
 round(quantile_cont(delta, 0.5), 6) AS median_delta, round(avg(CASE WHEN abs(bv) > 1e-12 THEN delta / abs(bv) END), 6) AS mean_relative_delta,
 round(count(*) FILTER (delta > 0) / nullif(count(DISTINCT dataset), 0), 6) AS win_rate FROM k GROUP BY run_name, model""", VM)
def d23(spark, d):
    t = R.tuned_vs_baseline(V.v_metrics(spark, d), RD, ["attempt"])
    wins, n = F.count_if("tuned_better"), F.count_distinct("dataset")
    return t.groupBy("run_name", "model").agg(
        n.alias("datasets_compared"), wins.alias("wins"), r(F.avg("delta")).alias("mean_delta"),
        r(R.median("delta")).alias("median_delta"), r(F.avg("relative_delta")).alias("mean_relative_delta"),
        r(wins / n).alias("win_rate"))


@query("d24_useful_tuned_models", """
WITH ok AS (SELECT *, CASE WHEN primary_metric = 'RMSE' THEN primary_metric_value ELSE -primary_metric_value END AS s FROM v_metrics
  WHERE error IS NULL OR error = 'nan'),
o AS (SELECT *, row_number() OVER (PARTITION BY run_name, dataset ORDER BY s, model, attempt) AS rn FROM ok),
w AS (SELECT replace(model, ' GA', '') AS base_model, count(*) AS dataset_wins FROM o WHERE rn = 1 AND workflow = 'ga_tuned' GROUP BY 1),
b AS (SELECT run_name, dataset, model AS base_model, min(s) AS bs FROM ok GROUP BY ALL),
g AS (SELECT run_name, dataset, replace(model, ' GA', '') AS base_model, s FROM ok WHERE workflow = 'ga_tuned'),
i AS (SELECT g.base_model, count(DISTINCT (g.run_name, g.dataset)) AS improving_datasets FROM g JOIN b ON g.run_name = b.run_name
  AND g.dataset = b.dataset AND g.base_model = b.base_model WHERE bs - s > 0 AND (bs - s) / abs(bs) >= 0.005 GROUP BY 1)
SELECT coalesce(w.base_model, i.base_model) AS base_model, coalesce(dataset_wins, 0) AS dataset_wins,
 coalesce(improving_datasets, 0) AS improving_datasets FROM w FULL JOIN i ON w.base_model = i.base_model""", VM)
def d24(spark, d):
    return R.useful_tuned_models(V.v_metrics(spark, d), RD, [F.col("model"), F.col("attempt")])


@query("d25_class_balance_profile", """
WITH u AS (SELECT DISTINCT dataset, observed, d.doc_id, md5(d.text) AS h, d.source FROM v_binary b JOIN documents d ON d.doc_id = b.row_id)
SELECT dataset, count(*) AS unique_rows, count(DISTINCT observed) AS observed_values, round(avg(observed), 6) AS positive_fraction,
 round(least(avg(observed), 1 - avg(observed)), 6) AS minority_fraction, count(DISTINCT source) AS group_count,
 round(count(DISTINCT source) / count(DISTINCT h), 6) AS group_diversity FROM u GROUP BY dataset""", ("v_binary",))
def d25(spark, d):
    b = V.v_binary(spark, d).select("dataset", "row_id", "observed").distinct()
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), F.md5("text").alias("h"), "source")
    u = b.join(docs, "row_id")
    g = u.groupBy("dataset").agg(F.count(F.lit(1)).alias("unique_rows"), F.count_distinct("observed").alias("observed_values"),
                                 F.avg("observed").alias("p"), F.count_distinct("source").alias("group_count"),
                                 F.count_distinct("h").alias("_keys"))
    return g.select("dataset", "unique_rows", "observed_values", r("p").alias("positive_fraction"),
                    r(F.least("p", 1 - F.col("p"))).alias("minority_fraction"), "group_count",
                    r(C.safe_ratio("group_count", "_keys")).alias("group_diversity"))


@query("d26_dataset_manifest", """
SELECT dataset, count(*) AS n_rows, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows,
 'dataset,model,row_id,entity_key,split,observed,predicted' AS columns FROM v_pred GROUP BY dataset""", ("v_pred",))
def d26(spark, d):
    p = V.v_pred(spark, d)
    return p.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("split") == "train").alias("train_rows"),
                                    F.count_if(F.col("split") == "test").alias("test_rows"),
                                    F.lit(",".join(p.columns)).alias("columns"))


@query("d27_stage_runtime_rollup", """
SELECT user_id, round(sum(value), 4) AS seconds, count(*) AS stages FROM events
WHERE regexp_matches(lower(event_type), 'click|view') GROUP BY user_id""")
def d27(spark, d):
    e = V.table(spark, d, "events").where(F.lower("event_type").rlike("click|view"))
    return e.groupBy("user_id").agg(r(F.sum("value"), 4).alias("seconds"), F.count(F.lit(1)).alias("stages"))


@query("d28_artifact_audit", """
WITH e AS (SELECT lang AS dataset, kind FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (VALUES ('src1'), ('src2'), ('src77')) v(kind)),
f AS (SELECT lang AS dataset, source AS kind, sum(octet_length(encode(text))) AS n_bytes, min(sha256(text)) AS low_sum FROM documents GROUP BY ALL)
SELECT e.dataset, e.kind, f.n_bytes IS NOT NULL AS is_present, CAST(f.n_bytes AS BIGINT) AS n_bytes, low_sum,
 round(avg(CASE WHEN f.n_bytes IS NULL THEN 0.0::DOUBLE ELSE 1 END) OVER (PARTITION BY e.dataset), 6) AS completeness
FROM e LEFT JOIN f ON e.dataset = f.dataset AND e.kind = f.kind""")
def d28(spark, d):
    from evalspark.sources.readers import audit_expected
    docs = V.table(spark, d, "documents").select(F.col("lang").alias("dataset"), F.col("source").alias("kind"),
                                                 F.octet_length("text").alias("length"), F.sha2("text", 256).alias("checksum"))
    found = docs.groupBy("dataset", "kind").agg(F.sum("length").alias("n_bytes"), F.min("checksum").alias("low_sum"))
    expected = spark.createDataFrame([(k,) for k in ("src1", "src2", "src77")], "kind string")
    return rounded(audit_expected(found, docs.select("dataset").distinct(), expected), "completeness")


@query("d29_subgroup_viability", """
SELECT dataset, group_key, count(*) AS train_rows, count(DISTINCT md5(entity_key)) AS unique_keys,
 CASE WHEN count(*) >= 30 AND count(DISTINCT md5(entity_key)) >= 20 THEN 'trained' ELSE 'fallback_global' END AS status,
 CAST(CASE WHEN count(*) >= 30 AND count(DISTINCT md5(entity_key)) >= 20 THEN least(5, count(DISTINCT md5(entity_key)), count(*)) ELSE 0 END AS BIGINT) AS oof_folds
FROM v_entity GROUP BY dataset, group_key""", ("v_entity",))
def d29(spark, d):
    from evalspark.operators.splits import subgroup_plan
    e = V.v_entity(spark, d).select("dataset", "group_key", F.md5("entity_key").alias("key"))
    return subgroup_plan(e, ["dataset", "group_key"], "key", 5)


@query("d30_ensemble_weight_usage", f"""WITH {AX},
w AS (SELECT family, model, run_name, dataset, 1 - delta AS weight, abs(1 - delta) AS aw FROM a)
SELECT family, model, count(DISTINCT dataset) AS datasets, count(*) AS total_rows, round(avg(weight), 6) AS mean_weight,
 round(quantile_cont(weight, 0.5), 6) AS median_weight, round(avg(aw), 6) AS mean_abs_weight, round(quantile_cont(aw, 0.5), 6) AS median_abs_weight,
 round(max(aw), 6) AS max_abs_weight FROM w GROUP BY family, model""", VA)
def d30(spark, d):
    w = analysis(spark, d).withColumn("weight", 1 - F.col("analysis_delta_from_best")).withColumn("aw", F.abs("weight"))
    return w.groupBy("family", "model").agg(
        F.count_distinct("dataset").alias("datasets"), F.count(F.lit(1)).alias("total_rows"), r(F.avg("weight")).alias("mean_weight"),
        r(R.median("weight")).alias("median_weight"), r(F.avg("aw")).alias("mean_abs_weight"),
        r(R.median("aw")).alias("median_abs_weight"), r(F.max("aw")).alias("max_abs_weight"))


EVB = f"""{AX},
e AS (SELECT run_name, dataset, method, min(test_rmse) AS ev FROM a WHERE method IS NOT NULL AND test_rmse IS NOT NULL GROUP BY ALL),
b AS (SELECT run_name, dataset, min(test_rmse) AS bv FROM a WHERE method IS NULL AND test_rmse IS NOT NULL GROUP BY ALL),
j AS (SELECT e.*, bv, ev - bv AS x FROM e JOIN b ON e.run_name = b.run_name AND e.dataset = b.dataset)"""


def with_rmse(spark, d):
    return analysis(spark, d).where("test_rmse IS NOT NULL")


@query("d31_ensemble_vs_best_base", f"""WITH {EVB}
SELECT method, count(*) AS datasets_compared, count(*) FILTER (x < -1e-12) AS beats, count(*) FILTER (abs(x) <= 1e-12) AS ties,
 count(*) FILTER (x > 1e-12) AS losses, round(count(*) FILTER (x < -1e-12) / count(*), 6) AS beats_fraction, round(avg(x), 6) AS mean_delta,
 round(quantile_cont(x, 0.5), 6) AS median_delta, round(stddev_samp(x), 6) AS std_delta, round(min(x), 6) AS min_delta, round(max(x), 6) AS max_delta,
 round(avg(x / bv), 6) AS mean_relative_delta, round(quantile_cont(x / bv, 0.5), 6) AS median_relative_delta FROM j GROUP BY method""", VA)
def d31(spark, d):
    s = R.delta_summary(R.ensemble_vs_base(with_rmse(spark, d), RD, "test_rmse"), ["method"])
    return rounded(s, *[c for c in s.columns if c.endswith(("delta", "fraction"))])


@query("d32_method_head_to_head", f"""WITH {EVB},
p AS (SELECT x.method AS method_a, y.method AS method_b, x.ev - y.ev AS x FROM e x JOIN e y ON x.run_name = y.run_name AND x.dataset = y.dataset
  AND x.method < y.method)
SELECT method_a, method_b, count(*) AS datasets_compared, count(*) FILTER (x < -1e-12) AS method_a_wins, count(*) FILTER (x > 1e-12) AS method_b_wins,
 count(*) FILTER (abs(x) <= 1e-12) AS ties, round(avg(x), 6) AS mean_delta, round(quantile_cont(x, 0.5), 6) AS median_delta FROM p GROUP BY ALL""", VA)
def d32(spark, d):
    e = with_rmse(spark, d).where("method IS NOT NULL").groupBy(*RD, "method").agg(F.min("test_rmse").alias("v"))
    return rounded(R.head_to_head(e, RD, "v"), "mean_delta", "median_delta")


@query("d32_method_overall_superiority", f"""WITH {EVB},
p AS (SELECT x.method AS method, x.ev - y.ev AS x FROM e x JOIN e y ON x.run_name = y.run_name AND x.dataset = y.dataset AND x.method <> y.method)
SELECT method, count(*) FILTER (x < -1e-12) AS pairwise_wins, count(*) FILTER (x > 1e-12) AS pairwise_losses,
 count(*) FILTER (abs(x) <= 1e-12) AS pairwise_ties, count(*) AS pairwise_compared,
 round(count(*) FILTER (x < -1e-12) / count(*), 6) AS pairwise_win_fraction FROM p GROUP BY method""", VA)
def d32b(spark, d):
    e = with_rmse(spark, d).where("method IS NOT NULL").groupBy(*RD, "method").agg(F.min("test_rmse").alias("v"))
    return rounded(R.overall_superiority(R.head_to_head(e, RD, "v")), "pairwise_win_fraction")


@query("d33_fractional_dataset_wins", f"""WITH {EVB},
u AS (SELECT run_name, dataset, method, round(ev, 1) AS v FROM e UNION ALL SELECT run_name, dataset, 'Best base model', round(bv, 1) FROM b),
m AS (SELECT *, min(v) OVER (PARTITION BY run_name, dataset) AS mn FROM u),
t AS (SELECT method, 1.0::DOUBLE / count(*) OVER (PARTITION BY run_name, dataset) AS s FROM m WHERE abs(v - mn) <= 1e-12),
n AS (SELECT count(DISTINCT (run_name, dataset)) AS datasets_considered FROM u)
SELECT k.method, coalesce(round((SELECT sum(s) FROM t WHERE t.method = k.method), 6), 0) AS weighted_wins, datasets_considered,
 coalesce(round((SELECT sum(s) FROM t WHERE t.method = k.method) / datasets_considered, 6), 0) AS weighted_win_fraction
FROM (SELECT DISTINCT method FROM u) k CROSS JOIN n""", VA)
def d33(spark, d):
    a = with_rmse(spark, d).withColumn("method", F.coalesce("method", F.lit("Best base model")))
    v = a.groupBy(*RD, "method").agg(F.round(F.min("test_rmse"), 1).alias("v"))
    return rounded(R.fractional_wins(v, RD, "method", "v"), "weighted_wins", "weighted_win_fraction")


@query("d34_ensemble_value_add", f"""WITH {AX},
rk AS (SELECT *, rank() OVER (PARTITION BY run_name, dataset ORDER BY score) AS rank_in FROM a),
b AS (SELECT run_name, dataset, min(score) AS bs FROM a WHERE method IS NULL GROUP BY ALL),
c AS (SELECT a.run_name, a.dataset, count(DISTINCT a.model) AS competitive FROM a JOIN b ON a.run_name = b.run_name AND a.dataset = b.dataset
  WHERE a.method IS NULL AND a.score - b.bs <= greatest(0.05 * abs(b.bs), 1e-12) GROUP BY ALL),
e AS (SELECT run_name, dataset, method, task_kind, min(score) AS es, min(rank_in) AS er FROM rk WHERE method IS NOT NULL GROUP BY ALL)
SELECT method, task_kind, count(*) AS n_pairs, count(*) FILTER (er <= 1) AS wins_dataset, count(*) FILTER (er <= 3) AS top3,
 count(*) FILTER (bs - es > 1e-12) AS beats_best_base, round(quantile_cont(CAST(er AS DOUBLE), 0.5), 6) AS median_rank, round(avg(bs - es), 6) AS mean_improvement,
 round(quantile_cont((bs - es) / greatest(abs(bs), 1e-12), 0.5), 6) AS median_relative_improvement,
 quantile_cont(CAST(competitive AS DOUBLE), 0.5) AS median_competitive
FROM e JOIN b ON e.run_name = b.run_name AND e.dataset = b.dataset JOIN c ON c.run_name = e.run_name AND c.dataset = e.dataset GROUP BY ALL""", VA)
def d34(spark, d):
    a = analysis(spark, d).withColumn("rank_in", F.rank().over(Window.partitionBy(*RD).orderBy("comparison_score")))
    base = a.where("method IS NULL")
    b = base.groupBy(*RD).agg(F.min("comparison_score").alias("bs"))
    band = F.greatest(0.05 * F.abs("bs"), F.lit(R.EPS))
    c = base.join(b, RD).where(F.col("comparison_score") - F.col("bs") <= band).groupBy(*RD).agg(
        F.count_distinct("model").alias("competitive"))
    e = a.where("method IS NOT NULL").groupBy(*RD, "method", "task_kind").agg(
        F.min("comparison_score").alias("es"), F.min("rank_in").alias("er"))
    gain = F.col("bs") - F.col("es")
    return e.join(b, RD).join(c, RD).groupBy("method", "task_kind").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("er") <= 1).alias("wins_dataset"), F.count_if(F.col("er") <= 3).alias("top3"),
        F.count_if(gain > R.EPS).alias("beats_best_base"), r(R.median("er")).alias("median_rank"), r(F.avg(gain)).alias("mean_improvement"),
        r(R.median(gain / F.greatest(F.abs("bs"), F.lit(R.EPS)))).alias("median_relative_improvement"),
        R.median("competitive").alias("median_competitive"))


STAGED = f"""{AX},
st AS (SELECT * FROM (VALUES (1, 'Conventional ML only', 'conventional_ml'), (2, '+ MapLight classic features', 'maplight_classic'),
  (3, '+ neural/deep backends', 'deep_backend'), (4, '+ CFA fusion', 'cfa'), (5, 'Full pipeline incl. ensembles', 'ensemble')) t(o, stage, comp)),
o AS (SELECT a.*, s2.o AS stage_order, s2.stage, row_number() OVER (PARTITION BY run_name, dataset, s2.o ORDER BY score, model) AS rn
 FROM a JOIN st s1 ON s1.comp = a.component JOIN st s2 ON s2.o >= s1.o),
l AS (SELECT *, lag(score) OVER w AS ps, lag(value) OVER w AS pv, lag(model) OVER w AS pm FROM o WHERE rn = 1
 WINDOW w AS (PARTITION BY run_name, dataset ORDER BY stage_order)),
x AS (SELECT run_name, dataset, stage_order, stage, model, ps - score AS gain, (ps - score) / greatest(abs(pv), 1e-12) AS rel,
 coalesce(pm <> model, false) AS changed, coalesce(ps - score > 1e-12, false) AS improved FROM l)"""


@query("d35_staged_ablation", f"""WITH {STAGED}
SELECT run_name, dataset, stage_order, stage, model, round(gain, 6) AS marginal_gain, round(rel, 6) AS marginal_relative_gain,
 changed AS winner_changed, improved FROM x""", VA)
def d35(spark, d):
    s = R.staged_ablation(analysis(spark, d), RD)
    return rounded(s.select(*RD, "stage_order", "stage", "model", "marginal_gain", "marginal_relative_gain", "winner_changed",
                            "improved"), "marginal_gain", "marginal_relative_gain")


@query("d35_ablation_summary", f"""WITH {STAGED}
SELECT stage_order, stage, count(DISTINCT dataset) AS datasets_evaluated, count(*) FILTER (improved) AS datasets_improved,
 count(*) FILTER (changed) AS datasets_changed_winner, round(quantile_cont(gain, 0.5), 6) AS median_gain, round(avg(gain), 6) AS mean_gain,
 round(quantile_cont(rel, 0.5), 6) AS median_relative_gain, round(count(*) FILTER (improved) / count(DISTINCT dataset), 6) AS improvement_fraction
FROM x GROUP BY ALL""", VA)
def d35b(spark, d):
    return rounded(R.ablation_summary(R.staged_ablation(analysis(spark, d), RD)), "median_gain", "mean_gain",
                   "median_relative_gain", "improvement_fraction")


@query("d36_family_difficulty_profile", f"""WITH {WIN},
q AS (SELECT *, CASE WHEN n_train <= quantile_cont(CAST(n_train AS DOUBLE), 0.25) OVER () THEN 0 WHEN n_train <= quantile_cont(CAST(n_train AS DOUBLE), 0.5) OVER () THEN 1
  WHEN n_train <= quantile_cont(CAST(n_train AS DOUBLE), 0.75) OVER () THEN 2 ELSE 3 END AS size_quartile FROM w)
SELECT family, task_kind, size_quartile, count(DISTINCT dataset) AS datasets, quantile_cont(CAST(n_train AS DOUBLE), 0.5) AS median_rows,
 round(quantile_cont(value, 0.5), 6) AS median_best FROM q GROUP BY ALL""", VA)
def d36(spark, d):
    from evalspark.operators.splits import quartile_bins
    w = R.best_by_score(analysis(spark, d), RD).withColumns({"_all": F.lit(0), "n": F.col("n_train").cast("double")})
    q = quartile_bins(durable(w), ["_all"], "n", "size_quartile")
    return q.groupBy("family", "task_kind", "size_quartile").agg(
        F.count_distinct("dataset").alias("datasets"), R.median("n").alias("median_rows"),
        r(R.median("analysis_metric_value")).alias("median_best"))


@query("d37_reference_audit", """
SELECT 'expected datasets with board rows' AS audit_item, count(DISTINCT dataset) AS found, 25 AS expected,
 CASE WHEN count(DISTINCT dataset) >= 25 THEN 'complete' ELSE 'partial' END AS status FROM v_ref WHERE reference_source = 'board'
UNION ALL SELECT 'reference rows total', count(*), NULL, 'available' FROM v_ref""", ("v_ref",))
def d37(spark, d):
    ref = V.v_ref(spark, d)
    expected = V.table(spark, d, "nation").select(F.col("n_name").alias("dataset"))
    n_exp = expected.agg(F.count(F.lit(1)).cast("int").alias("expected"))
    hit = (ref.where("reference_source = 'board'").join(expected, "dataset", "left_semi")
           .agg(F.count_distinct("dataset").alias("found")).crossJoin(n_exp))  # one row each
    a = hit.select(F.lit("expected datasets with board rows").alias("audit_item"), "found", "expected",
                   F.when(F.col("found") >= F.col("expected"), "complete").otherwise("partial").alias("status"))
    b = ref.agg(F.count(F.lit(1)).alias("found")).select(
        F.lit("reference rows total").alias("audit_item"), "found", F.lit(None).cast("int").alias("expected"),
        F.lit("available").alias("status"))
    return a.unionByName(b)


@query("d38_status_and_task_counts", """
SELECT status, primary_metric, count(*) AS n_rows, count(DISTINCT dataset) AS datasets FROM v_metrics GROUP BY ALL""", VM)
def d38(spark, d):
    return V.v_metrics(spark, d).groupBy("status", "primary_metric").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("dataset").alias("datasets"))


@query("d39_subset_vs_pool_comparison", """
WITH b AS (SELECT dataset, model LIKE 'Chemprop%' OR model LIKE 'MapLight%' AS aux, min(test_rmse) AS best, max(n_train) AS n
 FROM v_analysis WHERE test_rmse IS NOT NULL GROUP BY ALL),
p AS (SELECT dataset, min(best) FILTER (aux) AS with_aux, min(best) FILTER (NOT aux) AS without_aux, max(n) AS n_rows FROM b GROUP BY dataset)
SELECT dataset, with_aux, without_aux, round(with_aux - without_aux, 6) AS rmse_difference, round(with_aux / without_aux, 6) AS rmse_ratio,
 n_rows < 30 AS small_set, CASE WHEN with_aux < without_aux THEN 'aux helps' ELSE 'aux does not help' END AS reading FROM p""", VA)
def d39(spark, d):
    aux = F.col("model").startswith("Chemprop") | F.col("model").startswith("MapLight")
    p = V.v_analysis(spark, d).where("test_rmse IS NOT NULL").groupBy("dataset").agg(
        F.min(F.when(aux, F.col("test_rmse"))).alias("with_aux"), F.min(F.when(~aux, F.col("test_rmse"))).alias("without_aux"),
        F.max("n_train").alias("n"))
    return p.select("dataset", "with_aux", "without_aux", r(F.col("with_aux") - F.col("without_aux")).alias("rmse_difference"),
                    r(C.safe_ratio("with_aux", "without_aux")).alias("rmse_ratio"), (F.col("n") < 30).alias("small_set"),
                    F.when(F.col("with_aux") < F.col("without_aux"), "aux helps").otherwise("aux does not help").alias("reading"))
