"""Cleaning, naming and taxonomy rules applied to whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark.functions import cleaning as C
from evalspark.functions import taxonomy as T
from evalspark.operators import ordering as O
from evalspark.plans import views as V
from evalspark.plans.registry import query, r

TRIM = "trim({}, e' \\t\\n\\r\\f\\x0b')"

# Text variants of a number column: tokens, padding and infinities where the data says so.
DIRTY = """CASE WHEN {c} < 2 THEN ' NaN ' WHEN {c} < 4 THEN 'none' WHEN {c} < 5 THEN '' WHEN {c} < 6 THEN 'inf'
 WHEN {c} < 8 THEN 'n/a' ELSE concat(' ', CAST({c} AS VARCHAR), ' ') END"""


def dirty(c):
    x = F.col(c)
    return (F.when(x < 2, " NaN ").when(x < 4, "none").when(x < 5, "").when(x < 6, "inf").when(x < 8, "n/a")
            .otherwise(F.concat(F.lit(" "), x.cast("string"), F.lit(" "))))


@query("b1_canonical_frame", f"""
WITH k AS (SELECT doc_id, {TRIM.format("CASE WHEN lang = 'fr' AND n_chars < 200 THEN ' NaN ' ELSE text END")} AS entity_key,
 try_cast({TRIM.format("CASE WHEN n_chars > 5000 THEN 'inf' WHEN n_chars < 100 THEN 'n/a' ELSE CAST(n_chars AS VARCHAR) END")}
  AS DOUBLE) AS target FROM documents)
SELECT doc_id, md5(entity_key) AS key_hash, target FROM k
WHERE entity_key IS NOT NULL AND lower(entity_key) NOT IN ('', 'nan', 'none', 'na') AND isfinite(target)""")
def b1(spark, d):
    docs = V.table(spark, d, "documents").select(
        "doc_id", F.when((F.col("lang") == "fr") & (F.col("n_chars") < 200), " NaN ").otherwise(F.col("text")).alias("k"),
        F.when(F.col("n_chars") > 5000, "inf").when(F.col("n_chars") < 100, "n/a")
        .otherwise(F.col("n_chars").cast("string")).alias("t"))
    return C.canonical_frame(docs, "k", "t").select("doc_id", F.md5("entity_key").alias("key_hash"), "target")


@query("b2_null_token_cleaning", f"""
WITH k AS (SELECT event_id, trim({DIRTY.format(c='value')}) AS t FROM events)
SELECT event_id, CASE WHEN lower(t) NOT IN ('', 'nan', 'none', 'null') THEN t END AS cleaned,
 lower(t) NOT IN ('', 'nan', 'none') AS has_error FROM k""")
def b2(spark, d):
    e = V.table(spark, d, "events").select("event_id", dirty("value").alias("t"))
    return e.select("event_id", C.null_clean("t").alias("cleaned"), C.has_error("t").alias("has_error"))


@query("b3_numeric_coercion", f"""
WITH k AS (SELECT event_type, try_cast(trim({DIRTY.format(c='value')}) AS DOUBLE) AS x FROM events)
SELECT event_type, count(*) AS n_rows, count(*) FILTER (isfinite(x)) AS n_numeric,
 round(sum(x) FILTER (isfinite(x)), 3) AS total FROM k GROUP BY event_type""")
def b3(spark, d):
    e = V.table(spark, d, "events").select("event_type", C.to_number(dirty("value")).alias("x"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count("x").alias("n_numeric"),
                                       r(F.sum("x"), 3).alias("total"))


@query("b4_median_fill", """
WITH k AS (SELECT vec_id, pos, CASE WHEN x > 0.3 THEN 'inf'::DOUBLE WHEN x < -0.3 THEN 1e39 ELSE x END AS raw FROM v_long),
c AS (SELECT vec_id, pos, CASE WHEN isfinite(raw) AND abs(raw) <= 3.4028235e38 THEN raw END AS x FROM k),
m AS (SELECT pos, quantile_cont(x, 0.5) AS med FROM c GROUP BY pos)
SELECT vec_id, c.pos, round(coalesce(x, med, 0), 6) AS x FROM c JOIN m ON c.pos = m.pos""", ("v_long",))
def b4(spark, d):
    from evalspark.operators.features import fill_with_medians
    long = V.v_long(spark, d)
    x = F.col("x")
    raw = F.when(x > 0.3, float("inf")).when(x < -0.3, 1e39).otherwise(x)
    return fill_with_medians(long.select("vec_id", "pos", raw.alias("x")), ["pos"], "x").select(
        "vec_id", "pos", r("x").alias("x"))


@query("b5_bool_like", """
SELECT l_returnflag, l_linestatus, lower(trim(l_returnflag)) IN ('true', '1', 'yes', 'y', 't') AS from_letter,
  CASE WHEN l_discount > 0.05 THEN ' Yes' WHEN l_discount > 0.02 THEN 'T ' ELSE '0' END
   IN (' Yes', 'T ') AS from_word, count(*) AS n_rows
FROM lineitem GROUP BY ALL""")
def b5(spark, d):
    li = V.table(spark, d, "lineitem")
    word = F.when(F.col("l_discount") > 0.05, " Yes").when(F.col("l_discount") > 0.02, "T ").otherwise("0")
    return (li.select("l_returnflag", "l_linestatus", C.bool_like("l_returnflag").alias("from_letter"),
                      C.bool_like(word).alias("from_word"))
            .groupBy("l_returnflag", "l_linestatus", "from_letter", "from_word").agg(F.count(F.lit(1)).alias("n_rows")))


@query("b6_first_number_in_text", """
SELECT event_id, try_cast(regexp_extract(concat('score ', CAST(value AS VARCHAR), ' +/- 0.1'),
   '[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?', 0) AS DOUBLE) AS first_float,
 try_cast(regexp_extract(props, '[-+]?\\d+', 0) AS INT) AS first_int FROM events""")
def b6(spark, d):
    e = V.table(spark, d, "events")
    text = F.concat(F.lit("score "), F.col("value").cast("string"), F.lit(" +/- 0.1"))
    return e.select("event_id", C.parse_first_float(text).alias("first_float"), C.parse_first_int("props").alias("first_int"))


# Spellings attached to part types so that every rule of the metric normalisers is hit by real rows.
SPELLINGS = ["RMSE", "ROC-AUC", "auroc", "PR-AUC", "average precision", "Balanced Accuracy", "MCC", "acc", "MSE",
             "root_mean_squared_error", "root mean squared error", "MAE", "Spearman", "pearsonr", "R^2", "r2",
             "mystery", "", "auc_roc", "ba", "test_accuracy", "log loss", "F1"]
SPELL_SQL = "list_value(" + ", ".join(f"'{s}'" for s in SPELLINGS) + ")"
SPELLED = f"""s AS (SELECT p_partkey, unnest({SPELL_SQL}) AS t FROM part),
c AS (SELECT p_partkey, t, lower(trim(t)) AS l, regexp_replace(lower(trim(t)), '[ _-]', '', 'g') AS k,
 translate(lower(trim(t)), '- ', '__') AS u FROM s)"""
RUN_RULE = """CASE
 WHEN k IN ('rocauc', 'auroc', 'aucroc', 'auc') OR contains(l, 'roc-auc') OR contains(l, 'roc_auc') THEN 'roc_auc'
 WHEN k IN ('auprc', 'prauc', 'averageprecision', 'avgprecision') OR contains(l, 'pr-auc') OR contains(l, 'average precision') THEN 'auprc'
 WHEN k IN ('balancedaccuracy', 'balacc', 'bac') OR contains(l, 'balanced accuracy') THEN 'balanced_accuracy'
 WHEN k IN ('mcc', 'matthewscorrcoef', 'matthewscorrelationcoefficient') THEN 'mcc'
 WHEN k IN ('accuracy', 'acc') THEN 'accuracy'
 WHEN contains(l, 'mean_squared_error') OR l = 'mse' THEN 'mse'
 WHEN contains(l, 'rmse') THEN 'rmse' WHEN contains(l, 'mae') THEN 'mae' WHEN contains(l, 'spearman') THEN 'spearman'
 WHEN contains(l, 'pearson') THEN 'pearson' WHEN l IN ('r2', 'r^2') THEN 'r2' ELSE {f} END"""
BOARD_RULE = """CASE WHEN u = '' THEN NULL
 WHEN contains(u, 'mean_squared_error') OR u = 'mse' OR ends_with(u, '_mse') THEN 'mse'
 WHEN contains(u, 'rmse') THEN 'rmse' WHEN contains(u, 'mae') THEN 'mae'
 WHEN contains(u, 'auroc') OR (contains(u, 'roc') AND contains(u, 'auc')) OR u = 'auc' THEN 'roc_auc'
 WHEN contains(u, 'auprc') OR contains(u, 'pr_auc') OR contains(u, 'auc_pr') OR contains(u, 'average_precision') THEN 'auprc'
 WHEN contains(u, 'balanced_accuracy') OR u = 'ba' THEN 'balanced_accuracy'
 WHEN u IN ('accuracy', 'acc') OR ends_with(u, '_accuracy') THEN 'accuracy'
 WHEN u = 'mcc' OR contains(u, 'matthews') THEN 'mcc' WHEN contains(u, 'spearman') THEN 'spearman'
 WHEN contains(u, 'pearson') THEN 'pearson' WHEN u = 'r_squared' OR contains(u, 'r2') OR contains(u, 'r^2') THEN 'r2'
 ELSE u END"""


def spelled(spark, d):
    return V.table(spark, d, "part").select(
        "p_partkey", F.explode(F.array(*[F.lit(s) for s in SPELLINGS])).alias("t"))


def spelling_counts(spark, d):
    """Rows of each spelling: the rules below run once a spelling, not once a row."""
    return spelled(spark, d).groupBy("t").agg(F.count(F.lit(1)).alias("n_rows"))


@query("b7_metric_names_of_runs", f"""WITH {SPELLED}
SELECT t, {RUN_RULE.format(f="'rmse'")} AS metric, count(*) AS n_rows FROM c GROUP BY ALL""")
def b7(spark, d):
    return spelling_counts(spark, d).select("t", T.normalize_metric("t").alias("metric"), "n_rows")


@query("b8_metric_names_of_leaderboards", f"""WITH {SPELLED}
SELECT t, {BOARD_RULE} AS kind, count(*) AS n_rows FROM c GROUP BY ALL""")
def b8(spark, d):
    return spelling_counts(spark, d).select("t", T.leaderboard_metric_kind("t").alias("kind"), "n_rows")


@query("b9_metric_direction", f"""WITH {SPELLED},
n AS (SELECT p_partkey, t, l, {RUN_RULE.format(f="l")} AS m, {BOARD_RULE} AS b FROM c)
SELECT t, CASE WHEN m IN ('rmse', 'mae', 'mse', 'mean_squared_error', 'mean_absolute_error') THEN true
  WHEN m IN ('r2', 'pearson', 'pearsonr', 'spearman', 'spearmanr', 'roc_auc', 'auprc', 'accuracy', 'balanced_accuracy', 'mcc') THEN false
  END AS run_lower,
 CASE WHEN regexp_matches(l, 'rmse|mae|mse|loss|error') THEN true
  WHEN regexp_matches(l, 'accuracy|auc|auprc|auroc|mcc|f1|r2|spearman|pearson') THEN false ELSE true END AS text_lower,
 CASE WHEN b IN ('r2', 'spearman', 'pearson', 'roc_auc', 'auprc', 'balanced_accuracy', 'accuracy', 'mcc') THEN 'higher'
  ELSE 'lower' END AS board_direction, count(*) AS n_rows FROM n GROUP BY ALL""")
def b9(spark, d):
    return spelling_counts(spark, d).select(
        "t", T.metric_lower_is_better("t").alias("run_lower"), T.metric_lower_by_text("t").alias("text_lower"),
        T.leaderboard_direction(T.leaderboard_metric_kind("t")).alias("board_direction"), "n_rows")


@query("b10_primary_metric_default", """
SELECT d.lang AS dataset, CASE WHEN count(DISTINCT l.quality) = 2 THEN 'roc_auc' ELSE 'rmse' END AS label_metric,
 CASE WHEN count(DISTINCT d.n_chars) = 2 THEN 'roc_auc' ELSE 'rmse' END AS size_metric,
 false AS size_metric_is_classification
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def b10(spark, d):
    from evalspark.operators.reports import target_profile
    docs = V.table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("size"))
    lab = V.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    j = docs.join(lab, "doc_id").withColumnRenamed("lang", "dataset")
    a = target_profile(j, ["dataset"], "quality").select("dataset", F.col("default_metric").alias("label_metric"))
    b = target_profile(j, ["dataset"], "size").select("dataset", F.col("default_metric").alias("size_metric"))
    return a.join(b, "dataset").withColumn("size_metric_is_classification", T.is_classification_metric("size_metric"))


@query("b11_split_names", """
WITH s AS (SELECT o_orderpriority, o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'Predefined split'
 WHEN '2-HIGH' THEN ' Scaffold ' WHEN '3-MEDIUM' THEN 'random' WHEN '5-LOW' THEN 'stratified' ELSE '' END AS t FROM orders)
SELECT t, CASE WHEN t = 'Predefined split' THEN 'scaffold' WHEN t = ' Scaffold ' THEN 'scaffold' WHEN t = 'random' THEN 'random'
 WHEN t = 'stratified' THEN 'target_quartiles' ELSE 'scaffold' END AS split,
 CASE WHEN t = 'Predefined split' THEN 'random' WHEN t = ' Scaffold ' THEN 'scaffold' WHEN t = 'random' THEN 'random'
 WHEN t = 'stratified' THEN 'target_quartiles' ELSE 'scaffold' END AS cv_split, count(*) AS n_rows
FROM s GROUP BY ALL""")
def b11(spark, d):
    p = F.col("o_orderpriority")
    t = (F.when(p == "1-URGENT", "Predefined split").when(p == "2-HIGH", " Scaffold ").when(p == "3-MEDIUM", "random")
         .when(p == "5-LOW", "stratified").otherwise(""))
    s = V.table(spark, d, "orders").select(t.alias("t"))
    s = s.select("t", T.normalize_split("t", "scaffold").alias("split"),
                 T.cv_split(T.normalize_split("t", "scaffold", True)).alias("cv_split"))
    return s.groupBy("t", "split", "cv_split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("b12_name_rules", """
SELECT p_partkey, concat('tdc_', lower(trim(p_name))) AS reference_name,
 regexp_replace(lower(p_name), '[^a-z0-9]', '_', 'g') AS slug,
 trim(regexp_replace(lower(trim(p_brand)), '[^0-9a-z]+', '_', 'g'), '_') AS token,
 trim(regexp_replace(p_brand, '[^0-9A-Za-z]', '_', 'g'), '_') AS safe,
 left(concat(lower(p_type), '_', trim(regexp_replace(lower(p_brand), '[^0-9a-z]+', '_', 'g'), '_'), '_',
   trim(regexp_replace(lower(p_name), '[^0-9a-z]+', '_', 'g'), '_')), 31) AS sheet
FROM part""")
def b12(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", T.reference_dataset_name("p_name", F.lit("TDC")).alias("reference_name"),
                    T.slugify("p_name").alias("slug"), T.clean_token("p_brand").alias("token"),
                    T.safe_name("p_brand").alias("safe"),
                    T.sheet_name(F.lower("p_type"), F.lit("main"), F.concat(F.lit("species_"), "p_brand"),
                                 F.concat(F.lit("sex_"), "p_name"), "main").alias("sheet"))


FAMILY_SQL = """CASE WHEN workflow = 'Ensemble' THEN 'Ensemble meta-model' WHEN workflow = 'CFA' THEN 'CFA combinatorial fusion'
 WHEN model = 'TabPFN' THEN 'TabPFN foundation model' WHEN workflow = 'Chemprop v2' THEN 'Graph neural networks (Chemprop)'
 WHEN workflow = 'MapLight + GNN' THEN 'Graph transfer + tabular head' WHEN workflow = 'Uni-Mol' THEN '3D foundation model'
 WHEN workflow = 'ChemML deep learning' THEN 'Deep tabular neural nets' WHEN workflow = 'Tuned conventional ML' THEN 'Tuned conventional ML'
 WHEN workflow = 'Conventional ML' THEN 'Conventional ML' ELSE 'Other / unknown' END"""
METHOD_SQL = """CASE WHEN workflow = 'CFA' THEN 'CFA fusion' WHEN contains(model, 'OOF stacking') THEN 'OOF stacking'
 WHEN contains(model, 'inverse train RMSE') THEN 'Inverse-RMSE weighted average' WHEN workflow = 'Ensemble' THEN 'Other ensemble' END"""
COMPONENT_SQL = """CASE WHEN workflow = 'CFA' THEN 'cfa' WHEN workflow = 'Ensemble' THEN 'ensemble'
 WHEN workflow IN ('MapLight + GNN', 'Chemprop v2', 'ChemML deep learning', 'Uni-Mol') OR model = 'TabPFN' THEN 'deep_backend'
 WHEN model = 'MapLight CatBoost' THEN 'maplight_classic' ELSE 'conventional_ml' END"""


@query("b13_taxonomy", f"""
SELECT model, workflow, {FAMILY_SQL} AS family,
 CASE WHEN contains(model, 'CMPNN') THEN 'CMPNN' WHEN contains(model, 'AttentiveFP') THEN 'AttentiveFP'
  WHEN contains(model, 'D-MPNN') THEN 'D-MPNN' WHEN model = 'MapLight + GNN' THEN 'MapLight + GNN'
  WHEN starts_with(model, 'CFA (') THEN 'CFA fusion' WHEN model = 'TabPFN' THEN 'TabPFN' WHEN model = 'ChemML MLP' THEN 'ChemML MLP'
  WHEN contains(model, 'CatBoost') THEN 'CatBoost-family' WHEN contains(model, 'XGBoost') THEN 'XGBoost-family'
  WHEN contains(model, 'Random Forest') THEN 'RandomForest-family' WHEN contains(model, 'SVR') THEN 'SVR'
  WHEN contains(model, 'ElasticNet') THEN 'ElasticNet-family' WHEN starts_with(model, 'Ensemble (') THEN 'Stacking / averaging'
  ELSE model END AS subfamily,
 CASE WHEN workflow = 'CFA' THEN 'CFA' WHEN workflow = 'Ensemble' THEN 'Ensemble' WHEN workflow = 'MapLight + GNN' THEN 'MapLight+GNN'
  WHEN workflow = 'Chemprop v2' THEN 'Chemprop' WHEN model = 'TabPFN' THEN 'TabPFN'
  WHEN workflow = 'ChemML deep learning' THEN 'Other neural baselines' ELSE 'Conventional ML' END AS publication_family,
 {METHOD_SQL} AS method, {COMPONENT_SQL} AS component,
 CASE WHEN workflow = 'Ensemble' THEN 'Ensemble' WHEN workflow = 'CFA' THEN 'CFA fusion' WHEN ends_with(model, ' GA') THEN 'GA tuned conventional'
  WHEN model = 'ChemML MLP' THEN 'ChemML deep learning' WHEN workflow = 'Chemprop v2' THEN 'Chemprop deep learning'
  WHEN workflow = 'Uni-Mol' THEN 'Uni-Mol deep learning' WHEN workflow = 'MapLight + GNN' THEN 'MapLight + GNN deep learning'
  ELSE 'Conventional ML' END AS stage_type,
 regexp_matches(lower(model), 'catboost|xgboost|random forest|extra trees|adaboost') AS is_tree,
 workflow = 'Ensemble' AS is_ensemble, count(*) AS n_rows
FROM v_metrics GROUP BY ALL""", ("v_metrics",))
def b13(spark, d):
    m = V.v_metrics(spark, d).groupBy("model", "workflow").agg(F.count(F.lit(1)).alias("n_rows"))
    return m.select(
        "model", "workflow", T.architecture_family("workflow", "model").alias("family"),
        T.architecture_subfamily("model").alias("subfamily"),
        T.publication_family("model", "workflow").alias("publication_family"),
        T.ensemble_method("model", "workflow").alias("method"), T.component_family("model", "workflow").alias("component"),
        T.stage_type("model").alias("stage_type"), T.is_tree_model("model").alias("is_tree"),
        T.is_ensemble_row("model", "workflow").alias("is_ensemble"), "n_rows")


@query("b14_workflow_override", """
SELECT model, CASE WHEN model = 'TabPFN' THEN 'TabPFN' WHEN starts_with(model, 'CFA (') THEN 'CFA' ELSE workflow END AS workflow,
 count(*) AS n_rows FROM v_metrics GROUP BY ALL""", ("v_metrics",))
def b14(spark, d):
    m = V.v_metrics(spark, d).select("model", T.workflow_override("model", "workflow").alias("workflow"))
    return m.groupBy("model", "workflow").agg(F.count(F.lit(1)).alias("n_rows"))


@query("b15_log10_target", """
WITH m AS (SELECT event_type, min(value) AS lo FROM events GROUP BY event_type),
k AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN value - 1 ELSE value END AS y FROM events),
g AS (SELECT event_type, min(y) > 0 AS positive FROM k GROUP BY event_type)
SELECT event_id, round(CASE WHEN positive THEN log10(y) ELSE y END, 8) AS target,
 CASE WHEN positive THEN 'log10' ELSE 'raw' END AS target_transform FROM k JOIN g ON k.event_type = g.event_type""")
def b15(spark, d):
    from evalspark.operators.reports import log10_target
    e = V.table(spark, d, "events").select(
        "event_id", "event_type", F.when(F.col("event_type") == "error", F.col("value") - 1)
        .otherwise(F.col("value")).alias("target"))
    return log10_target(e, ["event_type"]).select("event_id", r("target", 8).alias("target"), "target_transform")


@query("b16_leaderboard_scale", """
SELECT dataset, model, round(CASE WHEN leaderboard_metric_name = 'RMSE' THEN metric_value_numeric ** 2
 ELSE metric_value_numeric END, 6) AS value FROM v_ref""", ("v_ref",))
def b16(spark, d):
    ref = V.v_ref(spark, d).withColumn("kind", F.when(F.col("leaderboard_metric_name") == "RMSE", "mse").otherwise("other"))
    v = F.col("metric_value_numeric")
    return ref.select("dataset", "model", r(F.when(F.col("kind") == "mse", v * v).otherwise(v)).alias("value"))


@query("b17_task_inference", """
SELECT d.lang AS dataset, count(*) AS n_rows, count(DISTINCT l.quality) = 2 AS strict_binary, CASE WHEN count(DISTINCT l.quality) = 2 THEN 'classification' ELSE 'regression' END AS task_type
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang
UNION ALL SELECT event_type, count(*), false, 'regression' FROM events GROUP BY event_type""")
def b17(spark, d):
    from evalspark.operators.reports import target_profile
    lab = (V.table(spark, d, "documents").select("doc_id", F.col("lang").alias("dataset"))
           .join(V.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("target")), "doc_id"))
    ev = V.table(spark, d, "events").select(F.col("event_type").alias("dataset"), F.col("value").alias("target"))
    p = target_profile(lab.select("dataset", "target").unionByName(ev), ["dataset"], "target")
    return p.select("dataset", "n_rows", "strict_binary", "task_type")


@query("b18_row_metric_choice", """
SELECT run_name, dataset, model, attempt,
 CASE WHEN test_roc_auc IS NOT NULL THEN 'test_roc_auc' ELSE 'test_rmse' END AS analysis_metric,
 CASE WHEN test_roc_auc IS NOT NULL THEN 'roc_auc' ELSE 'rmse' END AS analysis_metric_kind,
 coalesce(test_roc_auc, test_rmse) AS analysis_metric_value FROM v_metrics""", ("v_metrics",))
def b18(spark, d):
    from evalspark.operators.reports import with_analysis_metric
    return with_analysis_metric(V.v_metrics(spark, d)).select(
        "run_name", "dataset", "model", "attempt", "analysis_metric", "analysis_metric_kind", "analysis_metric_value")


@query("b19_missing_value_strategies", f"""
WITH k AS (SELECT event_id, event_type, try_cast(trim({DIRTY.format(c='value')}) AS DOUBLE) AS v0 FROM events),
c AS (SELECT event_id, event_type, CASE WHEN isfinite(v0) THEN v0 END AS v FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM c),
b AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w AS pi,
  first_value(v IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ni FROM p
  WINDOW w AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   f AS (PARTITION BY event_type ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, coalesce(v, 0) AS zero_filled, round(CASE WHEN v IS NOT NULL THEN v WHEN pv IS NOT NULL AND nv IS NOT NULL
 THEN pv + (nv - pv) * (i - pi) / (ni - pi) ELSE pv END, 6) AS interpolated, v IS NOT NULL AS kept FROM b""")
def b19(spark, d):
    e = V.table(spark, d, "events").select("event_id", "event_type", dirty("value").alias("raw"))
    e = e.withColumn("v", C.to_number("raw")).drop("raw")
    filled = C.interpolate_linear(e.withColumn("known", F.col("v")), ["event_type"], "event_id", "v")
    return filled.select("event_id", F.coalesce("known", F.lit(0.0)).alias("zero_filled"),
                         r("v").alias("interpolated"), F.col("known").isNotNull().alias("kept"))


@query("b20_fill_if_missing", """
SELECT d.doc_id, coalesce(CAST(l.quality AS DOUBLE), d.n_chars / 1000.0::DOUBLE) AS value,
 CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 0 END AS available FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def b20(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    lab = V.table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(lab, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("double"), F.col("n_chars") / 1000.0).alias("value"),
        F.col("quality").isNotNull().cast("int").alias("available"))


@query("b21_one_hot_labels", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('species=', coalesce(nullif(concat_ws('+',
  CASE WHEN l_returnflag = 'A' THEN 'a' END, CASE WHEN l_discount > 0.05 THEN 'big' END, CASE WHEN l_tax > 0.04 THEN 'taxed' END), ''), 'unknown'),
 '|sex=', CASE WHEN l_linestatus = 'F' THEN 'f' ELSE 'unknown' END) AS label FROM lineitem""")
def b21(spark, d):
    li = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_returnflag") == "A").cast("int").alias("species_a"),
        (F.col("l_discount") > 0.05).cast("int").alias("species_big"),
        (F.col("l_tax") > 0.04).cast("int").alias("species_taxed"),
        (F.col("l_linestatus") == "F").cast("int").alias("sex_f"))
    label = F.concat(F.lit("species="), C.one_hot_label(["species_a", "species_big", "species_taxed"], "species_"),
                     F.lit("|sex="), C.one_hot_label(["sex_f"], "sex_"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", label.alias("label"))


@query("b22_align_to_training_columns", """
WITH t AS (SELECT DISTINCT pos FROM v_long WHERE label < 5),
med AS (SELECT pos, quantile_cont(x, 0.5) AS m FROM v_long WHERE label < 5 GROUP BY pos),
q AS (SELECT vec_id, pos, x FROM v_long WHERE label >= 5 AND x > 0), ids AS (SELECT DISTINCT vec_id FROM v_long WHERE label >= 5)
SELECT ids.vec_id, concat('aux__', CAST(med.pos AS VARCHAR)) AS feature, round(coalesce(q.x, med.m), 6) AS x
FROM ids CROSS JOIN med LEFT JOIN q ON q.vec_id = ids.vec_id AND q.pos = med.pos""", ("v_long",))
def b22(spark, d):
    from evalspark.operators.features import align_to_training, training_medians
    emb = V.table(spark, d, "embeddings")
    train = V.v_long(spark, d).where("label < 5")
    query_rows = emb.where("label >= 5").select(
        "vec_id", F.transform("embedding", lambda x: F.when(x > 0, x.cast("double"))).alias("features"))
    out = align_to_training(query_rows, training_medians(train, "pos", "x"), "features")
    return out.select("vec_id", F.posexplode("features").alias("pos", "x")).select(
        "vec_id", F.concat(F.lit("aux__"), F.col("pos").cast("string")).alias("feature"), r("x").alias("x"))


@query("b23_categorical_completion", f"""
WITH e AS (SELECT * FROM (VALUES ('OOF stacking'), ('Inverse-RMSE weighted average'), ('CFA fusion'), ('Median blend')) t(method)),
g AS (SELECT {METHOD_SQL} AS method, count(*) AS n FROM v_metrics GROUP BY ALL)
SELECT e.method, coalesce(n, 0) AS n_rows FROM e LEFT JOIN g ON e.method = g.method""", ("v_metrics",))
def b23(spark, d):
    dim = spark.createDataFrame([(m,) for m in (*T.ENSEMBLE_METHODS, "Median blend")], "method string")
    g = (V.v_metrics(spark, d).groupBy(T.ensemble_method("model", "workflow").alias("method"))
         .agg(F.count(F.lit(1)).alias("n_rows")))
    return dim.join(g, "method", "left").fillna(0, ["n_rows"])


@query("b24_rates_and_ratios", """
SELECT run_name, dataset, model, round(sum(elapsed_seconds) / nullif(sum(n_train), 0) * 1000, 4) AS seconds_per_1000,
 round(sum(n_train) / nullif(sum(CASE WHEN error = 'timeout' THEN 0 ELSE n_train END), 0), 6) AS ratio
FROM v_metrics GROUP BY ALL""", ("v_metrics",))
def b24(spark, d):
    g = V.v_metrics(spark, d).groupBy("run_name", "dataset", "model").agg(
        F.sum("elapsed_seconds").alias("s"), F.sum("n_train").alias("n"),
        F.sum(F.when(F.col("error") == "timeout", 0).otherwise(F.col("n_train"))).alias("ok"))
    return g.select("run_name", "dataset", "model", r(C.safe_ratio("s", "n") * 1000, 4).alias("seconds_per_1000"),
                    r(C.safe_ratio("n", "ok")).alias("ratio"))


@query("b25_relative_improvement", """
WITH p AS (SELECT run_name, dataset, primary_metric, max(primary_metric_value) FILTER (model = 'SVR') AS base,
  max(primary_metric_value) FILTER (model = 'CatBoost') AS challenger FROM v_metrics GROUP BY ALL)
SELECT run_name, dataset, round(CASE WHEN primary_metric = 'RMSE' THEN base - challenger ELSE challenger - base END
 / greatest(abs(base), 1e-12), 6) AS improvement FROM p""", ("v_metrics",))
def b25(spark, d):
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("primary_metric_value")))
    g = V.v_metrics(spark, d).groupBy("run_name", "dataset", "primary_metric").agg(
        pick("SVR").alias("base"), pick("CatBoost").alias("challenger"))
    return g.select("run_name", "dataset", r(T.relative_improvement(
        "base", "challenger", T.metric_lower_by_text("primary_metric"))).alias("improvement"))


@query("b26_runtime_estimate", """
SELECT event_type, count(*) AS n_rows, round(10 ** (-0.658 + 1.225 * log10(count(*))), 4) AS seconds,
 round(10 ** ((log10(7200) + 0.658) / 1.225), 2) AS rows_at_timeout FROM events GROUP BY event_type""")
def b26(spark, d):
    from evalspark.operators.reports import selector_rows_at, selector_seconds
    g = V.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"))
    return g.select("event_type", "n_rows", r(selector_seconds("n_rows"), 4).alias("seconds"),
                    r(selector_rows_at(F.lit(7200.0)), 2).alias("rows_at_timeout"))


@query("b28_value_texts", """
SELECT event_id, concat(event_type, ' +/- ', CAST(user_id AS VARCHAR)) AS value_text,
 CASE WHEN value >= 3599.5 THEN 'long' WHEN round(value) >= 60
  THEN concat(CAST(CAST(floor(round(value) / 60) AS BIGINT) AS VARCHAR), 'm ', lpad(CAST(CAST(round(value) % 60 AS BIGINT) AS VARCHAR), 2, '0'), 's')
  ELSE concat(CAST(CAST(round(value) AS BIGINT) AS VARCHAR), 's') END AS duration,
 CASE WHEN user_id > 10 THEN '>10' ELSE CAST(user_id AS VARCHAR) END AS rank_label FROM events""")
def b28(spark, d):
    e = V.table(spark, d, "events")
    uid = F.col("user_id")
    return e.select("event_id", C.format_value("event_type", uid.cast("string")).alias("value_text"),
                    F.when(F.col("value") >= 3599.5, "long").otherwise(C.format_seconds("value")).alias("duration"),
                    F.when(uid > 10, ">10").otherwise(uid.cast("string")).alias("rank_label"))


@query("b29_conditional_repair", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'HOUSEHOLD' AND c_acctbal < 0 THEN 'HOME' ELSE c_mktsegment END AS segment, c_acctbal
FROM customer WHERE c_acctbal <> 0 AND regexp_matches(c_mktsegment, 'H|B')""")
def b29(spark, d):
    c = V.table(spark, d, "customer").where((F.col("c_acctbal") != 0) & F.col("c_mktsegment").rlike("H|B"))
    fixed = F.when((F.col("c_mktsegment") == "HOUSEHOLD") & (F.col("c_acctbal") < 0), "HOME")
    return c.select("c_custkey", fixed.otherwise(F.col("c_mktsegment")).alias("segment"), "c_acctbal")


@query("b30_json_round_trip", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
 concat('{"k":', CAST(json_extract(props, '$.k') AS VARCHAR), ',"type":"', event_type, '"}') AS encoded FROM events""")
def b30(spark, d):
    e = V.table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.select("event_id", "p.k", F.to_json(F.struct("p.k", F.col("event_type").alias("type"))).alias("encoded"))


@query("b31_stable_float_text", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, printf('%.12g', l_extendedprice / 7) AS price_text,
 printf('%.12g', l_discount / 1000) AS small_text FROM lineitem""")
def b31(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                     C.stable_float_text(F.col("l_extendedprice") / 7).alias("price_text"),
                     C.stable_float_text(F.col("l_discount") / 1000).alias("small_text"))


@query("b32_log_of_delta_with_floor", """
WITH d AS (SELECT run_name, dataset, model, attempt, test_rmse - min(test_rmse) OVER (PARTITION BY run_name, dataset) AS x
 FROM v_metrics WHERE test_rmse IS NOT NULL),
f AS (SELECT greatest(0.5 * min(x) FILTER (x > 0), 1e-12) AS fl FROM d)
SELECT run_name, dataset, model, attempt, round(log10(x + fl), 5) AS log_delta FROM d CROSS JOIN f""", ("v_metrics",))
def b32(spark, d):
    m = V.v_metrics(spark, d).where("test_rmse IS NOT NULL")
    w = Window.partitionBy("run_name", "dataset")
    x = m.select("run_name", "dataset", "model", "attempt", (F.col("test_rmse") - F.min("test_rmse").over(w)).alias("x"))
    floor = x.agg(F.greatest(0.5 * F.min(F.when(F.col("x") > 0, F.col("x"))), F.lit(1e-12)).alias("fl"))
    return x.crossJoin(F.broadcast(floor)).select(  # one-row side
        "run_name", "dataset", "model", "attempt", r(F.log10(F.col("x") + F.col("fl")), 5).alias("log_delta"))


@query("b33_comparison_score", """
SELECT run_name, dataset, model, attempt,
 CASE WHEN primary_metric = 'RMSE' THEN primary_metric_value ELSE -primary_metric_value END AS comparison_score
FROM v_metrics WHERE error IS NULL OR error = 'nan'""", ("v_metrics",))
def b33(spark, d):
    m = V.v_metrics(spark, d).where(~C.has_error("error"))
    return m.select("run_name", "dataset", "model", "attempt", T.comparison_score(
        "primary_metric_value", T.metric_lower_by_text("primary_metric")).alias("comparison_score"))


@query("b34_error_transition", """
WITH e AS (SELECT dataset, model, attempt, max(error) FILTER (run_name = 'run_F') AS prev,
  max(CASE WHEN model = 'SVR' AND dataset < 'NATION_2' THEN NULL WHEN model = 'SVR GA' THEN 'crash' ELSE error END)
   FILTER (run_name = 'run_O') AS curr FROM v_metrics GROUP BY ALL),
c AS (SELECT dataset, model, attempt, CASE WHEN lower(trim(prev)) NOT IN ('', 'nan', 'none') THEN trim(prev) END AS p,
  CASE WHEN lower(trim(curr)) NOT IN ('', 'nan', 'none') THEN trim(curr) END AS q FROM e)
SELECT dataset, model, attempt, CASE WHEN p IS NULL AND q IS NULL THEN 'ok_both' WHEN p IS NULL THEN 'new_error'
 WHEN q IS NULL THEN 'resolved' WHEN p = q THEN 'persistent_same' ELSE 'changed_error' END AS transition FROM c""", ("v_metrics",))
def b34(spark, d):
    m = V.v_metrics(spark, d)
    curr = (F.when((F.col("model") == "SVR") & (F.col("dataset") < "NATION_2"), None)
            .when(F.col("model") == "SVR GA", "crash").otherwise(F.col("error")))
    g = m.groupBy("dataset", "model", "attempt").agg(
        F.max(F.when(F.col("run_name") == "run_F", F.col("error"))).alias("p"),
        F.max(F.when(F.col("run_name") == "run_O", curr)).alias("q"))
    clean = lambda c: C.null_clean(c, C.ERROR_NULL_TOKENS)
    return g.select("dataset", "model", "attempt", T.error_transition("p", "q", clean).alias("transition"))
